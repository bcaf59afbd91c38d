"""Prefix-target expansion of conversations into training texts, with built-in functions only.

Every assistant turn becomes an example of its own: all turns before it as context, its own text the only trainable span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The template's control strings: a turn is START role MIDDLE text END.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Written into a control string's likeness inside a text, after its first character.
JOINER = "\u2060"
#: What follows the first character of a control string of this template or of other common ones.
_REST = r"(\||/?s>|/?INST\])"
_LIKENESS = rf"([<\[])({JOINER}*){_REST}"
TRAINED = "assistant"


def escape(x: Column) -> Column:
    """One joiner more in every likeness of a control string, so none is left bare; any two texts stay different."""
    return F.regexp_replace(x, _LIKENESS, f"$1{JOINER}$2$3")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, rf"([<\[]){JOINER}({JOINER}*){_REST}", "$1$2$3")


def expand(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> one row per example: conv_id, example (0.. in a conversation), n_turns
    (its own), text (formatted), loss_start and loss_length (the trainable characters of ``text``), reply, final.

    A conversation that doesn't end with an assistant turn has one example more, of all its turns, with nothing to train
    (``reply`` false), so that its text is in the output too; ``final`` marks each conversation's last example. Turns go by
    ``turn``, nulls first, ties by role and text; repeated rows are repeated turns. Null roles and texts are empty, null ids one
    conversation; further columns are ignored, an empty table has no examples.

    A conversation is gathered in one row, as its last example must be by definition, and expanded there: examples are
    built one after the other, so a task holds a conversation and one example. Their bytes together grow with the
    square of a conversation's length, which this format implies.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    pieces = whole.select(
        "conv_id",
        F.transform("t", lambda x: F.concat(F.lit(START), escape(x["role"]), F.lit(MIDDLE), escape(x["text"]), F.lit(END))).alias("pieces"),
        F.filter(F.transform("t", lambda x, i: F.when((x["role"] == TRAINED) | (i + 1 == F.size("t")), F.struct((i + 1).alias("n"), (x["role"] == TRAINED).alias("reply"), (i + 1 == F.size("t")).alias("final")))), lambda x: x.isNotNull()).alias("ends"),
    )
    each = pieces.select("conv_id", "pieces", F.posexplode("ends").alias("example", "end"))
    frame = len(START + MIDDLE + END + TRAINED)
    size = F.when(F.col("end.reply"), F.length(F.element_at("pieces", F.col("end.n"))) - frame).otherwise(0)
    texts = each.select("conv_id", "example", F.col("end.n").alias("n_turns"), F.array_join(F.slice("pieces", F.lit(1), F.col("end.n")), "").alias("text"), size.alias("loss_length"), F.col("end.reply").alias("reply"), F.col("end.final").alias("final"))
    start = F.when(F.col("reply"), F.length("text") - len(END) - F.col("loss_length")).otherwise(0)
    return texts.select("conv_id", "example", "n_turns", "text", start.alias("loss_start"), "loss_length", "reply", "final")


def turns_of(text: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>."""
    pieces = F.split(text, F.lit(END.replace("|", "\\|")))  # the last piece is what follows the last turn: nothing
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(START) + 1)), MIDDLE, 1)).alias("role"), unescape(F.substring_index(p, MIDDLE, -1)).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Only trained texts and each conversation's last example go into the aggregation, none of the contexts."""
    lines = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    trained = F.expr("substring(text, loss_start + 1, loss_length)")
    read = examples.select("conv_id", "example", F.when(F.col("reply"), unescape(trained)).alias("trained"), F.when(F.col("final"), turns_of(F.col("text"))).alias("turns"), F.length("text").cast("long").alias("chars"))
    each = read.select("conv_id", F.struct("example", "trained", F.size("turns").alias("n"), lines.alias("lines")).alias("x"), "chars")
    own = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"), F.sum("chars").alias("formatted_chars"))
    own = own.select("conv_id", F.array_max(F.col("x.n")).cast("long").alias("n_turns"), F.concat_ws("", "x.lines").alias("lines"), F.concat_ws("", "x.trained").alias("trained"), "formatted_chars")
    return own.select("conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars")


#: The conversation that the registered query adds to the table's.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_probe(conversations: DataFrame) -> DataFrame:
    own = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).unionByName(own)


def oracle() -> str:
    esc = f"length(regexp_replace({{}}, '{_LIKENESS}', '\\1{JOINER}\\2\\3', 'g'))"
    probe = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in PROBE)
    return f"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from (select conv_id, turn, role, text from conversations union all values {probe})),
p as (select *, {esc.format("role")} + {esc.format("text")} + {len(START + MIDDLE + END)} as n, row_number() over w as k, count(*) over (partition by conv_id) as m from t window w as (partition by conv_id order by turn nulls first, role, text)),
s as (select *, sum(n) over (partition by conv_id order by k) as upto from p)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = '{TRAINED}'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (where role = '{TRAINED}'), '')) as loss_sha256,
  sum(upto) filter (where role = '{TRAINED}' or k = m)::bigint as formatted_chars
from s group by conv_id"""
