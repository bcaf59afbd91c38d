"""Quality rules in DataFrame functions only: base rules and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

BUCKETS, SMOOTH = 10_000, 1.0
#: A document is kept if its mean log-likelihood ratio per n-gram is at least this.
LEAST_RATIO = -0.06
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Expected number of trusted ids that go to every executor at once.
MOST_TRUSTED = 200_000
_SPACE = "\\x20\\x09-\\x0D"
_SYMBOLS = "#*$%&|<>"
#: Up to so many different repeated windows are looked up one by one, more are found by sorting.
FEW = 48


def _let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{_SPACE}]+"), lambda w: w != "")


def _covered(starts: Column) -> Column:
    """Words in windows of three that begin at the ascending ``starts``."""
    n = F.size(starts)
    gaps = F.zip_with(F.slice(starts, 2, F.greatest(n - 1, F.lit(0))), F.slice(starts, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    return F.when(n == 0, 0).otherwise(F.aggregate(gaps, F.lit(3), lambda s, x: s + x)).cast("long")


def _in_repeats(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``w``, first occurrences included."""

    def marked(g):
        def by_neighbour(s):
            return F.filter(s, lambda x, i: x == F.get(s, i + 1))

        def few(dups):
            return F.filter(F.transform(g, lambda x, i: F.when(F.array_contains(dups, x), i)), lambda i: i.isNotNull())

        def many(_):
            pairs = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
            found = _let(pairs, lambda s: F.filter(F.transform(s, lambda p, k: F.when((p["x"] == F.get(s, k + 1)["x"]) | (p["x"] == F.get(s, k - 1)["x"]), p["i"])), lambda i: i.isNotNull()))
            return F.sort_array(found)

        dups = _let(F.sort_array(g), lambda s: F.array_distinct(by_neighbour(s)))
        return _let(dups, lambda d: F.when(F.size(d) == 0, F.lit(0).cast("long")).otherwise(_covered_of(F.when(F.size(d) <= FEW, few(d)).otherwise(many(d)))))

    last = F.size(w) - 3
    grams = F.when(last < 1, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return _let(grams, marked)


def _covered_of(starts: Column) -> Column:
    return _let(starts, _covered)


def ngrams(w: Column) -> Column:
    """Buckets of the lower-cased words and of pairs of neighbours."""
    n = F.size(w)
    ones = F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))
    twos = F.when(n < 2, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1)), F.lit(BUCKETS)).cast("int")))
    return F.concat(ones, twos)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(trusted share / corpus share) of every bucket, from counts over all documents.

    ``trusted(doc_id)`` names the trusted target documents; all of them make the target's multinomial, and the
    corpus's is counted over every document. Up to two blocks of about MOST_TRUSTED ids are sent to where the documents are read,
    a pass over them each. For more ids the documents' n-gram buckets, two bytes each, are joined with them by one shuffle: two
    passes, however many ids there are. The result has BUCKETS numbers, so it is the one thing
    brought to the driver. Without trusted or any documents every ratio is zero.
    """
    target = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    blocks = max(1, -(-target.count() // MOST_TRUSTED))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source, raw, good = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")), Counter(), Counter()
    if blocks > 2:
        of = lambda rows: {r.b: r.n for r in rows.groupBy("b").agg(F.count("*").alias("n")).collect()}
        raw.update(of(source.select(F.explode(ngrams_of(F.col("text"))).alias("b"))))
        lists = source.where("doc_id is not null").select("doc_id", ngrams_of(F.col("text")).cast("array<smallint>").alias("grams"))
        good.update(of(lists.join(target, "doc_id").select(F.explode("grams").alias("b"))))
        blocks = 0
    for k in range(blocks):
        some = target.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k).withColumn("good", F.lit(1))
        per = source.join(F.broadcast(some), "doc_id", "inner" if k else "left")  # the first pass counts the corpus too
        for r in per.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(ngrams_of(F.col("text"))).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect():
            raw[r.b] += 0 if k else r.raw
            good[r.b] += r.good
    n, m = sum(raw.values()), sum(good.values())
    if not m:
        return [0.0] * BUCKETS
    low = SMOOTH * BUCKETS
    return [math.log((good.get(b, 0) + SMOOTH) / (m + low)) - math.log((raw.get(b, 0) + SMOOTH) / (n + low)) for b in range(BUCKETS)]


def rules(docs: DataFrame, ratios: list[float], least: float = LEAST_RATIO) -> DataFrame:
    """One row per document: the base counts, base_failed, ratio and kept.

    A null text has no words. ``ratio`` is the mean log-likelihood ratio over the n-grams of the
    lower-cased words, 0 without n-grams. Repeated rows give repeated rows, an empty table none; texts are read whole.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    space = "".join(map(chr, [32, *range(9, 14)]))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{_SPACE}]"))
    total = _let(ngrams_of(text), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.size(g)))
    counted = _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _in_repeats(w).alias("n_repeat_words")))
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        counted.alias("w"),
        F.length(F.translate(text, space, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        total.alias("ratio"),
    )
    failed = (F.col("w.n_words") < MIN_WORDS) | (100 * F.col("w.n_repeat_words") > MAX_REPEATED_PERCENT * F.col("w.n_words"))
    return out.select("doc_id", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", failed.alias("base_failed"), "ratio", (~failed & (F.col("ratio") >= least)).alias("kept"))


def ngrams_of(text: Column) -> Column:
    return _let(words(F.lower(text)), ngrams)


def filter_quality(docs: DataFrame, labels: DataFrame, least: float = LEAST_RATIO) -> DataFrame:
    """The rules with the documents labelled ``quality = 1`` as the trusted target."""
    return rules(docs, log_ratios(docs, labels.where("quality = 1")), least)
