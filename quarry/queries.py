"""Registered queries of the retrieval engine and their DuckDB oracles, over whole test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.functions import text as T, vectors as V
from quarry.operators import chunk as C, evaluate as E, jobs as J, preprocess as P, retrieve as R, tables as TB
from quarry.plans import pipeline as PL
from quarry.sources import tables as S
from quarry.sources.paged import pages_as_documents, read_pages
from quarry.sources.shared import new_path, spread
from quarry.sources.store import text_store

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("/docs/"), "doc_id", F.lit(".txt")).alias("source_path"), F.coalesce("text", F.lit("")).alias("text"), F.lit("").alias("preprocessor_name"))


# --- fixed windows -------------------------------------------------------------------------------

_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_PARAS = """list_filter(list_transform(regexp_split_to_array({x}, '{sep}'), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '')"""


def _char(size: int, overlap: int) -> None:
    step = size - overlap
    sql = f"""select doc_id::varchar || '_chunk_' || k as chunk_id, k::int as chunk_idx, substring(text, (k * {step} + 1)::bigint, {size}) as text
from (select doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - {size}) / {step}.0))::bigint)) as k from documents where text <> '')"""

    @query(sql, f"chunk_char_{size}_{overlap}")
    def run(spark, sf_dir):
        return C.by_characters(documents(spark, sf_dir), size, overlap).select("chunk_id", "chunk_idx", "text")


def _paragraph(size: int, overlap: int, blank: bool = False) -> None:
    step = size - overlap
    src = "replace(text, chr(10), chr(10) || chr(10))" if blank else "text"
    sql = f"""with p as (select doc_id, {_PARAS.format(x=src, sep="\\n\\s*\\n")} as a, {_PARAS.format(x=src, sep="\\n")} as b from documents where text is not null),
q as (select doc_id, case when len(a) < 10 then b else a end as p from p)
select doc_id::varchar || '_chunk_' || k as chunk_id, k::int as chunk_idx, array_to_string(p[k * {step} + 1:k * {step} + {size}], chr(10) || chr(10)) as text
from (select doc_id, p, unnest(generate_series(0, greatest(0, ceil((len(p) - {size}) / {step}.0))::bigint)) as k from q where len(p) > 0)"""

    @query(sql, f"chunk_paragraph_{size}_{overlap}" + "_blankline" * blank)
    def run(spark, sf_dir):
        docs = documents(spark, sf_dir)
        if blank:
            docs = docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
        return C.by_paragraphs(docs, size, overlap).select("chunk_id", "chunk_idx", "text")


for _a in ((500, 50), (1500, 0), (1000, 200)):
    _char(*_a)
for _a in ((1, 0), (2, 1), (3, 0)):
    _paragraph(*_a)
_paragraph(2, 0, True)


@query("select doc_id::varchar || '_chunk_0' as chunk_id, text, '/docs/' || doc_id || '.txt' as source_path from documents where text <> ''")
def chunk_passthrough(spark, sf_dir):
    return C.whole(documents(spark, sf_dir)).select("chunk_id", "text", F.col("metadata")["source_path"].alias("source_path"))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+([A-ZÄÖÜ\\d])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


@query(f"select doc_id::varchar as doc_id, (i - 1)::int as idx, s[i] as sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, {_SENTENCES} as s from documents where text is not null))")
def sentences(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))


def _dynamic(size: int, overlap: int) -> None:
    sql = f"""with recursive s as (select doc_id, list_transform({_SENTENCES}, lambda x: regexp_split_to_array(x, '\\s+')) as t from documents where text is not null),
d as (select doc_id, t, flatten(t) as w, list_transform(t, lambda x: len(x)) as l,
       list_transform(range(0, len(t) + 1), lambda k: coalesce(list_sum(list_transform(t[1:k], lambda x: len(x))), 0)::bigint) as c from s where len(t) > 0),
r as (select doc_id, 1::bigint as s, 1::bigint as i, 0::bigint as step, 0::bigint as a, 0::bigint as b, 0::bigint as kind from d
 union all
 select d.doc_id,
   case when r.i > len(d.l) then r.i + 1
        when r.i > r.s and d.c[r.i + 1] - d.c[r.s] > {size} then greatest(r.s + 1, coalesce(list_min(list_filter(range(r.s, r.i), lambda o: d.c[r.i] - d.c[o] <= {overlap})), r.i))
        when d.l[r.i] > {size} then r.i + 1 else r.s end,
   case when r.i > len(d.l) then r.i + 1
        when r.i > r.s and d.c[r.i + 1] - d.c[r.s] > {size} then r.i
        else r.i + 1 end,
   r.step + 1,
   case when r.i > len(d.l) then d.c[r.s] when r.i > r.s and d.c[r.i + 1] - d.c[r.s] > {size} then d.c[r.s] else d.c[r.i] end,
   case when r.i > len(d.l) then d.c[len(d.l) + 1] when r.i > r.s and d.c[r.i + 1] - d.c[r.s] > {size} then d.c[r.i] else d.c[r.i + 1] end,
   case when r.i > len(d.l) then 1 when r.i > r.s and d.c[r.i + 1] - d.c[r.s] > {size} then 1 when d.l[r.i] > {size} then 2 else 0 end
 from r join d using (doc_id) where r.i <= len(d.l) or (r.i = len(d.l) + 1 and r.s <= len(d.l))),
e as (select doc_id, step, 0::bigint as k, a, b from r where kind = 1
 union all select doc_id, step, k, a + k, least(a + k + {size}, b) from (select *, unnest(range(0, b - a, {max(1, size - overlap)})) as k from r where kind = 2))
select e.doc_id::varchar as doc_id, (row_number() over (partition by e.doc_id order by step, k) - 1)::int as chunk_idx, array_to_string(d.w[e.a + 1:e.b], ' ') as words
from e join d using (doc_id)"""

    @query(sql, f"chunk_dynamic_{size}_{overlap}")
    def run(spark, sf_dir):
        return C.by_sentences(documents(spark, sf_dir), size, overlap).select("doc_id", "chunk_idx", F.array_join(T.words(F.col("text")), " ").alias("words"))


_dynamic(150, 0)
_dynamic(150, 15)

# --- clusters and model boundaries ---------------------------------------------------------------


@query("""with recursive e as (select label, row_number() over (partition by label order by vec_id) i, list_transform(embedding, lambda x: x::double) v from embeddings),
p as (select a.label, a.i, b.i as j, list_cosine_similarity(a.v, b.v) s from e a join e b on a.label = b.label and b.i < a.i),
r as (select label, 1::bigint i, 1::bigint cs, null::double pm, 0::bigint g from e where i = 1
 union all
 select z.label, z.i, case when z.ok then z.cs else z.i end, case when z.ok then z.npm end, case when z.ok then z.g else z.g + 1 end
 from (select r.label, r.i + 1 as i, r.cs, r.g,
   case when r.i + 1 - r.cs > 1 then least(agg.mn, r.pm) else agg.mn end as npm,
   case when r.i + 1 - r.cs > 1 then agg.mx > greatest(r.pm * 0.9 / (1 + exp(-(r.i + 1 - r.cs - 1))), 0.2) else 1.5 * agg.mn > 0.2 end as ok
   from r join lateral (select min(p.s) mn, max(p.s) mx from p where p.label = r.label and p.i = r.i + 1 and p.j >= r.cs) agg on true
   where agg.mn is not null) z)
select label::varchar as k, i, g as cluster from r""")
def chunk_maxmin_label(spark, sf_dir):
    return C.cluster_rows(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", fixed_threshold=0.2)


@query()
def chunk_maxmin_sentences(spark, sf_dir):
    return C.by_similarity(documents(spark, sf_dir)).select("chunk_id", "chunk_idx", "text")


def _boundaries() -> str:
    paras = _PARAS.format(x="text", sep="\\n\\s*\\n"), _PARAS.format(x="text", sep="\\n")
    return f"""with recursive q as (select doc_id, {paras[0]} as a, {paras[1]} as b from (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from documents where text is not null)),
p as (select doc_id, case when len(a) < 10 then b else a end as p from q),
u as (select doc_id, unnest(p) as x, generate_subscripts(p, 1) as k from p where len(p) > 0),
c as (select doc_id, k, lower(left(x, 1)) as f, sum(len(regexp_split_to_array(x, '\\s+')) + 2) over (partition by doc_id order by k) as c from u),
d as (select doc_id, list(f order by k) as f, list_prepend(0, list(c order by k)) as c from c group by doc_id),
r as (select doc_id, 0::bigint as step, 0::bigint as a, case when len(f) <= 5 then len(f) else -1 end::bigint as b from d
 union all
 select doc_id, step + 1, s, case when s >= len(f) - 5 then len(f)
   else (select case when e - s = 1 then e else coalesce(list_min(list_filter(range(s + 1, e), lambda k: f[k + 1] <> f[s + 1])), e - 1) end
         from (select coalesce(list_min(list_filter(range(s + 1, len(f)), lambda e: round_even(1.2 * (c[e + 1] - c[s + 1]), 0) >= 550)), len(f) - 1) as e)) end
 from (select r.doc_id, step, case when r.b < 0 then 0 else r.b end as s, d.f, d.c, r.b as last from r join d using (doc_id)) where last < len(f)),
o as (select doc_id, step - (min(step) over (partition by doc_id)) as i, a, b from r where b > a)
select doc_id::varchar || '_chunk_' || i as chunk_id, i::int as chunk_idx, array_to_string(p[a + 1:b], chr(10) || chr(10)) as text, a::int as para_start, (b - 1)::int as para_end from o join p using (doc_id)"""


@query(_boundaries())
def chunk_lumber_rule(spark, sf_dir):
    return C.by_model(documents(spark, sf_dir)).select("chunk_id", "chunk_idx", "text", F.col("metadata")["para_start"].cast("int").alias("para_start"), F.col("metadata")["para_end"].cast("int").alias("para_end"))


# --- rendered Markdown ---------------------------------------------------------------------------


def plans(spark, sf_dir) -> DataFrame:
    """One study plan a customer: an order is a semester, its lines are rows under a bold row a return flag."""
    li = table(spark, sf_dir, "lineitem")
    row = F.concat(F.lit("| Kurs "), "l_partkey", F.lit(" | Pnr. "), "l_suppkey", F.lit(" | "), F.col("l_quantity").cast("int"), F.lit(" LP | 2 SWS |"))
    per = li.groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("r")))).alias("rows"))
    part = F.concat(F.lit("| **Modul "), "l_returnflag", F.lit("** | **1 MP** | **2 SL** | |\n"), F.array_join(F.transform("rows", lambda s: s["r"]), "\n"))
    orders = per.select("l_orderkey", F.struct("l_returnflag", part.alias("t")).alias("p")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    text = F.concat(F.lit("### "), "l_orderkey", F.lit(". Semester\n*Summe: "), F.size("ps"), F.lit(" Module*\n\n| Modul | MP | LP | SWS |\n| :--- | :--- | :--- | :--- |\n"), F.array_join(F.transform("ps", lambda s: s["t"]), "\n"), F.lit("\n"))
    joined = table(spark, sf_dir, "orders").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    docs = joined.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", text.alias("t")))).alias("ts"))
    return docs.select(F.col("o_custkey").cast("string").alias("doc_id"), F.array_join(F.transform("ts", lambda s: s["t"]), "\n").alias("text"))


_PLAN_SQL = """with f as (select l_orderkey, l_returnflag, string_agg('| Kurs ' || l_partkey || ' | {pnr} ' || l_suppkey || ' | ' || l_quantity::int || ' {lp} | 2 {sws} |', chr(10) order by l_linenumber, '| Kurs ' || l_partkey || ' | {pnr} ' || l_suppkey || ' | ' || l_quantity::int) as rows from lineitem group by all),
b as (select l_orderkey, l_returnflag, '| **Modul ' || l_returnflag || '** | **1 {mp}** | **2 {sl}** | |' || chr(10) || rows as body from f)"""
_SHORT = {"pnr": "Pnr.", "lp": "LP", "sws": "SWS", "mp": "MP", "sl": "SL"}
_LONG = {"pnr": "Prüfungsnummer", "lp": "ECTS-Leistungspunkte", "sws": "Semesterwochenstunden", "mp": "Modulprüfung", "sl": "Studienleistung"}


@query(_PLAN_SQL.format(**_LONG) + """
select o_custkey::varchar as doc_id, (row_number() over (partition by o_custkey order by o_orderkey, l_returnflag) - 1)::int as chunk_idx,
 '### ' || o_orderkey || '. Semester' || chr(10) || chr(10) || body as text from b join orders on l_orderkey = o_orderkey""")
def chunk_split_po(spark, sf_dir):
    return TB.by_split_tables(plans(spark, sf_dir)).select("doc_id", "chunk_idx", "text")


@query(_PLAN_SQL.format(**_SHORT) + f""",
w as (select l_orderkey, count(*) as n, string_agg(body, chr(10) order by l_returnflag) as body from b group by 1)
select o_custkey::varchar as doc_id, (row_number() over (partition by o_custkey order by o_orderkey) - 1)::int as chunk_idx,
 '{TB.LEGEND}' || '### ' || o_orderkey || '. Semester' || chr(10) || '*Summe: ' || n || ' Module*' || chr(10) || '| Modul | MP | LP | SWS |' || chr(10) || '| :--- | :--- | :--- | :--- |' || chr(10) || body as text
from w join orders on l_orderkey = o_orderkey""")
def chunk_whole_table(spark, sf_dir):
    return TB.by_whole_tables(plans(spark, sf_dir)).select("doc_id", "chunk_idx", "text")


def _handbook(o) -> F.Column:
    return F.concat(F.lit("### Modul: M"), o, F.lit("\n**Lehrveranstaltungen und Lehrformen:** a: Kurs X"), o, F.lit(" (Seminar) / 12 | b: Kurs Y / 34<br>\n**Belegung:** Seminar (a) und (b)<br>\nEin Satz. Noch einer."))


@query("""with o as (select o_custkey, o_orderkey, unnest(range(4)) as j from orders)
select o_custkey::varchar as doc_id, (row_number() over (partition by o_custkey order by o_orderkey, j) - 1)::int as chunk_idx,
 case j when 0 then '### Modul: M' || o_orderkey || chr(10) || '**Lehrveranstaltungen und Lehrformen:** Kurs X' || o_orderkey || ' (Seminar): Kurs X' || o_orderkey || ' (Seminar) / 12 | Kurs Y: Kurs Y / 34<br>'
  when 1 then '### Modul: M' || o_orderkey || chr(10) || '**Belegung:** Seminar (Kurs X' || o_orderkey || ' (Seminar)) und (Kurs Y)<br>'
  when 2 then 'Ein Satz.' else 'Noch einer.' end as text from o""")
def chunk_split_mhb(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", _handbook(F.col("o_orderkey")).alias("t")))).alias("ts"))
    docs = o.select(F.col("o_custkey").cast("string").alias("doc_id"), F.array_join(F.transform("ts", lambda s: s["t"]), "\n").alias("text"))
    return TB.by_split_tables(docs).select("doc_id", "chunk_idx", "text")


@query("select p_partkey, '2 Semesterwochenstunden, ' || p_size || ' ECTS-Leistungspunkte, ECTS-Leistungspunkte, ECTS-Leistungspunkte, Modulprüfung, Studienleistung, Profilbildungsbereich, Prüfungsnummer ' || p_partkey as x from part")
def abbrev_expand(spark, sf_dir):
    x = F.concat(F.lit("2 SWS, "), "p_size", F.lit(" LP, ECTS-LP, LP, MP, SL, PBB, Pnr. "), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", T.expand_abbreviations(x).alias("x"))


@query("select p_partkey, 'Kurs ' || p_size || ' (Übung)' as a, p_brand as b from part")
def course_letters(spark, sf_dir):
    line = F.concat(F.lit("**Lehrveranstaltungen und Lehrformen:** a: alt / 1 | b: "), "p_brand", F.lit(" / 12 | a: Kurs "), "p_size", F.lit(" (Übung) / 345<br>"))
    m = T.course_map(line)
    return table(spark, sf_dir, "part").select("p_partkey", m["a"].alias("a"), m["b"].alias("b"))


# --- scalars -------------------------------------------------------------------------------------


@query("select doc_id, round_even(1.2 * len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 0)::int as approx, substring(sha256(text), 1, 16) as hash, doc_id::varchar as id from documents")
def text_scalars(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.approx_tokens(F.col("text")).alias("approx"), T.text_hash(F.col("text")).alias("hash"), T.doc_id_from_path(F.concat(F.lit("a/b.c/"), "doc_id", F.lit(".tar"))).alias("id"))


# --- preprocessing -------------------------------------------------------------------------------


@query("""with x as (select *, o_orderkey % 3 as m, (o_orderkey - o_orderkey % 3) as doc from orders),
p as (select doc, m + 1 as page, o_orderkey, case when o_shippriority_like then 0.1 else 0.5 end as y from (select *, o_orderstatus = 'F' as o_shippriority_like from x)),
l as (select *, lag(page) over w as pp, lag(y) over w as py from p window w as (partition by doc order by page, y)),
g as (select *, case when pp is not null and page = pp + 1 and py >= 0 and y < 0.25 then 0 else 1 end as new from l),
t as (select *, sum(new) over (partition by doc order by page, y) - 1 as table_index from g)
select doc::varchar as doc_id, table_index::int as table_index, min(page)::int as start_page, max(page)::int as end_page, array_to_string(list_concat(['h'], list(o_orderkey::varchar order by page, y)), ',') as cells from t group by doc, table_index""")
def table_stitch(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("m", F.col("o_orderkey") % 3)
    y = F.when(F.col("o_orderstatus") == "F", 0.1).otherwise(0.5)
    parts = o.select((F.col("o_orderkey") - F.col("m")).cast("string").alias("doc_id"), (F.col("m") + 1).cast("int").alias("page"), y.alias("y"), F.lit(0.9).alias("bottom"), F.lit(1.0).alias("height"), F.array(F.array(F.lit("h")), F.array(F.col("o_orderkey").cast("string"))).alias("rows"))
    return P.stitch_tables(parts).select("doc_id", "table_index", "start_page", "end_page", F.array_join(F.flatten("data"), ",").alias("cells"))


@query("select 'page_' || page_id as doc_id, url as source_path, 'raw_text' as preprocessor_name from pages")
def pages_to_documents(spark, sf_dir):
    return S.from_pages(table(spark, sf_dir, "pages")).select("doc_id", "source_path", "preprocessor_name")


_PAGE = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<head\\b.*?</head>|<!--.*?-->', '', 'g'), '(?i)</(p|div|li|tr|h[1-6]|section|article|ul|ol|table)>|<br\\s*/?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
    _PAGE = f"replace({_PAGE}, '{_entity}', '{_char}')"


@query(f"""select 'page_' || page_id as doc_id, url as source_path, 'raw_text' as preprocessor_name,
 array_to_string(list_filter(list_transform(string_split({_PAGE}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) as text from pages""")
def pages_to_text(spark, sf_dir):
    return S.from_pages(table(spark, sf_dir, "pages"))


def _cache(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("source_hash"), F.reverse("text").alias("text"))


@query("select doc_id::varchar as doc_id, doc_id % 3 <> 0 as cached, length(text)::int as n from documents")
def cache_hits(spark, sf_dir):
    docs, cache = documents(spark, sf_dir), _cache(spark, sf_dir)
    done, new = P.cached(docs, lambda d: d.withColumn("text", F.lower("text")), cache)
    fresh = new.select("doc_id", F.lit(False).alias("cached"))
    return done.select("doc_id", F.length("text").alias("n")).join(fresh, "doc_id", "left").select("doc_id", F.coalesce("cached", F.lit(True)).alias("cached"), "n")


@query("select doc_id::varchar as doc_id from documents where doc_id % 3 = 0")
def cache_misses(spark, sf_dir):
    return P.cached(documents(spark, sf_dir), lambda d: d, _cache(spark, sf_dir))[1].select("doc_id")


@query("select doc_id::varchar || '_markdown_direct_llm' as doc_id, '> ' || text as text from documents")
def preprocessor_chain(spark, sf_dir):
    steps = [lambda d: P.renamed(d.withColumn("text", F.concat(F.lit("> "), "text")), "markdown"), lambda d: P.rewrite(d, lambda t: t)]
    return P.chain(documents(spark, sf_dir), steps).select("doc_id", "text")


@query("select vec_id, case when vec_id % 2 = 0 then 'c0' else 'c0' || chr(10) || 'd' || label || chr(10) || 'c1' end as text from embeddings")
def interleave_tables(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("d", F.when(F.col("vec_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("d"), "label"))))
    return e.select("vec_id", P.interleave(F.array(F.lit("c0"), F.lit("c1")), F.col("d")).alias("text"))


# --- retrieval -----------------------------------------------------------------------------------

_TOPK = """with q as (select vec_id as query_id, 0 as variant, embedding::double[] as e from embeddings where vec_id % 100 = 0 {more}),
h as (select query_id, variant, c.vec_id as ordinal, round(list_cosine_similarity(c.embedding::double[], q.e), 9) as score from embeddings c, q),
k as (select *, row_number() over (partition by query_id, variant order by score desc, ordinal) as rank from h qualify rank <= 20)"""
_TWO = "union all select vec_id - 1, 1, embedding::double[] from embeddings where vec_id % 100 = 1"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ordinal"), "embedding", "label")


def _searched(spark, sf_dir, variants: int = 1):
    v = vectors(spark, sf_dir)
    q = v.where(F.col("ordinal") % 100 < variants).select((F.col("ordinal") - F.col("ordinal") % 100).alias("query_id"), (F.col("ordinal") % 100).cast("int").alias("variant"), "embedding")
    return R.top_k(v, q, 20)


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as squared, 1.0::double as unit from embeddings")
def l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("u", V.l2_normalize(F.col("embedding")))
    return e.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("embedding")), 4).alias("squared"), F.round(V.norm(F.col("u")), 6).alias("unit"))


@query(_TOPK.format(more="") + " select query_id, rank::int as rank, ordinal, round(score, 6) as score from k")
def topk_cosine(spark, sf_dir):
    return _searched(spark, sf_dir).select("query_id", "rank", "ordinal", F.round("score", 6).alias("score"))


@query("select q.vec_id as query_id, c.vec_id + 1 as rank, c.vec_id as ordinal, 1.0::double as retrieval_score from embeddings q, embeddings c where q.vec_id % 100 = 0")
def retrieve_all(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return R.all_chunks(v, v.where("ordinal % 100 = 0").select(F.col("ordinal").alias("query_id")))


@query(_TOPK.format(more=_TWO) + """, f as (select query_id, ordinal, sum(1.0::double / (60 + rank)) as rrf, min((variant, rank)) as first from k group by all)
select query_id, row_number() over (partition by query_id order by round(rrf, 12) desc, first)::int as rank, ordinal, round(rrf, 9) as retrieval_score from f qualify rank <= 20""")
def rrf_fusion(spark, sf_dir):
    return R.fuse(_searched(spark, sf_dir, 2), 20).select("query_id", "rank", "ordinal", F.round("retrieval_score", 9).alias("retrieval_score"))


_SCORED = _TOPK.format(more="") + ", s as (select query_id, rank, ordinal, score, round(score - 0.1 * (rank % 3), 9) as rr from k)"


def _reranked(spark, sf_dir):
    h = _searched(spark, sf_dir).withColumn("s", F.round(F.col("score") - 0.1 * (F.col("rank") % 3), 9))
    return h.select("query_id", F.lit("").alias("original_query"), "rank", "ordinal", F.col("score").alias("retrieval_score"), F.col("s").alias("text"))


@query(_SCORED + " select query_id, ordinal, nr as rank, round(rr, 6) as reranking_score from (select *, row_number() over (partition by query_id order by rr desc, rank)::int as nr from s where rr >= 0.1) where nr <= 5")
def rerank_threshold_topn(spark, sf_dir):
    out = R.rerank(_reranked(spark, sf_dir), lambda q, t: t.cast("double"), top_n=5, threshold=0.1)
    return out.select("query_id", "ordinal", "rank", F.round("reranking_score", 6).alias("reranking_score"))


@query(_SCORED + " select query_id, ordinal, rank::int as rank, round(score, 6) as reranking_score from s where rank <= 5")
def rerank_passthrough(spark, sf_dir):
    return R.keep_ranks(_reranked(spark, sf_dir), 5).select("query_id", "ordinal", "rank", F.round("reranking_score", 6).alias("reranking_score"))


def _users(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user' and text is not null")
    return c.select((F.col("conv_id") * 10_000 + F.col("turn")).alias("query_id"), F.col("text").alias("original_query"))


_USERS = "(select conv_id * 10000 + turn as query_id, text as q from conversations where role = 'user' and text is not null)"


@query(f"select query_id, q as processed, 'no_processing' as processor_name, 'query' as query_type from {_USERS}")
def noop_query(spark, sf_dir):
    return R.plain(_users(spark, sf_dir)).select("query_id", F.col("processed_queries")[0].alias("processed"), "processor_name", "query_type")


@query(f"select query_id, q || ' ' || q || ' ' || q || ' ' || q || ' ' || q || ' Gesucht: ' || q as processed, 'query' as query_type from {_USERS}")
def cot_query(spark, sf_dir):
    return R.reasoned(_users(spark, sf_dir)).select("query_id", F.col("processed_queries")[0].alias("processed"), "query_type")


@query(f"select query_id, 'Es gilt: ' || q as processed, 'document' as query_type from {_USERS}")
def hyde_query(spark, sf_dir):
    return R.hypothetical(_users(spark, sf_dir)).select("query_id", F.col("processed_queries")[0].alias("processed"), "query_type")


@query("select conv_id as query_id, count(*)::int as n, string_agg('Source ' || (i) || ':' || chr(10) || text, chr(10) order by turn) as context from (select *, row_number() over (partition by conv_id order by turn) as i from conversations) group by conv_id")
def context_string(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    hits = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), "text", F.lit(1.0).alias("reranking_score"))
    q = c.select(F.col("conv_id").alias("query_id"), F.lit("").alias("original_query")).distinct()
    return R.contexts(q, hits).select("query_id", F.size("retrieved_contexts").alias("n"), "context")


# --- evaluation ----------------------------------------------------------------------------------

_PAIRS = "(select conv_id, turn, text as a, lead(text) over (partition by conv_id order by turn) as b from conversations)"
_CLAIMS = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\W+'), lambda w: w <> ''))"


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("b")).where("b is not null")


@query(f"""with x as (select conv_id, turn, {_CLAIMS.format(x="a")} as a, {_CLAIMS.format(x="b")} as b from {_PAIRS} where a is not null and b is not null)
select conv_id, turn, round(case when len(a) + len(b) = 0 then 0 else len(list_intersect(a, b)) / (len(list_intersect(a, b)) + 0.5 * (len(a) + len(b) - 2 * len(list_intersect(a, b)))) end, 9)::double as f1,
 round(len(list_intersect(b, a)) / nullif(len(b), 0), 9)::double as recall from x""")
def token_f1(spark, sf_dir):
    x = _turns(spark, sf_dir).where("a is not null")
    return x.select("conv_id", "turn", F.round(E.token_f1(F.col("a"), F.col("b")), 9).alias("f1"), F.round(E.supported(F.col("b"), F.col("a")), 9).alias("recall"))


@query("select source, round(avg(quality), 9) as quality, round(avg(toxic), 9) as toxic, round(avg(nullif(n_chars % 7, 0)), 9) as n from documents join labels using (doc_id) group by source")
def metric_means(spark, sf_dir):
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("source", "quality", "toxic", F.when(F.col("n_chars") % 7 == 0, float("nan")).otherwise(F.col("n_chars") % 7).alias("n"))
    return E.means(x, ["source"]).select("source", *[F.round(c, 9).alias(c) for c in ("quality", "toxic", "n")])


@query("select avg(toxic)::double as negative_negative_rejection from labels")
def rejection_rate(spark, sf_dir):
    x = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, R.REFUSAL).otherwise("x").alias("response"))
    return E.means(E.evaluate_rejection(x), prefix="negative_")


@query("select lang, count(*) as num_chunks, round(avg(n), 9) as avg_chunk_tokens, (3 * greatest(1, floor(1500 / avg(n))))::int as top_k, greatest(1, floor(1500 / avg(n)))::int as top_n from (select lang, round_even(1.2 * len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 0)::int as n from documents) group by lang")
def retrieval_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = E.average_tokens(d, T.approx_tokens(F.col("text")), ["lang"]).join(d.groupBy("lang").agg(F.count("*").alias("num_chunks")), "lang")
    k, n = E.budget(F.col("avg_chunk_tokens"))
    return a.select("lang", "num_chunks", F.round("avg_chunk_tokens", 9).alias("avg_chunk_tokens"), k.alias("top_k"), n.alias("top_n"))


@query(_TOPK.format(more="") + ", t as (select unnest([0.0, 0.05, 0.1, 0.3])::double as threshold) select threshold, count(*) as kept, round(avg(score), 6) as mean_score from k, t where score >= threshold and rank <= 12 group by threshold")
def threshold_sweep(spark, sf_dir):
    h = _searched(spark, sf_dir).withColumnRenamed("score", "reranking_score")
    return E.sweep(h, [0.0, 0.05, 0.1, 0.3], 12).groupBy("threshold").agg(F.count("*").alias("kept"), F.round(F.avg("reranking_score"), 6).alias("mean_score"))


@query(f"""with g as (select 'paragraph' as chunker, s::double as p1, o::double as p2 from (values (1, 0), (2, 0), (2, 1), (3, 0)) v(s, o)
union all select 'character', s, o from (select unnest([500, 1000, 1500])::double as s, [0, 0.1] as f), lateral (select unnest([0, s * 0.1])::double as o)
union all select 'dynamic', s, o from (select unnest([150, 250, 500])::double as s), lateral (select unnest([0, s * 0.1])::double as o)
union all select 'maxmin', a, b from (select unnest([0.7, 0.75, 0.8])::double as a), (select unnest([1.2, 1.3, 1.4, 1.5])::double as b) where a + b > 1.9::double and a + b < 2.3::double),
p as (select text, {_PARAS.format(x="text", sep="\\n\\s*\\n")} as a, {_PARAS.format(x="text", sep="\\n")} as b from documents where text is not null),
n as (select length(text) as c, len(case when len(a) < 10 then b else a end) as k from p),
m as (select chunker, p1, p2, case chunker when 'character' then c when 'paragraph' then k end as items from n, g)
select chunker, p1, p2, (sum(case when items > 0 then greatest(0, ceil((items - p1) / (p1 - p2))) + 1 end))::bigint as num_chunks from m group by all""")
def param_grid(spark, sf_dir):
    """Every chunker's parameters, with the chunks that those of fixed windows make of the documents."""
    d = documents(spark, sf_dir).select(F.struct(F.length("text").alias("character"), F.size(T.paragraphs(F.col("text"))).alias("paragraph")).alias("n"))
    rows = PL.grids(spark).collect()
    each = d.select("n", F.explode(F.array(*[F.struct(F.lit(r.chunker).alias("chunker"), F.lit(r.p1).alias("p1"), F.lit(r.p2).alias("p2")) for r in rows])).alias("g")).select("n.*", "g.*")
    items = F.when(F.col("chunker") == "character", F.col("character")).when(F.col("chunker") == "paragraph", F.col("paragraph"))
    chunks = F.when(items > 0, F.greatest(F.lit(0), F.ceil((items - F.col("p1")) / (F.col("p1") - F.col("p2")))) + 1)
    return each.groupBy("chunker", "p1", "p2").agg(F.sum(chunks).cast("long").alias("num_chunks"))


@query("select source, round(avg(quality), 9) as answer_correctness from documents join labels using (doc_id) group by source order by avg(quality) desc, source limit 1")
def best_config(spark, sf_dir):
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("answer_correctness"))
    return E.best(x, order="source").select("source", F.round("answer_correctness", 9).alias("answer_correctness"))


@query("select 'a' as run, lang, count(*) as n, null::double as quality from documents group by lang union all select 'b', null, count(*), avg(quality)::double from labels")
def summary_union(spark, sf_dir):
    a = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).withColumn("run", F.lit("a"))
    b = table(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.avg("quality").alias("quality")).withColumn("run", F.lit("b"))
    return E.summary([a, b]).select("run", "lang", "n", "quality")


@query("select item_id as qa_idx, b.text as user_input, d.n_chars from benchmark b left join documents d on d.doc_id = b.item_id")
def qa_attach(spark, sf_dir):
    qa = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qa_idx"), F.col("text").alias("user_input"))
    return E.attach(qa, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qa_idx"), "n_chars"))


_EMBED = "(select {key}, list_transform(range(0, 64), lambda b: len(list_filter(h, lambda x: x = b))::double) as e from (select {key}, list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: ('0x' || substring(md5(w), 1, 6))::bigint % 64) as h from {src}))"


@query("""with c as (select row_number() over (order by doc_id::varchar, k) - 1 as ordinal, text from (select doc_id, k, substring(text, (k * 450 + 1)::bigint, 500) as text
 from (select doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 500) / 450.0))::bigint)) as k from documents where text <> ''))),
ce as """ + _EMBED.format(key="ordinal", src="c") + ", qe as " + _EMBED.format(key="item_id", src="benchmark") + """,
h as (select item_id, ordinal, row_number() over (partition by item_id order by round(list_cosine_similarity(ce.e, qe.e), 9) desc, ordinal) as rank from ce, qe qualify rank <= 15),
s as (select h.*, c.text, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda w: w <> '')), regexp_split_to_array(lower(c.text), '\\s+')))::double
   / nullif(len(list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\\s+'), lambda w: w <> ''))), 0) as rr from h join c using (ordinal) join benchmark b using (item_id)),
r as (select *, row_number() over (partition by item_id order by rr desc, rank) as nr from s where rr >= 0.1 qualify nr <= 5)
select b.item_id as query_id, count(r.nr)::int as n, coalesce(string_agg('Source ' || nr || ':' || chr(10) || r.text, chr(10) order by nr), '') as response from benchmark b left join r using (item_id) group by b.item_id""")
def rag_end_to_end(spark, sf_dir):
    chunks = S.with_ordinals(C.by_characters(documents(spark, sf_dir), 500, 50))
    embed = V.hash_embedder()
    index = chunks.select("ordinal", "chunk_id", "text", embed("text").alias("embedding"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("original_query"))
    online = PL.OnlinePipeline("NoProcessingProcessor", "FaissRetriever", "JinaReranker", "PassthroughGenerator", PL.Online(top_k=15, top_n=5, reranking_score_threshold=0.1))
    return online.batch(index, queries).select("query_id", F.size("retrieved_contexts").alias("n"), "response")


# --- sources, sinks and the cache ----------------------------------------------------------------


def _qa(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qa_idx"), F.col("text").alias("user_input"), F.reverse("text").alias("reference"))


@query("select row_number() over (order by item_id) - 1 as qa_idx, text as user_input, reverse(text) as reference from benchmark")
def qa_source(spark, sf_dir):
    """QA pairs of a JSON array file."""
    path = new_path(spark, "qa")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("qa_idx", "user_input", "reference"))), lambda s: F.struct(s["user_input"].alias("user_input"), s["reference"].alias("reference")))
    _qa(spark, sf_dir).agg(F.to_json(pairs).alias("value")).write.text(path)
    return S.qa_pairs(spark, path)


@query("select conv_id as qa_idx, text as user_input, 'r' || turn as reference, role as response, text || '|' || role as retrieved_contexts, turn + 0.5::double as reranking_scores from conversations where text is not null")
def results_sink(spark, sf_dir):
    c, path = table(spark, sf_dir, "conversations").where("text is not null"), new_path(spark, "results")
    S.write_results(c.select(F.col("conv_id").alias("qa_idx"), F.col("text").alias("user_input"), F.concat(F.lit("r"), "turn").alias("reference"), F.col("role").alias("response"), F.array("text", "role").alias("retrieved_contexts"), F.array(F.col("turn").cast("double"), F.lit(0.5)).alias("reranking_scores")), path)
    back = spark.read.schema(S.RESULTS).json(path)
    return back.withColumns({"retrieved_contexts": F.array_join("retrieved_contexts", "|"), "reranking_scores": F.col("reranking_scores")[0] + F.col("reranking_scores")[1]})


@query("select source as run_name, count(*) as num_chunks, max(n_chars) as top_k, null::bigint as phase from documents group by source union all select 'all', count(*), null, 2 from labels")
def summary_sink(spark, sf_dir):
    path = new_path(spark, "summary")
    a = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("run_name")).agg(F.count("*").alias("num_chunks"), F.max("n_chars").alias("top_k"))
    b = table(spark, sf_dir, "labels").agg(F.count("*").alias("num_chunks")).withColumns({"run_name": F.lit("all"), "phase": F.lit(2)})
    S.write_summary([a, b], path)
    return spark.read.csv(path, header=True, schema="run_name string, num_chunks long, top_k long, phase long")


@query("select conv_id as qa_idx, turn::double / 8 as answer_correctness, 'a \"b\", ' || role || chr(10) || 'c' as response, '[\"' || role || '\",\"x\"]' as retrieved_contexts from conversations")
def evaluation_sink(spark, sf_dir):
    path, c = new_path(spark, "evaluation"), table(spark, sf_dir, "conversations")
    S.write_evaluation(c.select(F.col("conv_id").alias("qa_idx"), (F.col("turn") / 8).alias("answer_correctness"), F.concat(F.lit('a "b", '), "role", F.lit("\nc")).alias("response"), F.array("role", F.lit("x")).alias("retrieved_contexts")), path)
    return spark.read.csv(path, header=True, multiLine=True, escape='"', schema="qa_idx long, answer_correctness double, response string, retrieved_contexts string")


@query("select doc_id::varchar as doc_id, substring(sha256(coalesce(text, '')), 1, 16) as text_hash, len(string_split(text, chr(10)))::int as n from documents where doc_id % 3 <> 0 and text is not null")
def boundary_sink(spark, sf_dir):
    """Boundaries of what was not cached, written and read back."""
    d = documents(spark, sf_dir).join(table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id")), "doc_id", "left_semi")
    found = d.select("doc_id", T.text_hash(F.col("text")).alias("text_hash"), F.array(F.size(F.split("text", "\n"))).alias("boundary_ids"), (F.col("doc_id") % 3 == 0).alias("cached"))
    return S.keep_boundaries(found, new_path(spark, "boundaries")).select("doc_id", "text_hash", F.col("boundary_ids")[0].alias("n"))


@query("select doc_id::varchar || '_chunk_0' as chunk_id, text, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) as unit, list_position(e, list_max(e))::int as top from (select doc_id, text, " + "list_transform(range(0, 64), lambda b: len(list_filter(h, lambda x: x = b))::double) as n, list_transform(n, lambda x: case when list_sum(list_transform(n, lambda y: y * y)) > 0 then x / sqrt(list_sum(list_transform(n, lambda y: y * y))) else 0 end) as e from (select doc_id, text, list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> ''), lambda w: ('0x' || substring(md5(w), 1, 6))::bigint % 64) as h from documents where text <> ''))")
def index_vectors(spark, sf_dir):
    """Whole documents as an index of unit vectors on disk, loaded again."""
    path = new_path(spark, "index")
    R.build_index(C.whole(documents(spark, sf_dir)), V.hash_embedder(), path)
    e = R.load_index(spark, path)
    return e.select("chunk_id", "text", F.round(V.norm(F.col("embedding")), 6).alias("unit"), F.array_position("embedding", F.array_max("embedding")).cast("int").alias("top"))


@query("select doc_id::varchar || '_chunk_0' as chunk_id, text from documents where text <> ''")
def index_passthrough(spark, sf_dir):
    return PL.component("PassthroughIndexBuilder")(C.whole(documents(spark, sf_dir)), new_path(spark, "index"), None).select("chunk_id", "text")


@query("select doc_id::varchar || '_raw_text' as doc_id, '> ' || coalesce(text, '') as text, case when doc_id % 2 = 0 then 2 else 1 end::bigint as runs from documents")
def cache_write_through(spark, sf_dir):
    """Half the documents, then all of them through one cache: what the first run wrote is not processed again."""
    folder, docs = new_path(spark, "cache"), documents(spark, sf_dir)
    step = lambda mark: lambda d: d.withColumn("text", F.concat(F.lit(mark), "text"))
    first = P.write_through(docs.where("doc_id % 2 = 0"), step("> "), folder, "raw_text")
    second = P.write_through(docs, lambda d: step("> ")(d.where("substring_index(doc_id, '.', -1) % 2 = 1")), folder, "raw_text")
    return first.unionByName(second).groupBy("doc_id", "text").agg(F.count("*").alias("runs"))


@query("""with x as (select doc_id // 3 as k, text, bool_or(doc_id % 2 = 0) over (partition by doc_id // 3, text) as early from documents)
select k || '_raw_text' as doc_id, (case when early then '> ' else '! ' end) || coalesce(text, '(none)') as text from x""")
def cache_repeated_ids(spark, sf_dir):
    """Three documents an id, null texts among them. A writer that is killed before it publishes is not seen, and what one run
    published the next one doesn't process again."""
    folder = new_path(spark, "cache")
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 3).cast("string").alias("doc_id"), F.lit("").alias("source_path"), "text", F.lit("").alias("preprocessor_name"), (F.col("doc_id") % 2 == 0).alias("early"))
    step = lambda mark: lambda d: d.withColumn("text", F.concat(F.lit(mark), F.coalesce("text", F.lit("(none)"))))
    P.write_through(docs.where("early").drop("early"), step("> "), folder, "raw_text")
    store = text_store(spark, f"{folder}/raw_text")
    store.stage(docs.select("doc_id", P.source_hash(F.col("text")).alias("source_hash"), F.lit("half written").alias("text")))
    store.compact()
    return P.write_through(docs.drop("early"), step("! "), folder, "raw_text").select("doc_id", "text")


# --- files and batch jobs ------------------------------------------------------------------------


def _text_files(spark, sf_dir) -> str:
    """All documents as files named by their ids."""
    folder = new_path(spark, "texts")
    S.write_texts(documents(spark, sf_dir).select(F.concat("doc_id", F.lit(".md.txt")).alias("name"), "text"), folder)
    return folder


@query("select doc_id::varchar || '.md' as doc_id, coalesce(text, '') as text from documents")
def path_documents(spark, sf_dir):
    return S.from_paths(spark, [_text_files(spark, sf_dir)]).select("doc_id", "text")


@query("select doc_id::varchar || '.md_gemini' as doc_id, reverse(coalesce(text, '')) as text from documents")
def text_cache_files(spark, sf_dir):
    """Converted texts from a folder of files named by the documents they belong to and a hash of their texts, as an id may be null or
    that of several documents."""
    key = F.concat(F.coalesce("id", F.lit("none")), F.lit("__"), T.text_hash(F.col("text")))
    docs, folder = documents(spark, sf_dir).withColumn("id", F.concat("doc_id", F.lit(".md"))).withColumn("doc_id", key), new_path(spark, "texts")
    S.write_texts(docs.select(F.concat("doc_id", F.lit("_gemini.txt")).alias("name"), F.reverse("text").alias("text")), folder)
    return S.converted(docs, S.text_cache(spark, folder), "gemini").select(F.concat("id", F.lit("_gemini")).alias("doc_id"), "text")


@query("select doc_id::varchar as doc_id, substring(sha256(coalesce(text, '')), 1, 16) as text_hash, (doc_id % 5)::int as a, length(coalesce(text, ''))::int as b, doc_id % 7 = 0 as cached from documents where doc_id % 3 > 0 or doc_id % 7 = 0")
def boundary_json_cache(spark, sf_dir):
    """JSON files of boundaries, a third of them broken or without the key, taken into the store beside rows it has already."""
    d = documents(spark, sf_dir).withColumn("text_hash", T.text_hash(F.col("text")))
    ids = F.array((F.col("doc_id") % 5).cast("int"), F.length("text"))
    broken = F.when(F.col("doc_id") % 2 == 0, F.lit("{broken")).otherwise(F.lit('{"other": 1}'))
    content = F.when(F.col("doc_id") % 3 > 0, F.to_json(F.struct(ids.alias("boundary_ids")))).otherwise(broken)
    files, folder = new_path(spark, "boundaries"), new_path(spark, "boundaries")
    S.write_texts(d.select(F.concat("doc_id", F.lit("__"), "text_hash", F.lit(".json")).alias("name"), content.alias("text")), files)
    S.keep_boundaries(d.where("doc_id % 7 = 0").select("doc_id", "text_hash", ids.alias("boundary_ids")), folder)
    rows = S.keep_boundaries(S.boundary_cache(spark, files), folder)
    return rows.select("doc_id", "text_hash", F.col("boundary_ids")[0].alias("a"), F.col("boundary_ids")[1].alias("b"), (F.col("doc_id") % 7 == 0).alias("cached"))


@query("""select c.*, (row_number() over (order by doc_id, chunk_idx) - 1) as ordinal from (select doc_id || '_raw_text' as doc_id, k::int as chunk_idx, substring(text, (k * 900 + 1)::bigint, 1000) as text
 from (select doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 1000) / 900.0))::bigint)) as k from documents where text <> '')) c""")
def yaml_pipeline(spark, sf_dir):
    """The offline pipeline as a YAML file describes it."""
    path = new_path(spark, "config")
    said = "offline_config:\n  chunking_params: {chunk_size: 1000, overlap: 100}\noffline_pipeline:\n  preprocessors: [RawTextProcessor]\n  chunker: FixedCharacterChunker\n  index_builder: PassthroughIndexBuilder\nonline_pipeline: {query_processor: NoProcessingProcessor, retriever: FaissRetriever, reranker: JinaReranker, generator: HuggingfaceGenerator}"
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(path)
    offline, _ = PL.from_config(S.load_yaml(path, spark))
    return offline.run(documents(spark, sf_dir), new_path(spark, "offline"))[1].select("doc_id", "chunk_idx", "text", "ordinal")


_LINES = f"array_to_string(list_filter(list_transform(string_split({_PAGE}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))"


@query(f"select (page_id // 8)::bigint as file, count(*)::int as pages, string_agg(case when t = '' then '' else t || chr(10) end, '' order by page_id) as text from (select page_id, {_LINES} as t from pages) group by page_id // 8")
def paged_files(spark, sf_dir):
    """Pages written as files of eight, read page by page, cleaned, and put together as documents again."""
    folder = new_path(spark, "paged")
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 8).alias("file"), F.struct("page_id", F.concat(F.coalesce("html", F.lit("")), F.lit("\f")).alias("html")).alias("p"))
    files = pages.groupBy("file").agg(F.array_sort(F.collect_list("p")).alias("p"))
    S.write_texts(files.select(F.concat(F.lit("file="), "file", F.lit(".txt")).alias("name"), F.array_join("p.html", "").alias("text")), folder)
    back = read_pages(spark, [folder], run_bytes=1 << 16).withColumn("text", P.html_to_text(F.col("text")))
    docs = pages_as_documents(back, "raw_text", F.max("page").alias("pages"))
    return docs.select(F.regexp_extract("source_path", "file=([0-9]+)", 1).cast("long").alias("file"), "pages", "text")


_MARKS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(coalesce(html, ''), chr(10), ' '), '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<head\\b.*?</head>|<!--.*?-->', '', 'g'), '(?i)<li>', chr(10) || '- ', 'g'), '(?i)<h1>', chr(10) || '# ', 'g'), '(?i)</?(p|div|li|h1|article|section|ul|nav|footer|body)\\b[^>]*>|<br>', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _entity, _char_of in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
    _MARKS = f"replace({_MARKS}, '{_entity}', '{_char_of}')"


@query(f"select 'page_' || page_id || '_markdown_docling' as doc_id, array_to_string(list_filter(list_transform(string_split({_MARKS}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10) || chr(10)) as text from pages")
def layout_markdown(spark, sf_dir):
    """Pages as Markdown by the layout model."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), "page_id").alias("doc_id"), F.col("url").alias("source_path"), F.coalesce("html", F.lit("")).alias("text"), F.lit("").alias("preprocessor_name"))
    return PL.component("DoclingMarkdownProcessor")(pages).select("doc_id", "text")


@query("select p_partkey, case when p_size % 5 = 0 then '' else 'A: ' || p_size || '; B: ' || p_type || '.' end as description, 1::bigint as plans, 1::bigint as submissions from part")
def table_batch_jobs(spark, sf_dir):
    """Descriptions by batch jobs. The first program dies while it collects; the second one goes on and sends nothing again."""
    data, folder = F.array(F.array(F.lit("A"), F.lit("B")), F.array(F.col("p_size").cast("string"), "p_type")), new_path(spark, "jobs")
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(0).alias("table_index"), P.table_prompt(F.col("p_brand"), data).alias("prompt"))

    def some(prompt):
        if int(prompt.split('["')[2].split('"')[0]) % 5 == 0:
            raise RuntimeError("no answer")
        return P.describe(prompt)

    first = J.Jobs(t, folder, lambda: J.Direct(some), 300)
    first.plan(), first.submit()
    second = J.Jobs(t, folder, lambda: J.Direct(some), 300)
    out = second.run(0.0)
    return out.select(F.col("doc_id").cast("long").alias("p_partkey"), "description", F.lit(len(second.planned.commits())).cast("long").alias("plans"), F.lit(len(second.submitted.commits())).cast("long").alias("submissions"))


@query("select p_partkey, case when p_size % 7 in (3, 5, 6) then '' else p_partkey || ' after ' || (p_size % 7) end as description from part")
def overload_retries(spark, sf_dir):
    """A model that is overloaded for up to six calls a prompt: five attempts are made, other errors are not repeated."""
    calls: dict[str, int] = {}

    def busy(prompt):
        n, most = calls.get(prompt, 0), int(prompt.split("/")[1]) % 7
        calls[prompt] = n + 1
        if most == 3:
            raise ValueError("400 bad request")
        if n < most:
            raise RuntimeError("503 overloaded")
        return f"{prompt.split('/')[0]} after {n}"

    t = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(0).alias("table_index"), F.concat_ws("/", "p_partkey", "p_size").alias("prompt"))
    return P.batch_describe(t, P.with_retries(busy, wait=lambda s: None)).select(F.col("doc_id").cast("long").alias("p_partkey"), "description")


@query("select doc_id::varchar || '_markdown_gemini' as doc_id, text, 'markdown_gemini' as preprocessor_name from documents where text is not null")
def preconverted_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("source_path"), "text", F.lit("").alias("preprocessor_name"))
    return PL.component("GeminiMarkdownProcessor")(d).select("doc_id", "text", "preprocessor_name")


@query("""with o as (select *, o_orderkey % 3 as m from orders)
select (o_orderkey - m)::varchar || '_paper_llm_processor' as doc_id, string_agg('vor ' || o_orderkey || chr(10) || 'A: ' || o_orderstatus || '; B: ' || o_custkey || '. A: x.', chr(10) order by o_orderkey) || chr(10) || 'nach' as text from o group by o_orderkey - m""")
def paper_tables(spark, sf_dir):
    """Texts with tables through the table-describing preprocessor."""
    o = table(spark, sf_dir, "orders").withColumn("m", F.col("o_orderkey") % 3)
    part = F.concat(F.lit("vor "), "o_orderkey", F.lit("\n| A | B |\n| :-- | --- |\n| **"), "o_orderstatus", F.lit("** | "), "o_custkey", F.lit(" |\n| x | |"))
    g = o.groupBy((F.col("o_orderkey") - F.col("m")).cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("t")))).alias("ts"))
    docs = g.select("doc_id", F.lit("").alias("source_path"), F.concat(F.array_join(F.transform("ts", lambda s: s["t"]), "\n"), F.lit("\nnach")).alias("text"), F.lit("").alias("preprocessor_name"))
    return PL.component("PaperLLMProcessor")(docs).select("doc_id", "text")


@query("""select p_partkey, 'Describe this table in full sentences.' || chr(10) || 'Caption: ' || p_brand || chr(10) || 'Rows: [["A","B"],["' || p_size || '","' || p_type || '"]]' as prompt,
 case when p_size % 5 = 0 then '' else 'A: ' || p_size || '; B: ' || p_type || '.' end as description from part""")
def table_descriptions(spark, sf_dir):
    """Prompts of tables and a model's descriptions, empty where the request fails."""
    data = F.array(F.array(F.lit("A"), F.lit("B")), F.array(F.col("p_size").cast("string"), "p_type"))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(0).alias("table_index"), P.table_prompt(F.col("p_brand"), data).alias("prompt"))

    def some(prompt):
        if int(prompt.split('["')[2].split('"')[0]) % 5 == 0:
            raise RuntimeError("no answer")
        return P.describe(prompt)

    return t.join(P.batch_describe(t, some), "doc_id").select(F.col("doc_id").cast("long").alias("p_partkey"), "prompt", "description")


@query("select doc_id::varchar || '_direct_llm' as doc_id, text from (select o_custkey as doc_id, string_agg('Plan ' || o_orderkey || chr(10) || 'Status: ' || o_orderstatus || '; Preis: ' || o_custkey || '.', chr(10) order by o_orderkey) as text from orders group by o_custkey)")
def linearized_tables(spark, sf_dir):
    row = F.concat(F.lit("## Plan "), "o_orderkey", F.lit("\n| Status | Preis |\n|---|:-:|\n| "), "o_orderstatus", F.lit(" | "), "o_custkey", F.lit(" |"))
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("t")))).alias("ts"))
    return P.rewrite(g.select("doc_id", F.lit("").alias("source_path"), F.array_join(F.transform("ts", lambda s: s["t"]), "\n").alias("text"), F.lit("").alias("preprocessor_name"))).select("doc_id", "text")


@query("""with c as (select conv_id, turn, role = 'user' as t, coalesce(text, '') as text, sum((role = 'user')::int) over (partition by conv_id order by turn) - (role = 'user')::int as gap,
  min(turn) filter (role = 'user') over (partition by conv_id order by turn rows between 1 following and unbounded following) as nt from conversations),
d as (select *, coalesce((nt - turn) * 30 <= 50, false) as cap from c),
n as (select conv_id, sum(t::int)::int as n from c group by conv_id),
k as (select conv_id, n, unnest(range(0, n + 1)) as gap from n),
x as (select k.conv_id, k.n, k.gap, coalesce(string_agg(d.text, chr(10) order by d.turn) filter (where not d.t and not d.cap), '') as context, coalesce(string_agg(d.text, ' ' order by d.turn) filter (where not d.t and d.cap), '') as caption
 from k left join d on d.conv_id = k.conv_id and d.gap = k.gap group by all)
select conv_id::varchar as doc_id, n as n_tables, string_agg(context, '#' order by gap) as contexts, coalesce(string_agg(caption, '#' order by gap) filter (where gap < n), '') as captions from x group by conv_id, n""")
def page_text_contexts(spark, sf_dir):
    """Conversations as pages: a user's turn is a table, all others are text, 30 units apart."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), (F.col("turn") * 30.0).alias("y"), F.when(F.col("role") == "user", "table").otherwise("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    return P.page_contexts(c).select("doc_id", F.size("captions").alias("n_tables"), F.array_join("contexts", "#").alias("contexts"), F.array_join("captions", "#").alias("captions"))


# --- scalar rules --------------------------------------------------------------------------------


@query("select doc_id, len(l)::int - (l[len(l)] = '')::int as n_lines, l[1] as first from (select doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') as l from documents where text is not null)")
def split_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null").withColumn("l", T.lines(F.col("text")))
    return d.select("doc_id", F.size("l").alias("n_lines"), F.coalesce(F.get("l", F.lit(0)), F.lit("")).alias("first"))


@query("select p_partkey, case when p_partkey % 3 = 0 then null else p_size end as id from part")
def boundary_answers(spark, sf_dir):
    answer = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("none, ID "), "p_size")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("Well. ANSWER:  id "), "p_size", F.lit(". Answer: ID 7"))).otherwise(F.concat(F.lit("answer: ID"), "p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", T.boundary_answer(answer).alias("id"))


@query("select vec_id, round(list_cosine_similarity(embedding::double[], reverse(embedding)::double[]), 6) as cosine, round(1 / (1 + exp(-embedding[1]::double)), 9) as sigmoid from embeddings".replace("reverse(embedding)", "list_reverse(embedding)"))
def vector_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("cosine"), F.round(V.sigmoid(F.col("embedding")[0].cast("double")), 9).alias("sigmoid"))


# --- generation, evaluation and pipelines --------------------------------------------------------


def _full(question: str, context: str) -> str:
    return f"""'{R.SYSTEM}' || chr(10) || '{R.OTHERWISE} "{R.REFUSAL}"' || chr(10) || chr(10) || 'Frage: ' || {question} || chr(10) || 'Kontext: ' || {context} || chr(10) || chr(10) || 'Antwort:'"""


@query(f"select conv_id, turn, {_full("text", "role")} as prompt from conversations where text is not null")
def full_prompts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", R.full_prompt(F.col("text"), F.col("role")).alias("prompt"))


def _contexts(spark, sf_dir) -> DataFrame:
    q = _users(spark, sf_dir)
    hits = q.where("query_id % 3 > 0").select("query_id", F.lit(1).alias("rank"), F.reverse("original_query").alias("text"), F.lit(1.0).alias("reranking_score"))
    return R.contexts(q, hits)


@query(f"select query_id, case when query_id % 3 > 0 then reverse(q) else '{R.REFUSAL}' end as response from {_USERS}")
def generator_default(spark, sf_dir):
    return R.answer(_contexts(spark, sf_dir)).select("query_id", "response")


@query(f"select query_id, 'n' || length({_full("q", "c")}) as response from (select query_id, q, case when query_id % 3 > 0 then 'Source 1:' || chr(10) || reverse(q) else '' end as c from {_USERS})")
def generator_halving(spark, sf_dir):
    """A model that only takes three prompts at once: larger batches are halved."""

    def small(prompts):
        if len(prompts) > 3:
            raise MemoryError
        return [f" n{len(p)}\n" for p in prompts]

    return R.answer(_contexts(spark, sf_dir), small).select("query_id", "response")


_EVAL = f"""with t as (select conv_id, turn, {_CLAIMS.format(x="a")} as a, {_CLAIMS.format(x="b")} as b from {_PAIRS} where a is not null and b is not null),
x as (select conv_id, turn, a, b, len(list_intersect(a, b)) as n from t)"""


@query(_EVAL + " select conv_id, turn, round(case when len(a) + len(b) = 0 then 0 else n / (n + 0.5 * (len(a) + len(b) - 2 * n)) end, 9)::double as answer_correctness, round(n / nullif(len(a), 0), 9)::double as context_recall, round(n / nullif(len(b), 0), 9)::double as faithfulness, round(case when least(len(a), len(b)) = 0 then 0 else n / sqrt(len(a) * len(b)) end, 9)::double as answer_relevancy from x")
def evaluate_full(spark, sf_dir):
    t = _turns(spark, sf_dir).where("a is not null")
    rows = t.select("conv_id", "turn", F.col("a").alias("user_input"), F.col("a").alias("reference"), F.col("b").alias("response"), F.array("b").alias("retrieved_contexts"))
    # the contexts are the response for recall and the reference for faithfulness
    recall = E.evaluate(rows).select("conv_id", "turn", "answer_correctness", "context_recall", "answer_relevancy")
    faith = E.evaluate(rows.withColumn("retrieved_contexts", F.array("reference"))).select("conv_id", "turn", "faithfulness")
    return recall.join(faith, ["conv_id", "turn"]).select("conv_id", "turn", *[F.round(c, 9).alias(c) for c in ("answer_correctness", "context_recall", "faithfulness", "answer_relevancy")])


@query(_EVAL + " select conv_id, turn, round(case when len(a) + len(b) = 0 then 0 else n / (n + 0.5 * (len(a) + len(b) - 2 * n)) end, 9)::double as answer_correctness from x")
def evaluate_only_correctness(spark, sf_dir):
    t = _turns(spark, sf_dir).where("a is not null").select("conv_id", "turn", F.col("a").alias("reference"), F.col("b").alias("response"))
    return E.evaluate_minimal(t).select("conv_id", "turn", F.round("answer_correctness", 9).alias("answer_correctness"))


@query("select 0::bigint as query_id, 0::int as rank, 0::bigint as ordinal, 0.0::double as score where false")
def search_without_queries(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return R.top_k(v, v.where("false").select(F.col("ordinal").alias("query_id"), F.lit(0).alias("variant"), "embedding"), 20).select("query_id", "rank", "ordinal", "score")


@query("select unnest(['raw_text', 'markdown_docling', 'markdown_gemini', 'direct_llm', 'paper_llm_processor']) as name, (select count(*) from documents where text is not null) as n")
def component_names(spark, sf_dir):
    """The registry's preprocessors over all documents, by the names that they leave in the documents' ids."""
    docs = documents(spark, sf_dir).join(table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id")).distinct(), "doc_id", "left_semi")
    done = [PL.component(f"{n}Processor")(docs) for n in ("RawText", "DoclingMarkdown", "GeminiMarkdown", "DirectLLM", "PaperLLM")]
    every = E.summary(done)
    return every.where(F.expr("endswith(doc_id, '_' || preprocessor_name)")).groupBy(F.col("preprocessor_name").alias("name")).agg(F.count("*").alias("n")).select("name", "n")


@query("""select c.*, (row_number() over (order by doc_id, chunk_idx) - 1) as ordinal from (select doc_id || '_raw_text' as doc_id, k::int as chunk_idx, substring(text, (k * 1000 + 1)::bigint, 1000) as text
 from (select doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 1000) / 1000.0))::bigint)) as k from documents where text <> '')) c""")
def offline_pipeline(spark, sf_dir):
    offline = PL.OfflinePipeline(["RawTextProcessor"], "FixedCharacterChunker", "PassthroughIndexBuilder", PL.Offline({"chunk_size": 1000, "overlap": 0}))
    return offline.run(documents(spark, sf_dir), new_path(spark, "offline"))[1].select("doc_id", "chunk_idx", "text", "ordinal")


def _first_words(name: str, condition: str) -> str:
    return f"""with c as (select row_number() over (order by doc_id::varchar) - 1 as ordinal, text from documents where text <> ''),
q as (select row_number() over (order by item_id) - 1 as query_id, text as q from benchmark {condition}),
ce as {_EMBED.format(key="ordinal", src="c")}, qe as {_EMBED.format(key="query_id", src="(select query_id, q as text from q)")},
h as (select query_id, ordinal from ce, qe qualify row_number() over (partition by query_id order by round(list_cosine_similarity(ce.e, qe.e), 9) desc, ordinal) <= 1)
select h.query_id, 'Source 1:' || chr(10) || c.text as {name} from h join c using (ordinal)"""


def _answers(spark, sf_dir, ask) -> DataFrame:
    offline = PL.OfflinePipeline(["RawTextProcessor"], "PassthroughChunker", "FaissIndexBuilder", PL.Offline())
    index = offline.run(documents(spark, sf_dir), new_path(spark, "online"))[1]
    online = PL.OnlinePipeline("NoProcessingProcessor", "FaissRetriever", "PassthroughReranker", "PassthroughGenerator", PL.Online(top_k=1, top_n=1))
    texts = [r.text for r in table(spark, sf_dir, "benchmark").orderBy("item_id").collect()]  # the query set, not the corpus
    return ask(online, index, texts)


@query(_first_words("response", ""))
def multiple_queries(spark, sf_dir):
    return _answers(spark, sf_dir, lambda online, index, texts: online.multiple(index, texts)).select("query_id", "response")


@query(_first_words("response", "qualify query_id = 0"))
def online_query(spark, sf_dir):
    return _answers(spark, sf_dir, lambda online, index, texts: online.query(index, texts[0])).select("query_id", "response")


@query("""with c as (select 'c' || s as run_name, s, unnest(generate_series(0, greatest(0, ceil((length(text) - s) / s::double))::bigint)) as k, text from documents, (select unnest([500, 1500]) as s) where text <> ''),
n as (select run_name, round_even(1.2 * len(list_filter(regexp_split_to_array(substring(text, (k * s + 1)::bigint, s), '\\s+'), lambda w: w <> '')), 0)::int as n from c)
select run_name, count(*) as num_chunks, round(avg(n), 1) as avg_chunk_tokens, greatest(1, floor(1500 / avg(n)))::int as top_n, 0.0::double as negative_negative_rejection from n group by run_name""")
def experiment_runs(spark, sf_dir):
    """Two runs of an experiment over all documents, with negative questions; the default generator answers from the best chunk."""
    runs = [{"name": f"c{s}", "preprocessors": ["RawTextProcessor"], "chunker": "FixedCharacterChunker", "params": {"chunk_size": s, "overlap": 0}, "threshold": None} for s in (500, 1500)]
    out = PL.run_experiment(documents(spark, sf_dir), _qa(spark, sf_dir), runs, new_path(spark, "runs"), negative=_qa(spark, sf_dir))
    return out.select("run_name", "num_chunks", "avg_chunk_tokens", "top_n", "negative_negative_rejection")


_TOKENS = "round_even(1.2 * len(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')), 0)::int"
_DISTINCT = "list_distinct(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''))"


def _experiment(sizes: list[int], runs: str, columns: str, budget: str = "greatest(1, floor(1500 / avg(n)))::int as top_n, 3 * greatest(1, floor(1500 / avg(n)))::int as top_k", docs: str = "documents", reference: str = "b.text", suffix: str = "_raw_text") -> str:
    """Runs over windows of ``sizes`` characters: search by hashed words, rerank by overlap, answer from the best chunk, score. ``runs`` selects
    (run, s, p, threshold); p is 0, 1 or 2 for the three query processors."""
    return f"""with w as (select unnest({sizes}) as s),
c as materialized (select s, row_number() over (partition by s order by id, k) - 1 as ordinal, text, {_TOKENS.format(x="text")} as n from (select s, doc_id::varchar || '{suffix}' as id, k, substring(text, (k * s + 1)::bigint, s) as text
 from (select s, doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - s) / s::double))::bigint)) as k from {docs}, w where text <> ''))),
z as (select s, count(*) as num_chunks, {budget} from c group by s),
q as (select item_id * 3 + p as id, case p when 0 then text when 1 then 'Es gilt: ' || text else text || ' ' || text || ' ' || text || ' ' || text || ' ' || text || ' Gesucht: ' || text end as text from benchmark, range(3) t(p)),
ce as materialized {_EMBED.format(key="s, ordinal", src="c")}, qe as materialized {_EMBED.format(key="id", src="q")},
v as (select * from ({runs})),
h as materialized (select s, id // 3 as item_id, id % 3 as p, ordinal, row_number() over (partition by s, id order by round(list_cosine_similarity(ce.e, qe.e), 9) desc, ordinal) as rank from ce, qe where id % 3 in (select p from v)),
m as (select h.*, c.text, len(list_intersect({_DISTINCT.format(x="b.text")}, regexp_split_to_array(lower(c.text), '\\s+')))::double / nullif(len({_DISTINCT.format(x="b.text")}), 0) as rr
 from h join z using (s) join c on c.s = h.s and c.ordinal = h.ordinal join benchmark b on b.item_id = h.item_id where rank <= top_k),
t as (select run, m.s, item_id, m.text, row_number() over (partition by run, m.s, item_id order by rr desc, rank) as nr from m join v on v.s = m.s and v.p = m.p where rr >= threshold),
a as (select v.run, v.s, b.item_id, {reference} as reference, coalesce(any_value(t.text) filter (where nr = 1), '{R.REFUSAL}') as response, coalesce(string_agg(t.text, ' ' order by nr) filter (where nr <= top_n), '') as ctx
 from v join z using (s) cross join benchmark b left join t on t.run = v.run and t.s = v.s and t.item_id = b.item_id group by v.run, v.s, b.item_id, b.text),
f as (select run, s, response, {_CLAIMS.format(x="response")} as x, {_CLAIMS.format(x="reference")} as y, {_CLAIMS.format(x="ctx")} as k from a),
g as (select run, s, response = '{R.REFUSAL}' as rejected, case when len(x) + len(y) = 0 then 0 else len(list_intersect(x, y)) / (len(list_intersect(x, y)) + 0.5 * (len(x) + len(y) - 2 * len(list_intersect(x, y)))) end as f1, len(list_intersect(y, k)) / nullif(len(y), 0) as recall from f)
{columns}"""


_SCORES = "select 'raw__c' || s || '__' || run as run_name, any_value(num_chunks) as num_chunks, any_value(z.top_k)::int as top_k, round(avg(f1), 6)::double as answer_correctness, round(avg(recall), 6)::double as context_recall from g join z using (s) group by s, run"


def _windows(sizes) -> list[tuple]:
    return [("raw", ["RawTextProcessor"], f"c{s}", "FixedCharacterChunker", {"chunk_size": s, "overlap": 0}) for s in sizes]


def _scores(spark, sf_dir, runs) -> DataFrame:
    qa = _qa(spark, sf_dir).withColumn("reference", F.col("user_input"))
    out = PL.run_experiment(documents(spark, sf_dir), qa, runs, new_path(spark, "runs"))
    return out.select("run_name", "num_chunks", "top_k", F.round("answer_correctness", 6).alias("answer_correctness"), F.round("context_recall", 6).alias("context_recall"))


@query(_experiment([500, 1500], "select run, s, p, 0.05 as threshold from (values ('no_processing', 0), ('hyde', 1), ('cot', 2)) r(run, p), w", _SCORES))
def query_experiment(spark, sf_dir):
    """All query processors over each index, as variants of one search."""
    return _scores(spark, sf_dir, PL.query_runs([(*c, 0.05) for c in _windows((500, 1500))]))


@query(_experiment([500, 1500], "select run, s, 0 as p, threshold from (values ('thr00', 0.0), ('thr005', 0.05), ('thr01', 0.1)) r(run, threshold), w", _SCORES))
def context_experiment(spark, sf_dir):
    """All thresholds over each index, as variants of one search and one reranking."""
    return _scores(spark, sf_dir, PL.context_runs(_windows((500, 1500))))


@query(_experiment([500, 1000, 1500], "select 'chunk_size' || s || '_overlap0' as run, s, 0 as p, 0.1 as threshold from w", _SCORES.replace("'raw__c' || s || '__'", "'raw__character__'")))
def grid_search(spark, sf_dir):
    """The character chunker's sizes without overlap as a grid search."""
    grid = {"character": [{"chunk_size": s, "overlap": 0} for s in (500, 1000, 1500)]}
    return _scores(spark, sf_dir, PL.grid_runs([("raw", ["RawTextProcessor"], "character", "FixedCharacterChunker")], grid))


@query(_first_words("response", ""))
def queries_in_halves(spark, sf_dir):
    """A retriever that takes few questions at once and a reranker that takes few pairs at once: all questions are answered."""

    def retriever(index, q, embed, k):
        if q.count() > 16:
            raise MemoryError("too many questions")
        return R.retrieve(index, q, embed, k)

    def reranker(hits, n, threshold):
        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            if len(x) > 5:
                raise MemoryError("too many pairs")
            return x

        return R.keep_ranks(hits.coalesce(1).withColumn("retrieval_score", score("retrieval_score")), n)

    PL.register("SmallRetriever", retriever)
    PL.register("SmallReranker", reranker)
    offline = PL.OfflinePipeline(["RawTextProcessor"], "PassthroughChunker", "FaissIndexBuilder", PL.Offline())
    index = offline.run(documents(spark, sf_dir), new_path(spark, "online"))[1]
    online = PL.OnlinePipeline("NoProcessingProcessor", "SmallRetriever", "SmallReranker", "PassthroughGenerator", PL.Online(top_k=1, top_n=1))
    w = Window.orderBy("qa_idx")  # the query set, not the corpus
    qa = _qa(spark, sf_dir).withColumn("qa_idx", F.row_number().over(w).cast("long") - 1)
    return PL.run_queries(online, index, qa).select(F.col("qa_idx").alias("query_id"), "response")


_PHASES = "select case when run = 'x' then 'docling_only' else 'gemini_only' end as run_name, 1 as phase, round(avg(f1), 6)::double as answer_correctness from g group by run"


@query(_experiment([1500], "select run, s, 0 as p, 0.1 as threshold from (values ('x'), ('y')) r(run), w", _PHASES, suffix="_markdown_docling", reference="reverse(b.text)")
       + " union all " + "select run_name, 2, round(avg(f1), 6)::double from (select unnest(['docling_only_direct_llm', 'paper_llm']) as run_name), g where run = 'x' group by run_name")
def preprocessing_phases(spark, sf_dir):
    """The two-phase experiment: equal first runs, so the first wins and goes on. The documents have no tables or headings, so the second
    phase's preprocessors leave their words as they are."""
    docs = documents(spark, sf_dir)
    out = PL.two_phases(docs, _qa(spark, sf_dir), new_path(spark, "phases"), "FixedCharacterChunker", {"chunk_size": 1500, "overlap": 0})
    return out.select("run_name", "phase", F.round("answer_correctness", 6).alias("answer_correctness"))


_MAIN = "3 as top_n, 9 as top_k"


@query(_experiment([1500], "select 'x' as run, s, 0 as p, 0.0 as threshold from w", "select 'positive' as kind, count(*) as n, round(avg(f1), 6)::double as score from g union all select 'negative', count(*), round(avg(rejected::int), 6)::double from g", _MAIN, reference="reverse(b.text)"))
def main_program(spark, sf_dir):
    """The main program over all documents: how many questions of each kind were evaluated, and their scores."""
    config = {"offline_config": {"chunking_params": {"chunk_size": 1500, "overlap": 0}}, "online_config": {"top_k": 9, "top_n": 3, "reranking_score_threshold": 0.0}, "offline_pipeline": {"preprocessors": ["RawTextProcessor"], "chunker": "FixedCharacterChunker", "index_builder": "FaissIndexBuilder"}, "online_pipeline": {"query_processor": "NoProcessingProcessor", "retriever": "FaissRetriever", "reranker": "JinaReranker", "generator": "HuggingfaceGenerator"}}
    a, b = PL.run_main(config, documents(spark, sf_dir), _qa(spark, sf_dir), _qa(spark, sf_dir), new_path(spark, "main"))
    count = lambda df, kind, score: df.where(F.col(score).isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("score")).select(F.lit(kind).alias("kind"), "n", "score")
    return count(a, "positive", "answer_correctness").unionByName(count(b, "negative", "negative_rejection"))
