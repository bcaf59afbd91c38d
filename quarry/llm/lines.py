"""Line deduplication by how many distinct sites a line spreads over."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import every, fresh, quoted, written

MIN_SITES, LG_K = 10, 12
#: Estimates within this factor of the threshold are counted exactly; the sketch's standard error is under 2 %.
BAND = 1.25
#: Bound on the lines sent to every executor.
HOT_LINES = 5_000
_WS = " \\t\\n\\x0B\\f\\r"


def _rows(docs: DataFrame, site: str) -> DataFrame:
    """One row per line that has a word: the document's key, place, site and two hashes of the trimmed line."""
    line = F.regexp_replace("l.line", f"^[{_WS}]+|[{_WS}]+$", "")
    split = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    rows = docs.select(_key("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), F.explode(split).alias("l"))
    return rows.select("key", "doc_id", "site", F.col("l.pos").alias("pos"), line.alias("line")).where("line <> ''").select("key", "doc_id", "site", "pos", F.struct(F.xxhash64("line").alias("x"), F.hash("line").alias("y")).alias("h"))


def _key(name: str):
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias(name)


def _of(rows: DataFrame, some: DataFrame, total: int) -> DataFrame:
    """``rows`` joined with ``some(h, n, ..)``, of which n is how many rows have h. Lines that hold over 1 / HOT_LINES of all
    rows are fewer than HOT_LINES, so they are sent to every executor and their rows never meet in one task; the
    others' rows are joined by hash."""
    hot = F.col("n") > total // HOT_LINES
    rest = rows.join(F.broadcast(some.where(hot).select("h")), "h", "left_anti").join(some.where(~hot), "h")
    return rows.join(F.broadcast(some.where(hot)), "h").unionByName(rest)


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h, first, n) of ``_rows``: the lines on ``min_sites`` distinct sites or more, where each is first and how often it is.

    Lines are counted first: only those met ``min_sites`` times can be on so many sites. For these, one HyperLogLog sketch
    a line hash is built on the map side and merged by the aggregation; lines whose estimate is near the threshold get an
    exact distinct count.
    """
    total = rows.count()
    often = rows.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos", "key")).alias("first")).where(F.col("n") >= min_sites)
    often = written(often, "often")
    spread = _of(rows.select("h", "site"), often.select("h", "n"), total).groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"))
    spread = written(often.join(spread, "h"), "spread")
    sure = spread.where(F.col("estimate") > min_sites * BAND).select("h", "first", "n")
    near = spread.where(F.col("estimate").between(min_sites / BAND - 1, min_sites * BAND)).select("h", "first", "n")
    pairs = _of(rows.select("h", "site"), near.select("h", "n"), total).select("h", "site").distinct()
    exact = pairs.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= min_sites)
    return sure.unionByName(near.join(exact.select("h"), "h").select("h", "first", "n"))


def _hits(rows: DataFrame, min_sites: int) -> DataFrame:
    """The rows of boilerplate lines."""
    return _of(rows, written(boilerplate(rows, min_sites), "boilerplate"), rows.count())


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", keep_first: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text``, plus n_lines and n_removed (in place of columns so named).

    Lines are split at ``\\n`` and compared without surrounding white space; lines without a word are
    never removed. A line on ``min_sites`` or more distinct values of ``site`` (null: one site of
    its own) is removed everywhere but, with ``keep_first``, at its first place by doc_id and
    position: groups of copies keep their text once. A null text stays null; every row stays, with
    its other columns. Lines are cut once, into a table of hashes and positions; texts move once.
    """
    key, drop = fresh(docs, "_key"), fresh(docs, "_drop")
    out = _marked(docs, min_sites, site, keep_first, key, drop)
    size = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(size).cast("long").alias("n_lines")
    kept = [_stripped(drop) if c == "text" else F.col(quoted(c)) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return out.select(*kept, n, F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_removed"))


def strip_lines(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", keep_first: bool = True) -> DataFrame:
    """As ``dedup_lines``, with the columns of ``docs`` and no others; a column n_chars follows the text."""
    key, drop = fresh(docs, "_key"), fresh(docs, "_drop")
    out = _marked(docs, min_sites, site, keep_first, key, drop)
    text = _stripped(drop)
    size = F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")) if "n_chars" in docs.columns else None
    return out.select(*[text if c == "text" else size.alias(c) if c == "n_chars" else F.col(quoted(c)) for c in docs.columns])


def _marked(docs: DataFrame, min_sites: int, site: str, keep_first: bool, key: str, drop: str) -> DataFrame:
    """``docs`` with each text's lines to drop, null if none; ``key`` and ``drop`` are names that docs doesn't have."""
    hits = _hits(written(_rows(docs, site), "lines"), min_sites)
    if keep_first:
        hits = hits.where(~(F.col("first.key").eqNullSafe(F.col("key")) & (F.col("first.pos") == F.col("pos"))))
    gone = hits.groupBy(F.col("key").alias(key)).agg(F.collect_set("pos").alias(drop))
    return docs.select(*every(docs), _key(key)).join(gone, key, "left")


def _stripped(drop: str):
    """The text without the lines at ``drop``; the set difference keeps order and takes time linear in the lines."""

    def kept(lines):
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(drop))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    text = F.transform(F.array(F.split("text", "\n")), kept)[0]  # the lines are bound once
    return F.when(F.col(drop).isNull(), F.col("text")).otherwise(text).alias("text")


def oracle(min_sites: int = MIN_SITES) -> str:
    """DuckDB SQL for the query over ``documents``, with exact distinct counts throughout."""
    return f"""
with l as (select doc_id, coalesce(source, '') as site, unnest(string_split(text, chr(10))) as line,
                  generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
t as (select doc_id, site, line, pos, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from l),
b as (select bare, min((doc_id, pos)) as first from t where bare <> '' group by bare having count(distinct site) >= {min_sites}),
m as (select t.*, b.bare is not null and (t.doc_id, t.pos) <> b.first as gone from t left join b using (bare))
select d.doc_id, coalesce(count(m.pos), 0) as n_lines, coalesce(sum(m.gone::int), 0)::bigint as n_removed,
       coalesce(string_agg(m.line, chr(10) order by m.pos) filter (where not m.gone), '') as text
from documents d left join m using (doc_id) group by d.doc_id"""
