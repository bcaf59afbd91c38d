"""Index, retrieval, fusion, reranking and context assembly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import vectors as V
from quarry.sources.shared import bounded, written

RRF_K = 60
#: Queries and chunks in a matrix product, and bytes of query vectors sent to every task at once.
QUERY_BLOCK, QUERY_BYTES = 2048, 64 << 20
#: Fixed value: the answer where the context has none.
REFUSAL = "Dazu enthalten die bereitgestellten Dokumente keine Informationen."
#: The generator's instruction and the frame of its prompt.
SYSTEM = "Du bist ein hilfreicher Assistent. Beantworte die Frage basierend auf dem gegebenen Kontext."
BRIEF = "Halte dich kurz und gib nur die Informationen, nach denen gefragt wurde."
OTHERWISE = "Wenn die Antwort nicht im Kontext zu finden ist, antworte:"
QUESTION, CONTEXT, ANSWER, SOURCE = "Frage: ", "Kontext: ", "Antwort:", "Source "


# --- index ---------------------------------------------------------------------------------------


def build_index(chunks: DataFrame, embed: Callable[[Column], Column] | None, path: str) -> DataFrame:
    """Write chunks, with unit embeddings where ``embed`` is given, and read them back; no chunks are an error."""
    out = chunks
    if embed is not None:
        bounded(chunks.sparkSession)
        out = chunks.withColumn("_raw", embed(F.col("text"))).withColumn("embedding", V.l2_normalize(F.col("_raw"))).drop("_raw")
    out.write.mode("overwrite").parquet(path)
    index = load_index(chunks.sparkSession, path)
    if index.isEmpty():
        raise ValueError("cannot build an index from no chunks")
    return index


def load_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- queries -------------------------------------------------------------------------------------


def plain(queries: DataFrame) -> DataFrame:
    return _augmented(queries, F.array("original_query"), "no_processing", "query")


def hypothetical(queries: DataFrame, write: Callable[[Column], Column] = lambda q: F.concat(F.lit("Es gilt: "), q)) -> DataFrame:
    """The generator's made-up answer takes the query's place and is embedded as a document."""
    return _augmented(queries, F.array(write(F.col("original_query"))), "hyde", "document")


def reasoned(queries: DataFrame, think: Callable[[Column], Column] = lambda q: F.concat(F.lit("Gesucht: "), q), repeats: int = 5) -> DataFrame:
    """The query ``repeats`` times and the generator's rationale, as one query."""
    text = F.concat_ws(" ", F.array_join(F.array_repeat("original_query", repeats), " "), think(F.col("original_query")))
    return _augmented(queries, F.array(text), "cot", "query")


def _augmented(queries: DataFrame, processed: Column, name: str, kind: str) -> DataFrame:
    return queries.select("query_id", "original_query", processed.alias("processed_queries"), F.lit(name).alias("processor_name"), F.lit(kind).alias("query_type"))


# --- search --------------------------------------------------------------------------------------


def top_k(chunks: DataFrame, queries: DataFrame, k: int | str = 20, ordinal: str = "ordinal", vector: str = "embedding") -> DataFrame:
    """(query_id, variant, rank, ordinal, score): exact cosine top-k of ``queries(query_id, variant, embedding)``.

    A task scores its chunks against blocks of queries in matrix products and keeps the best k of each query over all its
    batches, so a task passes on at most k rows a query. Up to QUERY_BYTES of query vectors are sent to every task and served
    by one pass over the chunks; more are written once and take further passes. Equal scores (to 9 digits) are ranked by ordinal.
    """
    rank = F.row_number().over(Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "ordinal"))
    out = partial_top_k(chunks, queries, k, ordinal, vector)
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "variant", "rank", "ordinal", "score")


def partial_top_k(chunks: DataFrame, queries: DataFrame, k: int, ordinal: str = "ordinal", vector: str = "embedding") -> DataFrame:
    """(query_id, variant, ordinal, score): the best k of each query in each task."""
    bounded(chunks.sparkSession)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("variant").cast("int").alias("variant"), F.col("embedding").cast("array<double>").alias("e"))
    src = chunks.where(F.col(vector).isNotNull()).select(F.col(ordinal).cast("long").alias("ordinal"), F.col(vector).cast("array<double>").alias("v"))
    schema = pa.schema([("query_id", pa.int64()), ("variant", pa.int32()), ("ordinal", pa.int64()), ("score", pa.float64())])
    first, passes = asked.limit(QUERY_BLOCK + 1).toArrow(), 1
    if first.num_rows > QUERY_BLOCK:
        asked = written(asked, "queries")
        passes = -(-asked.count() * len(first["e"][0]) * 8 // QUERY_BYTES)
    out = None
    for p in range(passes):
        t = first if first.num_rows <= QUERY_BLOCK else asked.where(F.pmod(F.xxhash64("query_id", "variant"), F.lit(passes)) == p).toArrow()
        q = t["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) if t.num_rows else np.empty((0, 0))
        sent = chunks.sparkSession.sparkContext.broadcast((t["query_id"].to_numpy(), t["variant"].to_numpy(), _unit(q)))

        def run(batches, sent=sent):
            ids, variants, q = sent.value
            best = [Best(k, len(x)) for x in (q[a : a + QUERY_BLOCK] for a in range(0, len(q), QUERY_BLOCK))]
            for b in batches:
                if not b.num_rows or not len(q):
                    continue
                v, o = b.column("v").flatten().to_numpy().reshape(b.num_rows, -1), b.column("ordinal").to_numpy()
                for r in range(0, len(v), QUERY_BLOCK):
                    unit = _unit(v[r : r + QUERY_BLOCK])
                    for n, x in enumerate(best):
                        x.add(np.round(unit @ q[n * QUERY_BLOCK : (n + 1) * QUERY_BLOCK].T, 9), o[r : r + QUERY_BLOCK])
            for n, x in enumerate(best):
                j = x.query + n * QUERY_BLOCK
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids[j], variants[j], x.ordinal, x.score), schema)], schema=schema)

        part = src.mapInArrow(run, "query_id long, variant int, ordinal long, score double")
        out = part if out is None else out.unionByName(part)
    return out


class Best:
    """The best k ordinals of each of n queries so far, by score and, among equals, the smaller ordinal."""

    def __init__(self, k: int, n: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.query, self.score, self.ordinal = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def add(self, s: np.ndarray, ordinal: np.ndarray) -> None:
        """Take in scores (a row an ordinal, a column a query); only those that can still be among the best are sorted."""
        near = s >= self.floor
        if len(s) > self.k:
            near &= s >= np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k]
        j, i = np.nonzero(near.T)
        if not len(j):
            return
        j, s, o = np.r_[self.query, j], np.r_[self.score, s[i, j]], np.r_[self.ordinal, ordinal[i]]
        order = np.lexsort((o, -s, j))
        j, s, o = j[order], s[order], o[order]
        place = np.arange(len(j)) - np.searchsorted(j, j)
        full = place == self.k - 1
        self.floor[j[full]] = s[full]
        keep = place < self.k
        self.query, self.score, self.ordinal = j[keep], s[keep], o[keep]


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def all_chunks(chunks: DataFrame, queries: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Every chunk for every query in storage order with score 1: the baseline without retrieval."""
    return queries.select("query_id").join(chunks.select(ordinal)).select("query_id", (F.col(ordinal) + 1).alias("rank"), F.col(ordinal).alias("ordinal"), F.lit(1.0).alias("retrieval_score"))


def fuse(hits: DataFrame, k: int, key: str = "ordinal") -> DataFrame:
    """Reciprocal rank fusion of each query's variants; with one variant the hits keep their cosine.

    A chunk shows once a query. Ties go to the one seen first, by variant and rank.
    """
    g = hits.groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("rrf"), F.min(F.struct("variant", "rank", "score")).alias("first"))
    n = hits.groupBy("query_id").agg(F.count_distinct("variant").alias("variants"))
    x = g.join(n, "query_id").withColumn("retrieval_score", F.when(F.col("variants") == 1, F.col("first.score")).otherwise(F.col("rrf")))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(F.when(F.col("variants") == 1, -F.col("first.rank")).otherwise(F.col("rrf")), 12)), "first.variant", "first.rank"))
    return x.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", key, "retrieval_score")


def retrieve(chunks: DataFrame, augmented: DataFrame, embed: Callable[[Column], Column], k: int) -> DataFrame:
    """Top-k of every processed query of each row, fused; queries without any have no hits."""
    q = augmented.select("query_id", F.posexplode("processed_queries").alias("variant", "q")).withColumn("embedding", embed(F.col("q")))
    return fuse(top_k(chunks, q, k), k)


# --- reranking -----------------------------------------------------------------------------------


def overlap_score(query: Column, text: Column) -> Column:
    """Default pair scorer: the share of the query's distinct lower-cased words that the text has."""
    a = F.array_distinct(F.filter(F.split(F.lower(query), "\\s+"), lambda w: w != ""))
    b = F.split(F.lower(text), "\\s+")
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_score, top_n: int | None = 5, threshold: float | None = 0.1) -> DataFrame:
    """All ``hits(query_id, original_query, rank, text, ...)`` scored, those at least at ``threshold`` (None: off)
    sorted by score, ties by rank, and cut to ``top_n`` (None: all)."""
    x = hits.withColumn("reranking_score", scorer(F.col("original_query"), F.col("text")))
    if threshold is not None:
        x = x.where(F.col("reranking_score") >= threshold)
    x = x.withColumn("new", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reranking_score"), "rank")))
    return (x if top_n is None else x.where(F.col("new") <= top_n)).drop("rank").withColumnRenamed("new", "rank")


def keep_ranks(hits: DataFrame, top_n: int | None) -> DataFrame:
    x = hits.withColumn("reranking_score", F.col("retrieval_score"))
    return x if top_n is None else x.where(F.col("rank") <= top_n)


# --- generation ----------------------------------------------------------------------------------


def contexts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, original_query, context, retrieved_contexts, reranking_scores); empty without hits."""
    g = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text", "reranking_score"))).alias("h"))
    x = queries.select("query_id", "original_query").join(g, "query_id", "left").withColumn("h", F.coalesce("h", F.array().cast(g.schema["h"].dataType)))
    parts = F.transform("h", lambda s, i: F.concat(F.lit(SOURCE), i + 1, F.lit(":\n"), s["text"]))
    return x.select("query_id", "original_query", F.array_join(parts, "\n").alias("context"), F.transform("h", lambda s: s["text"]).alias("retrieved_contexts"), F.transform("h", lambda s: s["reranking_score"]).alias("reranking_scores"))


def system_prompt() -> str:
    return f"{SYSTEM} {BRIEF} {OTHERWISE} '{REFUSAL}'"


def full_prompt(query: Column, context: Column) -> Column:
    """What a generator without a system role gets: instruction, refusal sentence, question and context."""
    head = f'{SYSTEM}\n{OTHERWISE} "{REFUSAL}"\n\n{QUESTION}'
    return F.concat(F.lit(head), query, F.lit(f"\n{CONTEXT}"), context, F.lit(f"\n\n{ANSWER}"))


def answer_context(ctx: DataFrame) -> DataFrame:
    return ctx.withColumn("response", F.col("context"))


def answer(ctx: DataFrame, generate: Callable[[list[str]], list[str]] | None = None, batch: int = 64) -> DataFrame:
    """Answers by a batched model (stripped) to ``full_prompt``; a batch out of memory is halved. Without a model, and without context, the refusal."""
    if generate is None:
        return ctx.withColumn("response", F.when(F.col("context") == "", F.lit(REFUSAL)).otherwise(F.element_at(F.col("retrieved_contexts"), 1)))
    kind = ctx.withColumn("response", F.lit("")).schema

    def halve(prompts):
        try:
            return generate(prompts)
        except MemoryError as e:
            if len(prompts) == 1:
                raise RuntimeError("one prompt is too large for the model") from e
            m = len(prompts) // 2
            return halve(prompts[:m]) + halve(prompts[m:])

    def run(batches):
        for pdf in batches:
            p = pdf["_prompt"].tolist()
            yield pdf.drop(columns="_prompt").assign(response=[a.strip() for k in range(0, len(p), batch) for a in halve(p[k : k + batch])])

    return ctx.withColumn("_prompt", full_prompt(F.col("original_query"), F.col("context"))).mapInPandas(run, kind)
