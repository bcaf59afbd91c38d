"""Registry, configuration, the offline and online pipelines and the experiments over them."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarry.functions import text as T, vectors as V
from quarry.operators import chunk as C, evaluate as E, preprocess as P, retrieve as R, tables as TB
from quarry.sources import tables as S
from quarry.sources.shared import written


@dataclass
class Offline:
    chunking_params: dict = field(default_factory=dict)
    embedding_model: str = "hash"


@dataclass
class Online:
    top_k: int = 20
    top_n: int = 5
    reranking_score_threshold: float | None = 0.1
    embedding_model: str = "hash"
    generation_model: str = "none"


#: Component names as configurations spell them. Models behind them are replaceable.
COMPONENTS: dict[str, Callable] = {
    "RawTextProcessor": lambda docs: P.renamed(docs, "raw_text"),
    "DoclingMarkdownProcessor": P.by_layout,
    "GeminiMarkdownProcessor": lambda docs: P.preconverted(docs, "markdown_gemini"),
    "DirectLLMProcessor": P.rewrite,
    "PaperLLMProcessor": P.paper,
    "FixedParagraphChunker": C.by_paragraphs,
    "FixedCharacterChunker": C.by_characters,
    "LumberChunker": C.by_model,
    "MaxMinChunker": C.by_similarity,
    "DynamicTokenChunker": C.by_sentences,
    "PassthroughChunker": C.whole,
    "WholeTableParagraphChunker": TB.by_whole_tables,
    "SplitTableParagraphChunker": TB.by_split_tables,
    "FaissIndexBuilder": lambda chunks, path, embed: R.build_index(chunks, embed, path),
    "PassthroughIndexBuilder": lambda chunks, path, embed: R.build_index(chunks, None, path),
    "NoProcessingProcessor": R.plain,
    "HyDEQueryProcessor": R.hypothetical,
    "CoTQueryProcessor": R.reasoned,
    "FaissRetriever": lambda index, q, embed, k: R.retrieve(index, q, embed, k),
    "PassthroughRetriever": lambda index, q, embed, k: R.all_chunks(index, q),
    "PassthroughReranker": lambda hits, n, threshold: R.keep_ranks(hits, n),
    "JinaReranker": lambda hits, n, threshold: R.rerank(hits, top_n=n, threshold=threshold),
    "PassthroughGenerator": R.answer_context,
    "HuggingfaceGenerator": R.answer,
}


#: What the preprocessors add to a document's id, and the names of their caches.
SUFFIXES = {"RawTextProcessor": "raw_text", "DoclingMarkdownProcessor": "markdown_docling", "GeminiMarkdownProcessor": "markdown_gemini", "DirectLLMProcessor": "direct_llm", "PaperLLMProcessor": "paper_llm_processor"}


def cached_component(name: str, folder: str) -> Callable:
    """The preprocessor ``name`` behind a text cache in ``folder``."""
    suffix, make = SUFFIXES.get(name, name), component(name)

    def under_own_id(docs: DataFrame) -> DataFrame:
        return make(docs).withColumn("doc_id", F.expr(f"substr(doc_id, 1, length(doc_id) - {len(suffix) + 1})"))

    return lambda docs: P.write_through(docs, under_own_id, folder, suffix)


def component(name: str) -> Callable:
    if name not in COMPONENTS:
        raise ValueError(f"unknown component: {name}")
    return COMPONENTS[name]


def register(name: str, make: Callable) -> None:
    """Add or replace a component, such as one with a real model."""
    COMPONENTS[name] = make


class OfflinePipeline:
    """documents -> preprocessors -> chunks -> index on disk; with ``cache``, a folder, texts are processed once."""

    def __init__(self, preprocessors: list[str], chunker: str, index_builder: str, config: Offline, embed=None, cache: str | None = None):
        if not preprocessors:
            raise ValueError("at least one preprocessor is required")
        self.names = [*preprocessors, chunker, index_builder]
        self.steps = [component(p) if cache is None else cached_component(p, cache) for p in preprocessors]
        params = dict(config.chunking_params)
        if chunker == "MaxMinChunker":
            params.setdefault("model", config.embedding_model)
        self.chunk = lambda docs: component(chunker)(docs, **params)
        self.build, self.embed = component(index_builder), embed or V.hash_embedder()

    def describe(self) -> str:
        return " -> ".join(self.names)

    def run(self, docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
        """(processed documents, index). The index has the chunks with ordinals in document order."""
        done = P.chain(docs, self.steps)
        return done, self.build(S.with_ordinals(self.chunk(done)), path, self.embed)


class OnlinePipeline:
    """queries -> processed -> hits -> reranked -> answers, one plan for any number of queries."""

    def __init__(self, query_processor: str, retriever: str, reranker: str, generator: str, config: Online, embed=None):
        self.names = [query_processor, retriever, reranker, generator]
        self.process, self.retrieve, self.rerank, self.generate = map(component, self.names)
        self.config, self.embed = config, embed or V.hash_embedder()

    def batch(self, index: DataFrame, queries: DataFrame) -> DataFrame:
        """``queries(query_id, original_query)`` -> with context, retrieved_contexts, reranking_scores, response."""
        return self.respond(queries, self.keep(self.with_texts(index, queries, self.search(index, queries))))

    def search(self, index: DataFrame, queries: DataFrame) -> DataFrame:
        return self.retrieve(index, self.process(queries), self.embed, self.config.top_k)

    def with_texts(self, index: DataFrame, queries: DataFrame, hits: DataFrame) -> DataFrame:
        return hits.join(index.select("ordinal", "chunk_id", "text"), "ordinal").join(queries, "query_id")

    def keep(self, hits: DataFrame) -> DataFrame:
        return self.rerank(hits, self.config.top_n, self.config.reranking_score_threshold)

    def respond(self, queries: DataFrame, kept: DataFrame) -> DataFrame:
        return self.generate(R.contexts(queries, kept))

    def query(self, index: DataFrame, text: str) -> DataFrame:
        return self.batch(index, index.sparkSession.createDataFrame([(0, text)], "query_id bigint, original_query string"))

    def multiple(self, index: DataFrame, texts: list[str]) -> DataFrame:
        """Answers to several texts, numbered from 0, by one plan."""
        return self.batch(index, index.sparkSession.createDataFrame(list(enumerate(texts)), "query_id bigint, original_query string"))


def from_config(config: dict, embed=None) -> tuple[OfflinePipeline, OnlinePipeline]:
    off, on = config.get("offline_config", {}), config.get("online_config", {})
    a, b = config["offline_pipeline"], config["online_pipeline"]
    offline = OfflinePipeline(a["preprocessors"], a["chunker"], a["index_builder"], Offline(**off), embed, config.get("cache"))
    online = OnlinePipeline(b["query_processor"], b["retriever"], b["reranker"], b["generator"], Online(embedding_model=off.get("embedding_model", "hash"), **on), embed)
    return offline, online


def pipeline_name(offline: OfflinePipeline, online: OnlinePipeline) -> str:
    return "_".join(n[:6] for n in [*offline.names, *online.names])


def run_name(prep: str, chunker: str, processor: str | None = None, threshold: float | None = None, params: dict | None = None) -> str:
    last = processor.lower().replace("queryprocessor", "").replace("processor", "") if processor else f"thr{threshold}".replace(".", "") if threshold is not None else "_".join(f"{k}{v}" for k, v in (params or {}).items())
    return f"{prep}__{chunker}__{last}"


# --- experiments ---------------------------------------------------------------------------------

#: The query processors and the thresholds that the experiments compare.
PROCESSORS = {"no_processing": "NoProcessingProcessor", "hyde": "HyDEQueryProcessor", "cot": "CoTQueryProcessor"}
THRESHOLDS = [0.0, 0.05, 0.1]


def query_runs(configs: list[tuple[str, list[str], str, str, dict, float]]) -> list[dict]:
    """The query experiment: every (preprocessing label, preprocessors, chunker label, chunker, params, threshold) with each processor."""
    return [{"name": run_name(a, c, processor=label), "preprocessors": p, "chunker": chunker, "params": params, "threshold": t, "query_processor": q} for a, p, c, chunker, params, t in configs for label, q in PROCESSORS.items()]


def context_runs(configs: list[tuple[str, list[str], str, str, dict]], thresholds: list[float] = THRESHOLDS) -> list[dict]:
    """The context experiment: every configuration at each threshold."""
    return [{"name": run_name(a, c, threshold=t), "preprocessors": p, "chunker": chunker, "params": params, "threshold": t} for a, p, c, chunker, params in configs for t in thresholds]


def grid_runs(specs: list[tuple[str, list[str], str, str]], grid: dict[str, list[dict]], threshold: float = 0.1) -> list[dict]:
    """The grid search: every (preprocessing label, preprocessors, chunker label, chunker) with each of the chunker's parameters."""
    return [{"name": run_name(a, c, params=params), "preprocessors": p, "chunker": chunker, "params": params, "threshold": threshold} for a, p, c, chunker in specs for params in grid[c]]


def grids(spark: SparkSession) -> DataFrame:
    """(chunker, p1, p2): the parameter grid of every chunker, 4 + 6 + 6 + 10 rows."""
    rows = [("paragraph", float(s), float(o)) for s, overlaps in ((1, [0]), (2, [0, 1]), (3, [0])) for o in overlaps]
    for name, sizes in (("character", (500, 1000, 1500)), ("dynamic", (150, 250, 500))):
        rows += [(name, float(s), float(o)) for s in sizes for o in (0, round(0.1 * s))]
    maxmin = spark.createDataFrame(list(itertools.product((0.7, 0.75, 0.8), (1.2, 1.3, 1.4, 1.5))), "p1 double, p2 double")
    maxmin = maxmin.where("p1 + p2 > 1.9 and p1 + p2 < 2.3").select(F.lit("maxmin").alias("chunker"), "p1", "p2")
    return spark.createDataFrame(rows, "chunker string, p1 double, p2 double").unionByName(maxmin)


def answered(online: OnlinePipeline, index: DataFrame, qa: DataFrame) -> DataFrame:
    """``qa(qa_idx, user_input, reference)`` with the pipeline's response, retrieved_contexts and reranking_scores."""
    queries = qa.select(F.col("qa_idx").alias("query_id"), F.col("user_input").alias("original_query"))
    got = online.batch(index, queries).withColumnRenamed("query_id", "qa_idx")
    return E.attach(qa, got.select("qa_idx", "response", "retrieved_contexts", "reranking_scores"))


def out_of_memory(e: BaseException) -> bool:
    """An error of a model that its batch was too large for, whether raised here or in a task."""
    return isinstance(e, MemoryError) or any(x in str(e) for x in ("MemoryError", "OutOfMemory", "out of memory"))


def in_halves(ids: DataFrame, act: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], tag: str, depth: int = 0) -> DataFrame:
    """``act(mine)``, written, where ``mine`` takes a part of any table with a query_id; a part that runs out of memory is halved (by
    a hash of the id), down to single ids of ``ids``. Parts start as halves of halves, ``depth`` times.

    Halves that are done stay done. One question that is too large by itself, or any other error, fails the query.
    """

    def solve(bits: tuple) -> list[DataFrame]:
        def mine(rows: DataFrame) -> DataFrame:
            return rows.where(reduce(and_, [F.getbit(F.xxhash64("query_id"), F.lit(k)) == b for k, b in enumerate(bits)])) if bits else rows

        if len(bits) >= depth:
            if bits and mine(ids).isEmpty():
                return []
            try:
                return [written(act(mine), tag)]
            except Exception as e:
                if not out_of_memory(e) or len(bits) > 63:
                    raise
                if mine(ids).distinct().limit(2).count() < 2:
                    raise RuntimeError("one question is too large for the pipeline") from e
        return [x for side in (0, 1) for x in solve((*bits, side))]

    return E.summary(solve(()) or [written(act(lambda rows: rows), tag)])


def run_queries(online: OnlinePipeline, index: DataFrame, qa: DataFrame, batching: bool = True) -> DataFrame:
    """``answered``, written; where a part of the pipeline runs out of memory, that part takes the questions in halves (``in_halves``).
    Without ``batching`` they start as eighths.

    Search, reranking and generation are halved each by itself, over what the part before has written: the index is searched as
    often as the retriever asks for, whatever the others can take, and its texts are read once.
    """
    depth = 0 if batching else 3
    queries = written(qa.select(F.col("qa_idx").alias("query_id"), F.col("user_input").alias("original_query")), "questions")
    ids = queries.select("query_id")
    hits = in_halves(ids, lambda mine: online.search(index, mine(queries)), "found", depth)
    hits = written(online.with_texts(index, queries, hits), "hits")
    kept = in_halves(ids, lambda mine: online.keep(mine(hits)), "kept", depth)
    got = in_halves(ids, lambda mine: online.respond(mine(queries), mine(kept)), "responses", depth).withColumnRenamed("query_id", "qa_idx")
    return written(E.attach(qa, got.select("qa_idx", "response", "retrieved_contexts", "reranking_scores")), "answers")


def run_main(config: dict, docs: DataFrame, positive: DataFrame, negative: DataFrame, folder: str, embed=None) -> tuple[DataFrame, DataFrame]:
    """The configured pipelines over answerable and unanswerable questions: results and evaluations are written below ``folder``.

    Returns the answer correctness of each positive and the rejection of each negative question.
    """
    offline, online = from_config(config, embed)
    name = pipeline_name(offline, online)
    index = offline.run(docs, f"{folder}/index/{name}")[1]
    out = []
    for kind, qa, judge in (("positive", positive, E.evaluate_minimal), ("negative", negative, E.evaluate_rejection)):
        path = f"{folder}/results/{kind}/{name}"
        S.write_results(run_queries(online, index, qa), f"{path}.json")
        rows = judge(docs.sparkSession.read.schema(S.RESULTS).json(f"{path}.json"))
        S.write_evaluation(rows, f"{path}_evaluation.csv")
        out.append(rows)
    return out[0], out[1]


def two_phases(docs: DataFrame, qa: DataFrame, folder: str, chunker: str = "FixedParagraphChunker", params: dict | None = None, first=None, then=None) -> DataFrame:
    """The preprocessing experiment: the better of the ``first`` runs' preprocessors, by answer correctness (the earlier wins
    ties), goes into the second phase, alone replaced by ``then``'s. Summary rows of both with their phase."""
    first = first or {"docling_only": ["DoclingMarkdownProcessor"], "gemini_only": ["GeminiMarkdownProcessor"]}
    own = params or {"chunk_size": 1, "overlap": 0}

    def phase(k: int, names: dict) -> DataFrame:
        runs = [{"name": n, "preprocessors": p, "chunker": chunker, "params": own, "threshold": 0.1} for n, p in names.items()]
        return written(run_experiment(docs, qa, runs, f"{folder}/phase{k}").withColumn("phase", F.lit(k)), "phase")

    one = phase(1, first)
    scores = {r.run_name: r.answer_correctness or 0.0 for r in one.collect()}
    best = max(first, key=lambda n: scores.get(n, 0.0))
    then = then or {f"{best}_direct_llm": [*first[best], "DirectLLMProcessor"], "paper_llm": ["PaperLLMProcessor"]}
    return E.summary([one, phase(2, then)])


def run_experiment(docs: DataFrame, qa: DataFrame, runs: list[dict], folder: str, negative: DataFrame | None = None, embed=None) -> DataFrame:
    """Summary rows of ``runs``: dicts of preprocessors, chunker, params, query_processor, threshold and name.

    Runs that share preprocessors, chunker and parameters share an index, whose average chunk gives the budget, and are
    variants of one search, one reranking and one evaluation (``scored_runs``). ``negative`` questions add the mean of
    their rejection.
    """
    spark, groups = docs.sparkSession, {}
    for run in runs:
        groups.setdefault(repr((run["preprocessors"], run["chunker"], run.get("params", {}))), []).append(run)
    parts = {}
    for number, own in enumerate(groups.values()):
        off = OfflinePipeline(own[0]["preprocessors"], own[0]["chunker"], "FaissIndexBuilder", Offline(own[0].get("params", {})), embed)
        index = off.run(docs, f"{folder}/index_{number}")[1]
        k, n = E.budget(F.col("avg_chunk_tokens"))
        size = index.agg(F.coalesce(F.avg(T.approx_tokens(F.col("text"))), F.lit(1.0)).alias("avg_chunk_tokens"), F.count("*").alias("num_chunks")).select("*", k.alias("top_k"), n.alias("top_n")).first()
        scored = written(scored_runs(index, qa, own, size.top_k, size.top_n, negative, embed), "runs")
        for r, run in enumerate(own):
            facts = {"run_name": run["name"], "num_chunks": size.num_chunks, "avg_chunk_tokens": round(size.avg_chunk_tokens, 1), "top_k": size.top_k, "top_n": size.top_n, "query_processor": run.get("query_processor", PLAIN), "reranking_threshold": run.get("threshold"), **run.get("params", {})}
            facts = {c: F.lit(v).cast("double") if c == "reranking_threshold" else F.lit(v) for c, v in facts.items()}
            parts[id(run)] = scored.where(F.col("run") == r).select(*[v.alias(c) for c, v in facts.items()], *[c for c in scored.columns if c != "run"])
    return E.summary([parts[id(run)] for run in runs]) if runs else spark.createDataFrame([], "run_name string")


PLAIN = "NoProcessingProcessor"


def scored_runs(index: DataFrame, qa: DataFrame, runs: list[dict], top_k: int, top_n: int, negative: DataFrame | None = None, embed=None) -> DataFrame:
    """(run, mean of every metric) for ``runs`` over one index, numbered as they come, in one plan.

    Every question goes through all query processors; their texts are searched together. A pair of question and chunk is scored
    once, whatever processors and runs meet it; runs then differ by the hits they take from that: their processor's, at or
    above their threshold (None: all). Answers and metrics are made for all runs together.
    """
    processors = list(dict.fromkeys(r.get("query_processor", PLAIN) for r in runs))
    asked = qa.select((F.col("qa_idx") * 2).alias("query_id"), F.col("user_input").alias("original_query"), "reference")
    if negative is not None:
        asked = asked.unionByName(negative.select((F.col("qa_idx") * 2 + 1).alias("query_id"), F.col("user_input").alias("original_query"), F.lit(None).cast("string").alias("reference")))
    asked = written(asked, "questions")
    queries = asked.select("query_id", "original_query")
    every = E.summary([component(p)(queries).withColumn("query_id", F.col("query_id") * len(processors) + k) for k, p in enumerate(processors)])
    hits = written(component("FaissRetriever")(index, every, embed or V.hash_embedder(), top_k), "hits")
    part = F.pmod("query_id", F.lit(len(processors)))
    hits = hits.select(F.expr(f"(query_id - pmod(query_id, {len(processors)})) div {len(processors)}").alias("query_id"), part.cast("int").alias("processor"), "rank", "ordinal", "retrieval_score")
    pairs = hits.select("query_id", "ordinal").distinct().join(index.select("ordinal", "chunk_id", "text"), "ordinal").join(queries, "query_id").withColumns({"rank": F.lit(1), "retrieval_score": F.lit(0.0)})
    pairs = written(component("JinaReranker")(pairs, None, None).select("query_id", "ordinal", "text", "reranking_score"), "pairs")
    low = float("-inf")
    variants = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.lit(processors.index(v.get("query_processor", PLAIN))).alias("processor"), F.lit(low if v.get("threshold") is None else float(v["threshold"])).alias("threshold")) for r, v in enumerate(runs)])).alias("v")
    taken = hits.join(pairs, ["query_id", "ordinal"]).select("*", variants).where((F.col("v.processor") == F.col("processor")) & (F.col("reranking_score") >= F.col("v.threshold")))
    of_run = lambda: (F.col("query_id") * len(runs) + F.col("v.run")).alias("query_id")
    taken = taken.select(of_run(), F.row_number().over(Window.partitionBy("query_id", "v.run").orderBy(F.desc("reranking_score"), "rank")).alias("rank"), "text", "reranking_score").where(F.col("rank") <= top_n)
    each = asked.select("*", variants).select(of_run(), F.col("v.run").alias("run"), (F.col("query_id") % 2 == 1).alias("negative"), "original_query", "reference")
    answers = component("HuggingfaceGenerator")(R.contexts(each.select("query_id", "original_query"), taken)).select("query_id", "response", "retrieved_contexts")
    rows = written(each.join(answers, "query_id").withColumnRenamed("original_query", "user_input"), "answers")
    numbers = index.sparkSession.range(len(runs)).select(F.col("id").cast("int").alias("run"))
    out = E.means(E.evaluate(rows.where("not negative")).select("run", "answer_correctness", "context_recall", "faithfulness", "answer_relevancy"), ["run"])
    if negative is not None:
        out = out.join(E.means(E.evaluate_rejection(rows.where("negative")).select("run", "negative_rejection"), ["run"], "negative_"), "run", "full")
    return numbers.join(out, "run", "left")
