"""Chunkers: documents(doc_id, text, ...) -> one row per chunk.

Fixed windows, paragraphs and whole texts are Column expressions. Chunkers whose cuts depend on the cut
before run over Arrow batches, one document's state at a time; documents are independent, so nothing
is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions import text as T
from quarry.schemas import CHUNK
from quarry.sources.shared import bounded, written


def _check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk_size must be greater than 0")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than chunk_size")


def _rows(docs: DataFrame, parts: Column, name: str, metadata: Column | None = None) -> DataFrame:
    meta = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), meta.alias("metadata"), F.posexplode(parts).alias("chunk_idx", "text"))
    return out.select(F.concat("doc_id", F.lit("_chunk_"), "chunk_idx").alias("chunk_id"), "doc_id", "chunk_idx", "text", F.lit(name).alias("chunker_name"), "metadata")


def _windows(n: Column, size: int, step: int) -> Column:
    """Window numbers 0.. until one reaches the end of ``n`` items; none for no items."""
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def by_characters(docs: DataFrame, chunk_size: int = 1000, overlap: int = 200) -> DataFrame:
    """Windows of ``chunk_size`` code points. The text is cut into steps in one pass and windows are
    joined from those, so long texts cost no more per character than short ones."""
    _check(chunk_size, overlap)
    step = chunk_size - overlap
    per = -(-chunk_size // step)
    body = F.coalesce(F.col("text"), F.lit(""))
    cut = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    count = _windows(F.length(body), chunk_size, step)
    parts = F.transform(F.array(cut), lambda s: F.transform(count, lambda k: F.substring(F.array_join(F.slice(s, k + 1, F.lit(per)), ""), 1, chunk_size)))[0]
    return _rows(docs, parts, f"fixed_size_char_{chunk_size}_{overlap}")


def by_paragraphs(docs: DataFrame, chunk_size: int = 1, overlap: int = 0) -> DataFrame:
    _check(chunk_size, overlap)
    step = chunk_size - overlap
    parts = F.transform(F.array(T.paragraphs(F.coalesce(F.col("text"), F.lit("")))), lambda p: F.transform(_windows(F.size(p), chunk_size, step), lambda k: F.array_join(F.slice(p, k * step + 1, F.lit(chunk_size)), "\n\n")))[0]
    return _rows(docs, parts, f"fixed_size_paragraph_{chunk_size}_{overlap}")


def whole(docs: DataFrame) -> DataFrame:
    """One chunk a document; empty texts give none."""
    path = F.col("source_path") if "source_path" in docs.columns else F.lit("")
    return _rows(docs.where("text <> ''"), F.array("text"), "passthrough", F.create_map(F.lit("source_path"), path.cast("string")))


Piece = tuple[int, str, dict]


#: Rows and characters of chunks that a task passes on at once.
CHUNK_ROWS, CHUNK_CHARS = 4096, 1 << 20
_META = pa.map_(pa.string(), pa.string())
_ARROW = pa.schema([("chunk_id", pa.string()), ("doc_id", pa.string()), ("chunk_idx", pa.int32()), ("text", pa.string()), ("chunker_name", pa.string()), ("metadata", _META)])


def cut_batches(batches: Iterator[pa.RecordBatch], name: str, cut: Callable[[str, str], list[Piece]]) -> Iterator[pa.RecordBatch]:
    """The chunks of batches of (doc_id, text), document by document, as batches of bounded rows and characters."""
    rows, size = [], 0

    def passed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)

    for b in batches:
        for d, x in zip(*b.columns):
            d = d.as_py()
            for i, t, m in cut(d, x.as_py() or ""):
                rows.append((f"{d}_chunk_{i}", d, i, t, name, [(k, str(v)) for k, v in m.items()]))
                size += len(t)
                if len(rows) >= CHUNK_ROWS or size >= CHUNK_CHARS:
                    yield passed()
                    rows, size = [], 0
    if rows:
        yield passed()


def sequential(docs: DataFrame, name: str, cut: Callable[[str, str], list[Piece]]) -> DataFrame:
    """Run ``cut(doc_id, text) -> [(chunk_idx, text, metadata)]`` over the documents one by one. A worker holds a batch of bounded
    bytes, one document's chunks, and a bounded number of others that are not passed on yet."""
    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(lambda batches: cut_batches(batches, name, cut), CHUNK)


def _sentence_spans(text: str) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, word spans) of each sentence."""
    edges, out = [0], []
    for m in T.SENTENCE_END.finditer(text):
        edges += [m.start(), m.end()]
    edges.append(len(text))
    for a, b in zip(edges[::2], edges[1::2]):
        w = [m.span() for m in re.finditer(r"\S+", text[a:b])]
        if w:
            out.append((a + w[0][0], a + w[-1][1], [(a + s, a + e) for s, e in w]))
    return out


def pack_sentences(text: str, size: int, overlap: int) -> list[str]:
    """Greedy runs of whole sentences of at most ``size`` words; longer sentences are cut into word windows."""
    spans = _sentence_spans(text)
    length = [len(s[2]) for s in spans]
    total = np.r_[0, np.cumsum(length)]
    out, first, i, n = [], 0, 0, len(spans)
    while i < n:
        if i > first and total[i + 1] - total[first] > size:
            out.append(text[spans[first][0] : spans[i - 1][1]])
            # the longest suffix within the overlap, and never the whole run again
            back = next((o for o in range(first, i) if total[i] - total[o] <= overlap), i)
            first = max(first + 1, back)
        elif length[i] > size:
            w = spans[i][2]
            for a in range(0, len(w), max(1, size - overlap)):
                out.append(text[w[a][0] : w[min(a + size, len(w)) - 1][1]])
            first = i = i + 1
        else:
            i += 1
    if first < n:
        out.append(text[spans[first][0] : spans[-1][1]])
    return out


def by_sentences(docs: DataFrame, chunk_size: int = 250, overlap: int = 0) -> DataFrame:
    _check(chunk_size, overlap)
    return sequential(docs, f"recursive_sentence_{chunk_size}_{overlap}", lambda _, t: [(i, c, {}) for i, c in enumerate(pack_sentences(t, chunk_size, overlap))])


# --- boundaries suggested by a model -----------------------------------------------------------

TOKEN_TARGET, SHORT = 550, 5
#: Fixed value: how a model names the paragraph where the topic turns.
ANSWER = re.compile(r"Answer:\s*ID\s*(\d+)", re.IGNORECASE)


def rule_detector(window: list[tuple[int, str]]) -> str:
    """Default boundary model: the first later paragraph that starts with another letter than the first does."""
    head = window[0][1][:1].lower()
    k = next((k for k, p in window[1:] if p[:1].lower() != head), window[-1][0])
    return f"Answer: ID {k}"


def find_boundaries(paras: list[str], detect: Callable[[list[tuple[int, str]]], str | None]) -> list[int]:
    """Exclusive ends of the chunks. ``detect`` sees numbered paragraphs of about TOKEN_TARGET tokens and names the
    one where the topic turns.

    A window ends before the paragraph that its end numbers, and never holds the last paragraph. A paragraph that fills a
    window alone is a chunk; a number outside (start, end] counts as the end; no usable answer joins the
    window to the next chunk.
    """
    n, start, ends = len(paras), 0, []
    if n <= SHORT:
        return [n] if n else []
    total = np.cumsum([0, *(2 + len(p.split()) for p in paras)])  # a paragraph is shown behind "ID" and its number
    while start < n - SHORT:
        tokens = np.array([round(1.2 * w) for w in (total[start + 1 : n] - total[start]).tolist()])
        full = np.flatnonzero(tokens >= TOKEN_TARGET)
        end = start + 1 + int(full[0]) if len(full) else n - 1
        if end > start + 1:
            m = ANSWER.search(detect([(k, paras[k]) for k in range(start, end)]) or "")
            if not m:
                start = end
                continue
            if start < int(m[1]) <= end:
                end = int(m[1])
        ends.append(end)
        start = end
    return [*ends, n]


def by_model(docs: DataFrame, detect=rule_detector, cache: DataFrame | None = None) -> DataFrame:
    """Chunks between boundaries; those in ``cache(doc_id, text_hash, boundary_ids)`` are not asked for again.

    Boundaries are found and cut in one pass over each row; without a cache nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").withColumn("boundary_ids", F.lit(None).cast("array<int>"))
    if cache is not None:
        known = cache.where("boundary_ids is not null").groupBy("doc_id", "text_hash").agg(F.min("boundary_ids").alias("boundary_ids"))
        rows = rows.drop("boundary_ids").withColumn("text_hash", T.text_hash(F.coalesce("text", F.lit("")))).join(known, ["doc_id", "text_hash"], "left").drop("text_hash")

    def run(batches):
        for pdf in batches:
            out = []
            for d, t, ends in zip(pdf.doc_id, pdf.text, pdf.boundary_ids):
                paras, a = T.split_paragraphs((t or "").strip()), 0
                for i, b in enumerate(find_boundaries(paras, detect) if ends is None else ends):
                    if b > a:
                        out.append((f"{d}_chunk_{i}", d, i, "\n\n".join(paras[a:b]), "lumber_chunker", {"para_start": str(a), "para_end": str(b - 1)}))
                    a = max(a, b)
            yield pd.DataFrame(out, columns=["chunk_id", "doc_id", "chunk_idx", "text", "chunker_name", "metadata"])

    return rows.mapInPandas(run, CHUNK)


def boundaries(docs: DataFrame, detect=rule_detector, cache: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, boundary_ids, cached) of every document; only cache misses reach the model."""
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", T.text_hash(F.coalesce("text", F.lit(""))).alias("text_hash"))
    miss, hit = keyed, None
    if cache is not None:
        have = cache.select("doc_id", "text_hash", "boundary_ids").where("boundary_ids is not null")
        hit = keyed.drop("text").join(have, ["doc_id", "text_hash"]).withColumn("cached", F.lit(True))
        miss = keyed.join(have, ["doc_id", "text_hash"], "left_anti")

    def run(batches):
        for pdf in batches:
            ends = [find_boundaries(T.split_paragraphs((t or "").strip()), detect) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "text_hash": pdf.text_hash, "boundary_ids": ends, "cached": False})

    new = miss.mapInPandas(run, "doc_id string, text_hash string, boundary_ids array<int>, cached boolean")
    return new if hit is None else hit.unionByName(new)


# --- similarity-driven clusters ------------------------------------------------------------------


class Clusters:
    """Cluster numbers of vectors given in order; only the open cluster's vectors are held."""

    def __init__(self, fixed_threshold: float, c: float, init_constant: float):
        self.bars = fixed_threshold, c, init_constant
        self.open, self.size, self.tight, self.number = np.empty((0, 0)), 0, -np.inf, -1

    def add(self, v: np.ndarray) -> int:
        """A vector joins if its greatest similarity to the cluster beats the fixed threshold and the cluster's own
        tightness, which weighs more as the cluster grows."""
        fixed, c, init = self.bars
        n = np.linalg.norm(v)
        u = v / n if n > 0 else np.zeros_like(v)
        if self.size:
            near = self.open[: self.size] @ u
            if self.size == 1:
                least, sim, bar = near[0], init * near[0], 0.0
            else:
                bar, sim = self.tight * c / (1 + np.exp(-(self.size - 1.0))), near.max()
                least = min(near.min(), self.tight)
            if sim > max(bar, fixed):
                if self.size == len(self.open):
                    self.open = np.concatenate([self.open, np.empty_like(self.open)])
                self.open[self.size] = u
                self.size, self.tight = self.size + 1, least
                return self.number
        self.open, self.size, self.tight, self.number = u[None].repeat(2, axis=0), 1, -np.inf, self.number + 1
        return self.number


def cluster_vectors(v: np.ndarray, fixed_threshold: float, c: float, init_constant: float) -> list[int]:
    """Cluster number of each vector in order."""
    clusters = Clusters(fixed_threshold, c, init_constant)
    return [clusters.add(x) for x in np.asarray(v, np.float64)]


def by_similarity(docs: DataFrame, embed: Callable[[list[str]], np.ndarray] | None = None, fixed_threshold: float = 0.6, c: float = 0.9, init_constant: float = 1.5, model: str = "hash") -> DataFrame:
    """Sentences of a document in clusters, joined by one space; a single sentence is a chunk."""
    from quarry.functions.vectors import DIM, hash_bucket

    def default(texts):
        out = np.zeros((len(texts), DIM))
        for k, t in enumerate(texts):
            for w in t.lower().split():
                out[k, hash_bucket(w)] += 1
        return out

    def cut(_, text):
        s = T.split_sentences(text)
        ids = cluster_vectors(np.asarray((embed or default)(s), np.float64), fixed_threshold, c, init_constant) if s else []
        groups: dict[int, list[str]] = {}
        for k, x in zip(ids, s):
            groups.setdefault(k, []).append(x)
        return [(k, " ".join(x), {}) for k, x in groups.items()]

    return sequential(docs, f"maxmin_{model.rsplit('/', 1)[-1]}_ft{fixed_threshold}_c{c}_ic{init_constant}", cut)


#: Rows of a key that are clustered by one task.
SEGMENT = 4096


def cluster_rows(rows: DataFrame, key: str, order: str, vector: str, fixed_threshold: float = 0.6, c: float = 0.9, init_constant: float = 1.5, segment: int = SEGMENT) -> DataFrame:
    """(key, i, cluster) for vectors that already have rows of their own, in ``order`` within each ``key``.

    Where no key has more than ``segment`` rows, sorted rows go through batch by batch. Otherwise the rows of a key are cut into
    segments that are clustered at once (``_by_segments``); the result is the same. A task holds an open cluster.
    """
    bars = fixed_threshold, c, init_constant
    src = rows.select(F.col(key).cast("string").alias("k"), F.col(order).alias("o"), F.col(vector).alias("v"))
    if (src.groupBy("k").count().agg(F.max("count")).first()[0] or 0) > segment:
        return _by_segments(src, bars, segment)

    def run(batches):
        last, clusters, i = object(), None, 0
        for pdf in batches:
            out = []
            for k, v in zip(pdf.k, pdf.v):
                if clusters is None or k != last:
                    last, clusters, i = k, Clusters(*bars), 0
                i += 1
                out.append((k, i, clusters.add(np.asarray(v, np.float64))))
            yield pd.DataFrame(out, columns=["k", "i", "cluster"])

    return src.repartition("k").sortWithinPartitions("k", "o").mapInPandas(run, "k string, i long, cluster long")


def _numbered(src: DataFrame) -> DataFrame:
    """(k, i, v): each key's rows numbered from 1 in their order, without a task for all rows of a key."""
    n = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = src.repartitionByRange(n, "k", "o").sortWithinPartitions("k", "o").withColumns({"p": F.spark_partition_id(), "m": F.monotonically_increasing_id()})
    rows = written(rows.drop("o"), "ordered")  # range bounds are sampled: a second run could cut elsewhere
    parts = rows.groupBy("p", "k").agg(F.count("*").alias("n"), F.min("m").alias("low"))
    parts = parts.select(F.col("p").alias("p2"), F.col("k").alias("k2"), "low", (F.sum("n").over(Window.partitionBy("k").orderBy("p")) - F.col("n")).alias("before"))
    return rows.join(parts, (F.col("p") == F.col("p2")) & F.col("k").eqNullSafe(F.col("k2"))).select("k", (F.col("m") - F.col("low") + F.col("before") + 1).alias("i"), "v")


def _by_segments(src: DataFrame, bars: tuple, segment: int) -> DataFrame:
    """``cluster_rows`` by speculation. Each segment is first clustered as if a cluster began with it. All that a segment needs of the
    rows before it is where its open cluster began: it is clustered again from there, until a cluster begins where one did before,
    after which nothing can differ. Segments whose open cluster turns out to begin elsewhere than assumed are repeated until
    all agree; after n rounds the first n segments of a key are final, and most are after one.
    """
    rows = written(_numbered(src).withColumn("seg", F.expr(f"(i - 1) div {segment}")), "segments")
    kind = "k string, seg long, came long, starts array<long>"

    def clustered(parts: DataFrame) -> DataFrame:
        """New states of ``parts(k, seg, came, old, i, own, v)``, sorted by i: old comes with a part's first row, own tells its rows
        from those of the open cluster before it."""

        def run(batches):
            part, clusters, old, starts, done = None, None, (), [], False
            for pdf in batches:
                out = []
                for k, seg, came, before, i, own, v in zip(pdf.k, pdf.seg, pdf.came, pdf.old, pdf.i, pdf.own, pdf.v):
                    if part is None or part[0] != k or part[1] != seg:
                        if part is not None:
                            out.append((*part, starts))
                        part, clusters, starts, done = (k, seg, came), Clusters(*bars), [], False
                        old = [] if before is None else [int(x) for x in before]
                        known = set(old)
                    if done:
                        continue
                    last = clusters.number
                    if clusters.add(np.asarray(v, np.float64)) != last and own:
                        if i in known:
                            starts, done = starts + [x for x in old if x >= i], True
                        else:
                            starts.append(i)
                if out:
                    yield pd.DataFrame(out, columns=["k", "seg", "came", "starts"])
            if part is not None:
                yield pd.DataFrame([(*part, starts)], columns=["k", "seg", "came", "starts"])

        return parts.repartition("k", "seg").sortWithinPartitions("k", "seg", "i").mapInPandas(run, kind)

    fresh = rows.select("k", "seg", F.lit(0).cast("long").alias("came"), F.lit(None).cast("array<long>").alias("old"), "i", F.lit(True).alias("own"), "v")
    state = written(clustered(fresh), "states")
    while True:
        ends = state.select(F.col("k").alias("k2"), (F.col("seg") + 1).alias("seg2"), F.coalesce(F.try_element_at("starts", F.lit(-1)), "came").alias("now"))
        work = state.join(ends, F.col("k").eqNullSafe(F.col("k2")) & (F.col("seg") == F.col("seg2"))).where("came <> now").select(F.col("k").alias("k2"), F.col("seg").alias("at"), "now", F.col("starts").alias("old"))
        work = written(work.select("*", F.explode(F.sequence(F.expr(f"(now - 1) div {segment}"), F.col("at"))).alias("seg2")), "work")
        if work.isEmpty():
            break
        again = rows.join(work, F.col("k").eqNullSafe(F.col("k2")) & (F.col("seg") == F.col("seg2")) & (F.col("i") >= F.col("now")))
        again = again.select("k", F.col("at").alias("seg"), F.col("now").alias("came"), F.when(F.col("i") == F.col("now"), F.col("old")).alias("old"), "i", (F.col("seg") == F.col("at")).alias("own"), "v")
        new = clustered(again).toDF("k2", "seg2", "came2", "starts2")
        state = written(state.join(new, F.col("k").eqNullSafe(F.col("k2")) & (F.col("seg") == F.col("seg2")), "left").select("k", "seg", F.coalesce("came2", "came").alias("came"), F.coalesce("starts2", "starts").alias("starts")), "states")
    sizes = rows.groupBy(F.col("k").alias("k2"), F.col("seg").alias("seg2")).agg(F.min("i").alias("first"), F.max("i").alias("last"))
    x = state.join(sizes, F.col("k").eqNullSafe(F.col("k2")) & (F.col("seg") == F.col("seg2")))
    x = x.withColumn("before", F.sum(F.size("starts")).over(Window.partitionBy("k").orderBy("seg")) - F.size("starts"))
    edges = F.concat(F.array("first"), "starts", F.array(F.col("last") + 1))
    runs = F.transform(F.slice(edges, F.lit(1), F.size(edges) - 1), lambda a, j: F.struct(a.alias("a"), (F.get(edges, j + 1) - 1).alias("b"), (F.col("before") + j - 1).alias("cluster")))
    each = x.select("k", F.explode(F.filter(runs, lambda r: r["a"] <= r["b"])).alias("r"))
    return each.select("k", F.explode(F.sequence("r.a", "r.b")).alias("i"), F.col("r.cluster").alias("cluster"))
