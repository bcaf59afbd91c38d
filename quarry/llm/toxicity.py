"""Toxicity: a factorization machine over hashed terms, fitted in numpy, applied in batches."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import batch, fold, id_and_bytes, kept, written

BUCKETS, FACTORS, THRESHOLD = 1 << 17, 6, 0.3
#: The classifier is fitted on about so many labelled documents of each class at most, chosen by a hash of their id.
MOST_POSITIVE, MOST_NEGATIVE = 3_000, 4_000
#: Terms of the sample that reach the driver, 8 bytes each; a sample of longer texts is thinned by the same hash.
MOST_TERMS = 12_000_000
#: Hashed terms of a word: itself and its first bytes, so that unseen inflections meet their stem.
PREFIXES = (5, 6)
#: Terms of fewer labelled documents get no weight: they would only be memorised.
LEAST_DOCUMENTS = 5
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.3, 11
_EDGE = b".,;:!?\"'()[]{}*"


class _Terms(dict):
    """word -> its term buckets as int32 bytes; once full, new words are not remembered."""

    def __missing__(self, word: bytes) -> bytes:
        bare = word.strip(_EDGE) or word
        h = xxhash.xxh3_64_intdigest
        ids = [h(bare) % BUCKETS, *(h(b"^" + bare[:n], n) % BUCKETS for n in PREFIXES)]
        out = np.array(ids, np.int32).tobytes()
        if len(self) < 120_000:
            self[word] = out
        return out


def features(text: bytes, terms: dict) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights sqrt(count / words) of a text's terms; both empty without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    count = Counter(words)
    ids = np.frombuffer(b"".join(map(terms.__getitem__, count)), np.int32)
    x = np.sqrt(np.fromiter(count.values(), np.float32, len(count)) / np.float32(len(words)))
    return ids, np.repeat(x, 1 + len(PREFIXES))


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Row sums of ragged rows, zero for empty ones."""
    out = np.zeros((len(sizes), *values.shape[1:]), values.dtype)
    if len(values):
        full = sizes > 0
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def _forward(model, ids, x, starts, sizes):
    w0, w, v = model[:3]
    vx = v[ids] * x[:, None]
    s = _sums(vx, starts, sizes)
    y = w0 + _sums(w[ids] * x, starts, sizes) + 0.5 * (s * s - _sums(vx * vx, starts, sizes)).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(y, -30, 30))), s, vx


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], weights: tuple[float, float]) -> tuple:
    """AdaGrad on the weighted logistic loss. ``rows``: ``features`` of texts and labels; ``weights``: of label 0 and 1.

    Values are scaled by how far the classes differ in a term's document share, so that the many
    terms without a bearing on the label hardly move the score.
    """
    rng = np.random.default_rng(SEED)
    df, n = np.zeros((2, BUCKETS)), np.zeros((2, 1))
    for ids, _, y in rows:
        df[y, np.unique(ids)] += 1
        n[y] += 1
    common = df.sum(axis=0) >= LEAST_DOCUMENTS
    share = np.log((df + 1) / (n + 2))
    scale = (np.abs(share[1] - share[0]) * common).astype(np.float32)
    data = []
    for ids, x, y in rows:
        live = common[ids]
        data.append((ids[live], x[live] * scale[ids[live]], y))
    w0 = np.float32(0)
    w = np.zeros(BUCKETS, np.float32)
    v = rng.normal(0, 0.05, (BUCKETS, FACTORS)).astype(np.float32) * common[:, None]
    hw, hv, h0 = np.full(BUCKETS, 1e-3, np.float32), np.full(BUCKETS, 1e-2, np.float32), 1e-3
    for _ in range(EPOCHS if data else 0):
        order = rng.permutation(len(data))
        for k in range(0, len(order), BATCH):
            part = [data[i] for i in order[k : k + BATCH]]
            sizes = np.array([len(p[0]) for p in part])
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            ids, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
            y = np.array([p[2] for p in part], np.float32)
            p, s, vx = _forward((w0, w, v), ids, x, starts, sizes)
            d = ((p - y) * np.where(y > 0, weights[1], weights[0])).astype(np.float32)
            h0 += float(d.sum()) ** 2 / len(part)
            w0 -= np.float32(RATE * d.sum() / len(part) / np.sqrt(h0))
            dx = np.repeat(d, sizes) * x
            uniq, at = np.unique(ids, return_inverse=True)
            gw = np.bincount(at, dx, len(uniq)).astype(np.float32) + 1e-4 * w[uniq]
            inner = np.repeat(s, sizes, axis=0) - vx
            gv = np.stack([np.bincount(at, dx * inner[:, f], len(uniq)) for f in range(FACTORS)], 1).astype(np.float32) + 1e-3 * v[uniq]
            hw[uniq] += gw * gw
            hv[uniq] += (gv * gv).mean(axis=1)
            w[uniq] -= RATE * gw / np.sqrt(hw[uniq])
            v[uniq] -= 0.2 * RATE * gv / np.sqrt(hv[uniq])[:, None]
    mass = n[:, 0] * np.array(weights)
    return w0, w, v, scale, float(mass[1] / max(1e-9, mass.sum()))


#: Hash values that deal labels to the sample.
SHARES = 1 << 40


def sample_rate(most: int, n: int) -> int:
    """Of SHARES hash values those that take about ``most`` of ``n`` labels."""
    return min(SHARES, most * SHARES // max(1, n))


def train(docs: DataFrame, labels: DataFrame, usable=None) -> tuple:
    """Fit on ``labels.toxic`` of documents where ``usable`` (a column of doc_id; default all) holds.

    The labelled sample's expected size is bounded by MOST_POSITIVE and MOST_NEGATIVE documents and MOST_TERMS terms; each class is
    weighted back to its share among all usable labels. Only hashed terms reach the driver. Null labels and ids are
    left out, repeated labels count as the greatest, and each row of a repeated id is learnt from.
    """
    known = labels.where("doc_id is not null and toxic is not null")
    if usable is not None:
        known = known.where(usable)
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    most = {1: MOST_POSITIVE, 0: MOST_NEGATIVE}
    h = F.xxhash64("id")  # 40 bits of it: a class keeps its bound up to a million million labels times the bound
    share = F.pmod(h, F.lit(1 << 20)) * (1 << 20) + F.pmod(F.shiftright(h, 20), F.lit(1 << 20))
    rate = {y: sample_rate(k, n.get(y, 0)) for y, k in most.items()}
    take = known.where(share < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])).withColumn("share", share)
    sample = id_and_bytes(docs).join(F.broadcast(take), F.col("doc_id") == F.col("id"))
    schema = pa.schema([("doc_id", pa.int64()), ("share", pa.int64()), ("y", pa.int32()), ("h", pa.int64()), ("size", pa.int64()), ("ids", pa.binary()), ("x", pa.binary())])

    def run(batches):
        terms = _Terms()
        for b in batches:
            found = [features(t.as_py(), terms) for t in b.column(3)]
            hashes = [xxhash.xxh3_64_intdigest(t.as_py()) >> 1 for t in b.column(3)]
            yield batch(schema, b.column(0), b.column(1), b.column(2), hashes, [len(i) for i, _ in found], [i.tobytes() for i, _ in found], [x.tobytes() for _, x in found])

    kinds = "doc_id long, share long, y int, h long, size long, ids binary, x binary"
    rows = written(sample.select("doc_id", "share", "y", "text").mapInArrow(run, kinds), "terms")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cut = min(1.0, MOST_TERMS / max(1, total))
    rate = {y: int(k * cut) for y, k in rate.items()}
    got = rows.where(F.col("share") < F.when(F.col("y") == 1, rate[1]).otherwise(rate[0])).select("doc_id", "h", "y", "ids", "x").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("h", "ascending")])
    data = [(np.frombuffer(i.as_py(), np.int32), np.frombuffer(x.as_py(), np.float32), y) for i, x, y in zip(got["ids"], got["x"], got["y"].to_pylist())]
    model = fit(data, tuple(SHARES / max(1, rate[y]) for y in (0, 1)))
    del data, got
    pa.default_memory_pool().release_unused()  # the driver keeps the model alone
    return model


def _scores(model: tuple, texts, terms: dict):
    """Scores of an Arrow column of texts, some texts at a time."""
    at, n = 0, len(texts)
    while at < n:
        part, nnz = [], 0
        while at < n and nnz < 400_000:
            part.append(features(texts[at].as_py(), terms))
            nnz += len(part[-1][0])
            at += 1
        sizes = np.array([len(p[0]) for p in part])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        ids, x = np.concatenate([p[0] for p in part]), np.concatenate([p[1] for p in part])
        scale = model[3][ids]
        yield np.where(_sums(scale, starts, sizes) > 0, _forward(model, ids, x * scale, starts, sizes)[0], model[4]).astype(np.float64)


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, score): of every whole text. Texts without a term that was learnt, such as empty and null
    ones, get the share of label 1; without labels every score is 0. Repeated rows give repeated rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        terms = _Terms()
        for b in batches:
            at = 0
            for p in _scores(sent.value, b.column(1), terms):
                yield batch(schema, b.column(0).slice(at, len(p)), p)
                at += len(p)

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns outside the held-out fold only."""
    model = train(docs, labels, ~fold(4))
    return score(docs, model).select("doc_id", fold(4).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns. Every row is judged by its own text, whatever its
    id; an empty table gives an empty table."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, ~fold(4)))

    def verdict():
        terms = _Terms()
        return lambda texts: np.concatenate([np.empty(0), *_scores(sent.value, texts, terms)]) < threshold

    return kept(docs, verdict)
