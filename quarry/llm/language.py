"""Language identification by a byte convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import batch, fold, id_and_bytes

WINDOW, DIM, WIDTHS, FILTERS = 96, 8, (2, 3, 4), 16
#: The network is fitted on at most this many documents a language, the first by a hash of their id,
#: and on so many windows of each, spread over its whole text; only those windows reach the driver.
MOST_DOCUMENTS, MOST_WINDOWS = 1_500, 6
STEPS, BATCH, RATE, SEED = 500, 256, 4e-3, 5
_SPAN = max(WIDTHS)


def has_letter(text: str) -> bool:
    """Whether any character is a letter; digits, marks and signs such as superscripts and fractions are not."""
    return any(map(str.isalpha, text))


def windows(text: str) -> np.ndarray:
    """The lower-cased text's UTF-8 bytes in rows of WINDOW, the last filled with zeros."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    out = np.zeros((max(1, -(-len(raw) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    return out


def _columns(emb: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(windows, places, _SPAN * DIM): the embedded bytes under the widest filter at each place."""
    e = emb[x]
    shape = (len(x), WINDOW - _SPAN + 1, _SPAN * DIM)
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, shape, (e.strides[0], e.strides[1], e.strides[2])))


def _pooled(model, x):
    emb, conv, bias, _, _ = model
    cols = _columns(emb, x)
    maps = cols.reshape(-1, _SPAN * DIM) @ conv
    return cols, maps.reshape(len(x), -1, conv.shape[1]), bias


def log_probabilities(model, x: np.ndarray) -> np.ndarray:
    """Log probability of every language for each window."""
    out = []
    for k in range(0, len(x), 256):
        _, maps, bias = _pooled(model, x[k : k + 256])
        y = np.maximum(maps.max(axis=1) + bias, 0) @ model[3] + model[4]
        y -= y.max(axis=1, keepdims=True)
        out.append(y - np.log(np.exp(y).sum(axis=1, keepdims=True)))
    return np.concatenate(out)


def sampled(text: str) -> np.ndarray:
    """At most MOST_WINDOWS windows, evenly spread from the first to the last."""
    w = windows(text)
    return w[np.unique(np.linspace(0, len(w) - 1, MOST_WINDOWS).astype(int))]


def fit(rows: list[tuple[np.ndarray, int]], n_langs: int):
    """Adam on the cross entropy of ``sampled`` windows; narrower filters are masked out of the widest."""
    rng = np.random.default_rng(SEED)
    n = FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(_SPAN) < w).astype(np.float32), DIM)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1)
    model = [rng.normal(0, 0.5, (256, DIM)), rng.normal(0, 0.3, (_SPAN * DIM, n)) * mask, np.zeros(n), rng.normal(0, 0.2, (n, n_langs)), np.zeros(n_langs)]
    model = [p.astype(np.float32) for p in model]
    xs, ys = [], []
    for w, y in rows:
        xs.append(w)
        ys += [y] * len(w)
    if not xs:
        return model
    x, y = np.concatenate(xs), np.array(ys)
    share = np.bincount(y, minlength=n_langs) / len(y)
    pull = (1 / np.maximum(share, 1e-9) ** 0.5)[y]
    pull /= pull.sum()
    m, v = [np.zeros_like(p) for p in model], [np.zeros_like(p) for p in model]
    for step in range(1, STEPS + 1):
        at = rng.choice(len(x), BATCH, p=pull)
        xb, yb = x[at], y[at]
        cols, maps, bias = _pooled(model, xb)
        where = maps.argmax(axis=1)
        top = np.take_along_axis(maps, where[:, None], 1)[:, 0] + bias
        h = np.maximum(top, 0)
        z = h @ model[3] + model[4]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(BATCH), yb] -= 1
        p /= BATCH
        g = (p @ model[3].T) * (top > 0)
        seen = cols[np.arange(BATCH)[:, None], where]
        d_cols = g[:, :, None] * model[1].T
        places = where[:, :, None] + np.arange(_SPAN)
        ids = xb[np.arange(BATCH)[:, None, None], places].reshape(-1)
        d_emb = np.stack([np.bincount(ids, d_cols.reshape(-1, DIM)[:, k], 256) for k in range(DIM)], 1)
        grads = [d_emb, np.einsum("bf,bfk->kf", g, seen) * mask, g.sum(0), h.T @ p, p.sum(0)]
        rate = RATE * (1 - step / (STEPS + 1))
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            model[k] = (model[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, usable=None):
    """(languages, network) learnt from text and non-null lang where ``usable`` (of doc_id; default all) holds."""
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    if usable is not None:
        known = known.where(usable)
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], fit([], 1)
    rate = F.create_map(*[F.lit(z) for k in langs for z in (k, min(1 << 20, -(-(MOST_DOCUMENTS << 20) // counts[k])))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate[F.col("lang")])
    schema = pa.schema([("lang", pa.string()), ("doc_id", pa.int64()), ("h", pa.int64()), ("windows", pa.binary())])

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            yield batch(schema, b.column(2), b.column(0), b.column(3), [sampled(t.decode("utf-8", "replace")).tobytes() for t in texts])

    src = id_and_bytes(chosen, F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"))
    rows = sorted((r.lang, r.doc_id, r.h, bytes(r.windows)) for r in src.mapInArrow(run, "lang string, doc_id long, h long, windows binary").collect())
    taken, used = [], dict.fromkeys(langs, 0)
    for lang, _, _, raw in rows:
        if used[lang] < MOST_DOCUMENTS:
            used[lang] += 1
            taken.append((np.frombuffer(raw, np.uint8).reshape(-1, WINDOW), langs.index(lang)))
    return langs, fit(taken, len(langs))


def predict(docs: DataFrame, trained) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text, from the mean log probability of its windows.

    Null texts, texts without a letter, and all texts when nothing was learnt, are ``und`` with score 0. Of equally likely
    languages the first by name is predicted. Repeated rows give repeated rows, an empty table none, a very long text is
    scored over all of its windows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trained)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        langs, model = sent.value
        for b in batches:
            ids, at = b.column(0).to_pylist(), 0
            while at < len(ids):
                first, part, size = at, [], 0
                while at < len(ids) and size < 20_000:
                    text = b.column(1)[at].as_py().decode("utf-8", "replace")
                    part.append(windows(text) if langs and has_letter(text) else np.empty((0, WINDOW), np.uint8))
                    size += len(part[-1])
                    at += 1
                sizes = np.array([len(p) for p in part])
                best, score = ["und"] * len(part), np.zeros(len(part))
                if size:
                    logs = log_probabilities(model, np.concatenate(part))
                    full = np.flatnonzero(sizes)
                    mean = np.add.reduceat(logs, (np.cumsum(sizes) - sizes)[full], axis=0) / sizes[full][:, None]
                    p = np.exp(mean - mean.max(axis=1, keepdims=True))
                    p /= p.sum(axis=1, keepdims=True)
                    for k, row in zip(full, p):
                        best[k], score[k] = langs[int(row.argmax())], float(row.max())
                yield batch(schema, ids[first:at], best, score)

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns outside the held-out fold only."""
    return predict(docs, train(docs, ~fold(4))).select("doc_id", fold(4).alias("held_out"), "lang_pred", "score")
