"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(place | class, history) * P(token | place). The VOCAB commonest
tokens sit in HEAD classes of WIDTH places, a token each. Every rarer token belongs to one of TAIL classes
by a hash of its last bytes and to one of its places by a hash of the word, and gets its share of the
place's smoothed count. Each class has a learnt softmax over its places. Features are the previous token, the one before it (a
skip) and the pair of both, hashed; logits are sums of one weight row a feature.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import as_bytes, batch, fold, id_and_bytes, written

HEAD, WIDTH, TAIL, NARROW = 16, 64, 16, 32
VOCAB, CLASSES = HEAD * WIDTH, HEAD + TAIL
#: Context symbols: the commonest words stand for themselves, others for a hash of their last bytes. Own symbols, pairs and
#: the tail's places double at each of GROW different words.
OWN, ENDINGS, COARSE, PAIRS, GROW = 4096, 1024, 512, 1 << 14, (1 << 20, 1 << 22)
#: At most so many words' exact counts go to every executor, as whole levels of a log scale from the
#: top; counts of all others are joined.
KNOWN = 250_000
BATCH, RATE, SEED = 8192, 0.25, 3
#: Synchronous rounds of training; tokens of a round that one shard learns from; tasks that shards are dealt to, at
#: most; blocks a model is cut into for averaging, tasks' models averaged by one.
ROUNDS, SHARD, TASKS, BLOCKS, FANIN = 2, 3_000_000, 20_000, 16, 64
#: Text that is cut into words at once.
CUT = 2 << 20
END = b""
LOG10E = float(np.log10(np.e))
#: A-Z to lower case, and white space to spaces; no UTF-8 text has the byte that stands for its end.
_LOWER = bytes.maketrans(bytes([*range(65, 91), *range(9, 14)]), bytes([*range(97, 123), *[32] * 5]))
_END = b" \xff"


def _ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of the texts, each behind a space (the end as ``_END``), each token's place among them and
    where texts begin."""
    data = b"".join(b" " + t.translate(_LOWER) + _END for t in texts)
    space = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    offsets = np.append(space, len(data)).astype(np.int32)
    units = pa.BinaryArray.from_buffers(pa.binary(), len(space), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    words, code = units.dictionary, units.indices.to_numpy()
    blank = pc.index(words, pa.scalar(b" ", pa.binary())).as_py()
    if blank >= 0:
        code = code[code != blank]
    ends = np.flatnonzero(code == pc.index(words, pa.scalar(_END, pa.binary())).as_py())
    return words, code, np.r_[0, ends[:-1] + 1]


def _bare(words: pa.Array) -> pa.Array:
    """Words of ``cut`` without the space before each, the end as END."""
    _, offsets, data = pa.concat_arrays([words]).buffers()
    n = len(words)
    if not n:
        return pa.array([], pa.binary())
    at = np.frombuffer(offsets, np.int32, n + 1)
    raw = np.frombuffer(data, np.uint8, at[-1] - at[0], at[0])
    keep = np.ones(len(raw), bool)
    keep[at[:-1] - at[0]] = False
    out = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((at - at[0] - np.arange(n + 1, dtype=np.int32)).astype(np.int32)), pa.py_buffer(raw[keep])])
    return pc.if_else(pc.equal(out, pa.scalar(_END[1:], pa.binary())), pa.scalar(END, pa.binary()), out)


def _some(batches, most: int):
    """(ids, texts) of the rows of (doc_id, text, ..) batches, about ``most`` bytes at a time, whatever the batches."""
    ids, texts, size = [], [], 0
    for b in batches:
        for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
            ids.append(doc), texts.append(t.as_py())
            size += len(texts[-1]) + 1
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _by_shard(batches):
    """(shard, rows without it) of batches that come sorted by their first column."""
    for b in batches:
        shard = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for a, e in zip(cuts, cuts[1:]):
            if e > a:
                yield int(shard[a]), b.slice(a, e - a).select([1, 2])


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n): counts of A-Z-lower-cased words over all whole texts; END once a text."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches):
        for _, texts in _some(batches, 16 * CUT):
            words, code, _ = cut(texts)
            n = np.bincount(code, minlength=len(words))
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([_bare(words.take(pa.array(met))), pa.array(n[met])], schema=schema)

    return id_and_bytes(docs).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Tables:
    """What scoring needs of the counts: bounded by KNOWN words, VOCAB and the tail's places."""

    def __init__(self, counts: DataFrame):
        row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.n, self.v, self._known = row.n, row.v, None
        grow = 1 << sum(self.v >= g for g in GROW)
        self.own, self.pairs, self.places = OWN * grow, PAIRS * grow, NARROW * grow
        self.symbols = self.own + ENDINGS + 1
        level = F.floor(F.log2("n") * 16).cast("int").alias("level")
        least, room = 1 << 30, KNOWN
        for r in sorted(counts.groupBy(level).count().collect(), reverse=True):
            if (room := room - r["count"]) < 0:
                break
            least = r.level
        top = counts.where(level >= least).collect()
        top.sort(key=lambda r: (-r.n, bytes(r.word)))
        self.words = [bytes(r.word) for r in top]
        self.counts = np.array([r.n for r in top], np.float64)
        narrow = self.places
        self.tails = np.array([_ending(w) * narrow + zlib.crc32(w) % narrow for w in self.words], np.int64)
        ending = F.pmod(F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(ENDINGS)), F.lit(TAIL))
        place = (ending * narrow + F.pmod(F.crc32("word"), F.lit(narrow))).alias("k")
        self.mass = np.zeros(TAIL * narrow)
        for r in counts.groupBy(place).agg(F.sum(F.col("n") + 1).alias("z")).collect():
            self.mass[r.k] = float(r.z)
        for t, c in zip(self.tails[:VOCAB].tolist(), self.counts[:VOCAB].tolist()):
            self.mass[t // narrow % TAIL * narrow + t % narrow] -= c + 1
        self.mass = np.maximum(self.mass, 0) + 1
        in_head = np.zeros(VOCAB)
        in_head[: len(self.counts[:VOCAB])] = self.counts[:VOCAB]
        self.within = np.full(VOCAB, -30.0, np.float32)
        live = in_head > 0
        self.within[live] = np.log(in_head[live])
        self.within = self.within.reshape(WIDTH, HEAD).T.copy()  # rank r: class r % HEAD, place r // HEAD
        per = self.mass.reshape(TAIL, narrow)
        self.narrow = np.log(per).astype(np.float32)
        totals = np.r_[in_head.reshape(WIDTH, HEAD).sum(axis=0), per.sum(axis=1)]
        self.prior = np.log((totals + 0.1) / (totals.sum() + 0.1 * CLASSES)).astype(np.float32)

    def lookup(self) -> dict[bytes, int]:
        """Word, as ``cut`` gives it, to its rank; made once in each worker that has the tables."""
        if self._known is None:
            self._known = {b" " + w if w else _END: k for k, w in enumerate(self.words)}
        return self._known


def _indices(known: dict[bytes, int], words: pa.Array, narrow: int) -> np.ndarray:
    """Each word's rank, or -1 - its ending and place for those not known."""
    words = as_bytes(words)
    out, crc = list(map(known.get, words)), zlib.crc32
    if None in out:
        for k, w in [(k, w) for k, (i, w) in enumerate(zip(out, words)) if i is None]:
            out[k] = -1 - (crc(w[-2:] if len(w) > 2 else w[1:]) % ENDINGS * narrow + crc(w[1:]) % narrow)
    return np.array(out, np.int64)


def new_model(tables: Tables) -> list[np.ndarray]:
    """Weight rows of the class features (previous, skip, pair), of the two features within head classes and within tail classes."""
    out = [np.zeros((r, CLASSES), np.float32) for r in (tables.symbols, tables.symbols, tables.pairs)]
    return out + [np.zeros((COARSE * n, w), np.float32) for n, w in ((HEAD, WIDTH), (HEAD, WIDTH), (TAIL, tables.places), (TAIL, tables.places))]


def features(tables: Tables, idx: np.ndarray, starts: np.ndarray):
    """Whether in the head, class, place in class and feature rows of each token; ``idx`` as from ``_indices``, texts begin at ``starts``."""
    known = idx >= 0
    tail = np.where(known, tables.tails[np.maximum(idx, 0)] if len(tables.tails) else 0, -1 - idx)
    ending = tail // tables.places
    symbol = np.where(known & (idx < tables.own), idx, tables.own + ending)
    head = known & (idx < VOCAB)
    cls = np.where(head, idx % HEAD, HEAD + ending % TAIL)
    place = np.where(head, idx // HEAD, tail % tables.places)
    first = tables.symbols - 1
    s1, s2 = np.full(len(idx), first), np.full(len(idx), first)
    s1[1:], s2[2:] = symbol[:-1], symbol[:-2]
    s1[starts] = first
    s2[starts] = first
    after = starts + 1
    s2[after[after < len(idx)]] = first
    pair = (s1 * 40503 + s2 * 9973 + (s1 ^ (s2 << 3))) % tables.pairs
    return head, cls, place, (s1, s2, pair)


def _logits(base: np.ndarray, tables: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """``base`` and one row of each table, summed."""
    z = tables[0].take(rows[0], axis=0)
    for t, r in zip(tables[1:], rows[1:]):
        z += t.take(r, axis=0)
    z += base
    return z


def _softmax(z: np.ndarray) -> np.ndarray:
    """Row softmax in place. Logits are capped, not shifted: a matrix product is far cheaper than a row maximum."""
    np.exp(np.minimum(z, np.float32(60), out=z), out=z)
    z /= (z @ np.ones(z.shape[1], np.float32) + np.float32(1e-30))[:, None]
    return z


def _within(tables, model, head: bool, cls, feats, rows):
    """Feature rows and place probabilities of tokens in head or in tail classes."""
    at, n, base = (3, HEAD, tables.within) if head else (5, TAIL, tables.narrow)
    c = cls.take(rows) - (0 if head else HEAD)
    own = [(f.take(rows) % COARSE) * n + c for f in feats[:2]]
    return at, own, _softmax(_logits(base.take(c, axis=0), model[at : at + len(own)], own))


def log_probs(tables: Tables, model, idx: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Natural log probability of each token, without a tail token's own count."""
    out = np.empty(len(idx))
    head, cls, place, feats = features(tables, idx, starts)
    log_mass = np.log(tables.mass)
    for a in range(0, len(idx), BATCH):
        s = slice(a, a + BATCH)
        p = _softmax(_logits(tables.prior, model[:3], [f[s] for f in feats]))
        y = np.log(p[np.arange(len(p)), cls[s]] + 1e-12)
        for which in (True, False):
            rows = np.flatnonzero(head[s] == which) + a
            if len(rows):
                _, _, q = _within(tables, model, which, cls, feats, rows)
                y[rows - a] += np.log(q[np.arange(len(rows)), place[rows]] + 1e-12)
                if not which:
                    y[rows - a] -= log_mass[(cls[rows] - HEAD) * tables.places + place[rows]]
        out[s] = y
    return out


def _descend(weights: np.ndarray, second: np.ndarray, used: np.ndarray, rows: np.ndarray, grad: np.ndarray) -> None:
    """AdaGrad with one step size a row, on the summed gradient of each row used; ``used`` counts tokens a row."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits sort by radix
    r = rows[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    g = np.add.reduceat(grad.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)  # two columns a step
    uniq = r[first]
    n = np.diff(np.append(first, len(r))).astype(np.float32)
    used[uniq] += n
    square = np.einsum("ij,ij->i", g, g) / n + second.take(uniq)
    second[uniq] = square
    g *= (np.float32(RATE) / np.sqrt(n * square))[:, None]
    weights[uniq] = weights.take(uniq, axis=0) - g


def learn(tables: Tables, model, second, used, idx: np.ndarray, starts: np.ndarray) -> None:
    """Gradient steps over the tokens, in place."""
    head, cls, place, feats = features(tables, idx, starts)
    for a in range(0, len(idx), BATCH):
        s = slice(a, a + BATCH)
        f = [x[s] for x in feats]
        p = _softmax(_logits(tables.prior, model[:3], f))
        p[np.arange(len(p)), cls[s]] -= 1
        for k in range(3):
            _descend(model[k], second[k], used[k], f[k], p)
        for which in (True, False):
            rows = np.flatnonzero(head[s] == which) + a
            if len(rows):
                at, own, q = _within(tables, model, which, cls, feats, rows)
                q[np.arange(len(rows)), place[rows]] -= 1
                for k, own_rows in enumerate(own):
                    _descend(model[at + k], second[at + k], used[at + k], own_rows, q)


def _cut(k: int, rows: int) -> slice:
    """Rows of block ``k`` of a table."""
    return slice(k * rows // BLOCKS, (k + 1) * rows // BLOCKS)


def mix(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (rows x width), second moments and token counts a row of several shards, as one.

    Each row is averaged by the tokens that used it in each shard, so shards that never saw a feature don't
    take from what others learnt of it; a row nobody used stays as it was.
    """
    w, s, total = np.float32(0), np.float32(0), np.float32(0)
    for weights, second, used in shards:
        share = used + np.float32(1e-6)
        w, s, total = w + weights * share[:, None], s + second * share, total + share
    return w / total[:, None], s / total, sum(used for _, _, used in shards)


def train(docs: DataFrame, tables: Tables, rounds: int | None = None) -> list[np.ndarray]:
    """Every token of ``docs`` is learnt from once, by iterative parameter mixing.

    A hash deals documents to ROUNDS rounds and to shards of about SHARD tokens a round. In each round every shard
    makes its own gradient steps, over its documents by id, from the model mixed so far; the shards' rows, cut into blocks, are
    averaged by the tokens that used them (``mix``) in a tree of at most FANIN models a task. Shards keep their size
    however large the input; beyond TASKS of them a task learns several, each from the mixed model, and averages them as
    it goes. Neither the input's partitions nor the cluster's size has a bearing on the model.
    """
    model, rounds = new_model(tables), rounds or ROUNDS
    second = [np.full(len(w), 1e-2, np.float32) for w in model]
    shards = max(1, -(-int(tables.n) // (rounds * SHARD)))
    hashed = F.xxhash64("doc_id", "text")
    src = id_and_bytes(docs).withColumn("h", hashed).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    turn, known = F.pmod("h", F.lit(rounds)), docs.sparkSession.sparkContext.broadcast(tables)
    for r in range(rounds):
        _round(src.where(turn == r), shards, known, model, second)
    return model


def _round(src: DataFrame, shards: int, known, model, second) -> None:
    """One round of training, in place; ``known`` is the broadcast tables."""
    sent = src.sparkSession.sparkContext.broadcast(([w.astype(np.float16) for w in model], second))
    schema = pa.schema([("block", pa.int32()), ("shard", pa.int64()), *((c, pa.binary()) for c in ("w", "s", "used"))])
    widths = [w.shape[1] for w in model]
    sizes = [len(w) for w in model]

    def packed(tables3):
        return [b"".join(np.ascontiguousarray(x, kind).tobytes() for x in col) for col, kind in zip(tables3, (np.float16, np.float32, np.float32))]

    def unpacked(k, w, s, used):
        w, s, used = np.frombuffer(w, np.float16), np.frombuffer(s, np.float32), np.frombuffer(used, np.float32)
        at = row = 0
        for width, size in zip(widths, sizes):
            n = _cut(k, size).stop - _cut(k, size).start
            yield w[at : at + n * width].reshape(n, width).astype(np.float32), s[row : row + n], used[row : row + n]
            at, row = at + n * width, row + n

    def run(batches):
        tables, (start, moments) = known.value, sent.value
        ranks, mixed = tables.lookup(), None
        for _, rows in itertools.groupby(_by_shard(batches), key=lambda x: x[0]):
            model, second = [w.astype(np.float32) for w in start], [x.copy() for x in moments]
            used = [np.zeros(len(w), np.float32) for w in model]
            for _, texts in _some((b for _, b in rows), CUT):
                words, code, starts = cut(texts)
                learn(tables, model, second, used, _indices(ranks, words, tables.places)[code], starts)
            own = list(zip(model, second, used))
            mixed = own if mixed is None else [mix(pair) for pair in zip(mixed, own)]
        if mixed is not None:
            task = TaskContext.get().partitionId()
            for k in range(BLOCKS):
                parts = [[x[_cut(k, len(x))] for x in col] for col in zip(*mixed)]
                yield batch(schema, [k], [task], *([x] for x in packed(parts)))

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")  # sums of floats depend on their order
        k = int(pdf.block.iloc[0])
        tables = zip(*(list(unpacked(k, *x)) for x in zip(pdf.w, pdf.s, pdf.used)))
        w, s, used = packed(list(zip(*(mix(list(t)) for t in tables))))
        return pd.DataFrame({"block": [k], "shard": [int(pdf.shard.iloc[0]) // FANIN], "w": [w], "s": [s], "used": [used]})

    kind = "block int, shard long, w binary, s binary, used binary"
    tasks = min(shards, TASKS)
    dealt = src.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "doc_id", "h").select("shard", "doc_id", "text")
    rows, left = dealt.mapInArrow(run, kind), tasks
    while True:
        rows = rows.groupBy("block", F.floor(F.col("shard") / FANIN).alias("g")).applyInPandas(mean, kind)
        left = -(-left // FANIN)
        if left <= 1:
            break
    for r in rows.collect():
        for t, (w, s, _) in enumerate(unpacked(r.block, r.w, r.s, r.used)):
            model[t][_cut(r.block, sizes[t])], second[t][_cut(r.block, sizes[t])] = w, s
    sent.unpersist()


def score(docs: DataFrame, counts: DataFrame, tables: Tables, model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every whole text; null texts have the end only.

    Known words are scored where the text is; the others of a text are joined with the exact counts,
    summed per text and added.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((tables, model))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.binary()))])

    def run(batches):
        tables, model = sent.value
        log_c, known = np.r_[np.log10(tables.counts + 1), 0.0], tables.lookup()
        tail_log = np.r_[np.where(np.arange(len(tables.counts)) < VOCAB, 0, log_c[:-1]), 0.0]
        row = TaskContext.get().partitionId() << 40
        for ids, texts in _some(batches, CUT):
            words, code, starts = cut(texts)
            idx = _indices(known, words, tables.places)[code]
            y = log_probs(tables, model, idx, starts) * LOG10E
            at = np.where(idx >= 0, idx, -1)
            total = [np.add.reduceat(x, starts) for x in (np.ones(len(idx), np.int64), (idx >= 0).astype(np.int64), log_c[at], y + tail_log[at])]
            rare = np.r_[0, np.cumsum(np.add.reduceat((idx < 0).astype(np.int32), starts))].astype(np.int32)
            lists = pa.ListArray.from_arrays(rare, _bare(words.take(pa.array(code[idx < 0]))))
            yield batch(schema, np.arange(row, row + len(ids)), ids, *total, lists)
            row += len(ids)

    part = written(id_and_bytes(docs).mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, logs double, score double, rare array<binary>"), "scored")
    rare = part.select("row", F.explode("rare").alias("word")).join(counts, "word")
    more = rare.groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("n") + 1)).alias("x"))
    extra = F.coalesce("x", F.lit(0.0))
    base = F.col("logs") + extra - F.col("n_tokens") * float(np.log10(tables.n + tables.v + 1))
    return part.join(more, "row", "left").select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), base.alias("base_score"), (F.col("score") + extra).alias("score"))


def score_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    Counts and weights are learnt from all documents outside the held-out fold. Null texts are their end alone, texts are read
    whole, and repeated rows count and are scored again; an empty table gives no rows. Without any to learn from the base
    is that of an empty vocabulary and the model uniform over its classes.
    """
    usable = docs.where(~fold(7))
    counts = written(count_words(usable), "counts")
    tables = Tables(counts)
    model = train(usable, tables)
    out = score(docs, counts, tables, model)
    return out.select("doc_id", fold(7).alias("held_out"), "n_tokens", "n_known", F.lit(tables.n).cast("long").alias("train_tokens"), "base_score", "score")
