"""Suffix-array deduplication: every byte under a long enough repeated string goes.

The corpus-wide question is cut into small exact ones. Each string of LENGTH bytes has one anchor, the
place in it whose CORE-byte string has the least hash; equal strings have equal anchors at equal
places. An anchor owns the run of strings it anchors, and its context is the bytes of that run.
Contexts meet by the core's hash; copies of one context are merged and counted first. The contexts of some
cores at a time are one part of the corpus, and a suffix array over it, built by linear grouping, brings equal
strings together: runs of neighbours whose common prefixes are long enough.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import batch, id_and_bytes, key_runs, written

LENGTH, CORE = 400, 128
SPREAD = LENGTH - CORE + 1
#: Bytes a symbol of the suffix array; contexts are ordered in parts of about CONTEXTS.
SYMBOL, CONTEXTS = 32, 3000
#: Contexts of a core with more than this are cut into pieces that meet by more of their bytes.
KINDS = 1000
#: Texts are read in pieces of so many strings' starts, so one piece's arrays stay small.
PIECE = 1 << 22
_BASE = 0x9E3779B97F4A7C15


def lyndon_suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text``, whose last symbol must be its unique least one.

    Groups hold the suffixes that share a Lyndon prefix. They are taken from the greatest down: each
    suffix of the group finds the nearest earlier position of a smaller group over pointers, and
    the suffixes found move to new groups just above their own, higher the more group members
    follow them. Then each group's order is emitted from the left, again over the pointers.
    """
    n = len(text)
    order = np.argsort(np.asarray(text), kind="stable")
    sa: list[int] = order.tolist()
    t = np.asarray(text)[order]
    heads = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if n else np.empty(0, int)
    size = [0] * (n + 1)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), n]):
        size[a] = b - a
    group = np.empty(n, np.int64)
    group[order] = np.repeat(heads, np.diff(np.r_[heads, n]))
    group = group.tolist()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    before = [-1] * n
    end = n
    while end > 0:
        start = group[sa[end - 1]]
        members = sorted(sa[start:end]) if end - start > 1 else [sa[start]]
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, k in times.items():
            by_times.setdefault(k, []).append(p)
        for k in sorted(by_times, reverse=True):
            taken: dict[int, int] = {}
            for p in by_times[k]:
                g = group[p]
                size[g] -= 1
                taken[g] = taken.get(g, 0) + 1
                last, here = g + size[g], place[p]
                other = sa[last]
                sa[here], place[other] = other, here
                sa[last], place[p] = p, last
            top = {g: g + size[g] for g in taken}
            for g, c in taken.items():
                size[top[g]] = c
            for p in by_times[k]:
                group[p] = top[group[p]]
        end = start
    out, done, slot = [-1] * n, bytearray(n), list(range(n))
    out[0], done[n - 1] = n - 1, 1
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            out[slot[g]] = p
            slot[g] += 1
            done[p] = 1
            p = before[p]
    return out


def _window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(raw: np.ndarray, length: int = LENGTH, core: int = CORE):
    """(anchor, first, last) string starts owned by each anchor, and the cores' hashes, in one text."""
    h, have, power = raw.astype(np.uint64) + np.uint64(1), 1, _BASE
    while have < core:
        h = h[:-have] * np.uint64(power) + h[have:]
        power, have = power * power & 0xFFFFFFFFFFFFFFFF, have * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    packed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    who = (_window_min(packed, length - core + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    return who[first], first, np.r_[first[1:], len(who)] - 1, h[who[first]]


def contexts(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(core, context, doc, at, n, left): per anchor the hashes, its text, the first start and their number.

    ``doc`` is a hash of id and text, so that rows that repeat an id stay apart; equal rows share it
    and count each.
    """
    schema = pa.schema([("core", pa.int64()), ("context", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("left", pa.int32())])

    def run(batches):
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            # short texts go through the array steps joined; strings across a border are cut off after
            texts, docs_ = b.column(1), b.column(2).to_pylist()
            k = 0
            while k < len(docs_):
                part, size = [], 0
                while k < len(docs_) and size < PIECE:
                    t = texts[k].as_py()
                    if part and len(t) > PIECE:
                        break  # a very long text goes alone, in pieces
                    size += len(t)
                    part.append((docs_[k], t))
                    k += 1
                out = [[] for _ in range(6)]
                if len(part) > 1:
                    _own(b"".join(t for _, t in part), part, 0, out, digest, length, core)
                else:
                    doc, t = part[0]
                    for a in range(0, max(1, len(t) - length + 1), PIECE):
                        _own(t[a : a + PIECE + length - 1], part, a, out, digest, length, core)
                yield batch(schema, *(np.concatenate(x) if x else np.empty(0, np.int64) for x in out))

    src = id_and_bytes(docs).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("doc"))
    return src.mapInArrow(run, "core long, context long, doc long, at long, n int, left int")


def _own(raw: bytes, part, base: int, out, digest, length: int, core: int) -> None:
    if len(raw) < length:
        return
    who, first, last, h = anchors(np.frombuffer(raw, np.uint8), length, core)
    if len(part) > 1:
        ends = np.cumsum([len(t) for _, t in part])
        begins = np.r_[0, ends[:-1]]
        keep_at, keep_to, keep_who, keep_h, owner = [], [], [], [], []
        # a run of starts may span texts: cut it at each text's first start and last whole string
        which0, which1 = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "right")
        for same in (True, False):
            rows = np.flatnonzero((which0 == which1) == same)
            if same:
                keep_at.append(first[rows]), keep_to.append(last[rows]), keep_who.append(who[rows]), keep_h.append(h[rows]), owner.append(which0[rows])
            else:
                for r in rows:
                    for d in range(which0[r], which1[r] + 1):
                        keep_at.append([max(first[r], begins[d])]), keep_to.append([min(last[r], ends[d] - 1)]), keep_who.append([who[r]]), keep_h.append([h[r]]), owner.append([d])
        first, last, who, h, owner = (np.concatenate(x) for x in (keep_at, keep_to, keep_who, keep_h, owner))
        last = np.minimum(last, ends[owner] - length)
        ok = last >= first
        first, last, who, h, owner = (x[ok] for x in (first, last, who, h, owner))
        doc = np.array([d for d, _ in part], np.int64)[owner]
        at = first - begins[owner]
    else:
        doc, at = np.full(len(first), part[0][0], np.int64), first + base
    if not len(first):
        return
    left = who - first
    ctx = np.fromiter((digest(raw[a:e], s) for a, e, s in zip(first.tolist(), (last + length).tolist(), left.tolist())), np.uint64, len(first))
    for x, v in zip(out, (h.astype(np.uint64).view(np.int64), ctx.view(np.int64), doc, at, (last - first + 1).astype(np.int32), left.astype(np.int32))):
        x.append(v)


def repeated_starts(bodies: list[bytes], left: np.ndarray, copies: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For contexts ``bodies`` with anchors at ``left``: which of each one's strings occur twice or more in the part.

    The part's text is each context's blocks of SYMBOL bytes, laid out from the anchor, as symbols of a suffix
    array. A string that begins r bytes before a block is repeated if its context has copies, or another
    suffix shares length - r bytes with that block's suffix, so that both lie in one run of the order, and the r bytes before it.
    """
    head = left % SYMBOL
    blocks = np.array([-(-(len(b) - h) // SYMBOL) for b, h in zip(bodies, head.tolist())])
    at = np.cumsum(blocks) - blocks
    wide = int(blocks.sum())
    flat = np.zeros((wide, SYMBOL + 1), np.uint8)
    for body, h, a, k in zip(bodies, head.tolist(), at.tolist(), blocks.tolist()):
        own = np.zeros(k * SYMBOL, np.uint8)
        own[: len(body) - h] = np.frombuffer(body, np.uint8)[h:]
        flat[a : a + k, :SYMBOL] = own.reshape(k, SYMBOL)
        flat[a : a + k, SYMBOL] = SYMBOL
        flat[a + k - 1, SYMBOL] = len(body) - h - (k - 1) * SYMBOL
    _, symbol = np.unique(np.ascontiguousarray(flat).view(f"V{SYMBOL + 1}").reshape(-1), return_inverse=True)
    owner = np.repeat(np.arange(len(bodies)), blocks)
    place = np.arange(wide) + owner  # of each block in the text: one end mark behind every context
    steps = -(-length // SYMBOL) + 1
    text = np.ones(wide + len(bodies) + 1 + steps, np.int64)
    text[place] = symbol + 2
    text[wide + len(bodies) :] = 0
    block_at = np.full(len(text), wide)  # the row of an end mark is empty
    block_at[place] = np.arange(wide)
    flat = np.concatenate([flat, np.zeros((1, SYMBOL + 1), np.uint8)])
    order = np.asarray(lyndon_suffix_array(text[: wide + len(bodies) + 1].tolist()))
    # the suffixes that begin at or before their context's anchor, in order
    block = block_at[order]
    block = block[block < wide]
    begin = head[owner[block]] + SYMBOL * (block - at[owner[block]])  # in its context
    block = block[begin <= left[owner[block]]]
    own, size = owner[block], np.array([len(b) for b in bodies])
    begin = head[own] + SYMBOL * (block - at[own])
    shared = _common_prefixes(text, flat, block_at, place[block], size[own] - begin, steps)
    # classes of equal bytes before a block, one byte more each time
    data = np.frombuffer(b"".join(bodies), np.uint8)
    base = (np.cumsum(size) - size)[own] + begin
    last = size[own] - length  # the last start of the context
    hits = [np.full(n, c > 1) for n, c in zip((size - length + 1).tolist(), copies.tolist())]
    before = np.zeros(len(block), np.int64)
    for r in range(min(SYMBOL, length)):
        live = begin >= r
        if r:
            grown = np.where(live, before * 256 + data[np.maximum(base - r, 0)], -1)
            before = np.unique(grown, return_inverse=True)[1]
        live &= begin - r <= last
        run = np.cumsum(shared < length - r)
        rows = np.flatnonzero(live)
        pair = run[rows] * (len(block) + 1) + before[rows]
        srt = np.argsort(pair, kind="stable")
        same = pair[srt][1:] == pair[srt][:-1]
        for i in rows[srt[np.r_[same, False] | np.r_[False, same]]].tolist() if same.any() else ():
            hits[own[i]][begin[i] - r] = True
    return hits


def _common_prefixes(text, flat, block_at, start: np.ndarray, size: np.ndarray, steps: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in ``start``, up to ``steps`` symbols; -1 for the first."""
    a, b = start[:-1], start[1:]
    same, equal = np.zeros(len(b), np.int64), np.ones(len(b), bool)
    for k in range(steps):
        equal &= (text[a + k] == text[b + k]) & (text[a + k] > 1)
        same += equal
    rows_a, rows_b = flat[block_at[a + np.minimum(same, steps - 1)]], flat[block_at[b + np.minimum(same, steps - 1)]]
    differ = rows_a[:, :SYMBOL] != rows_b[:, :SYMBOL]
    more = np.where(differ.any(axis=1), differ.argmax(axis=1), SYMBOL)
    shared = np.where(equal, steps * SYMBOL, SYMBOL * same + np.minimum(more, np.minimum(rows_a[:, SYMBOL], rows_b[:, SYMBOL])))
    return np.r_[-1, np.minimum(shared, np.minimum(size[1:], size[:-1]))] if len(start) else np.empty(0, np.int64)


def _ranges(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return [{"a": int(a), "b": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _pieces(body: bytes, left: int, lo: int, hi: int, length: int):
    """The two pieces of a context whose strings begin ``lo`` to ``hi`` bytes before the anchor: (key, lo, hi, first start, left, body).

    All strings that begin so far before equal anchors share the bytes that the key is a hash of.
    """
    n, middle = len(body) - length + 1, (lo + hi) // 2
    for l, h in ((lo, middle), (middle + 1, hi)):
        first, last = max(0, left - h), min(n - 1, left - l)
        if l <= h and first <= last:
            key = xxhash.xxh3_64_intdigest(body[left - l : left + length - h], l << 16 | h)
            yield key, l, h, first, left - first, body[first : last + length]


def _cut_hot(hot: DataFrame, length: int, core: int) -> DataFrame:
    """``hot(core, context, copies, left, body)`` cut until no key has more than KINDS different pieces:
    (core, context, key, piece, shift, copies, left, body).

    Every cut halves the strings of a piece, so the last one has single strings, of which a key has one.
    """
    schema = pa.schema([*((c, pa.int64()) for c in ("core", "context", "key", "piece", "lo", "hi", "shift", "copies", "left")), ("body", pa.binary())])

    def cut(batches):
        for b in batches:
            rows = []
            for *own, lo, hi, shift, copies, left, body in zip(*(c.to_pylist() for c in b.columns)):
                for key, l, h, first, at, part in _pieces(body, left, lo, hi, length):
                    piece = xxhash.xxh3_64_intdigest(part, at)
                    rows.append((*own, *(x - (1 << 64) if x >> 63 else x for x in (key, piece)), l, h, shift + first, copies, at, part))
            yield batch(schema, *(zip(*rows) if rows else [[]] * len(schema)))

    kinds = ", ".join(f"{f.name} long" for f in schema)[: -len("long")] + "binary"
    rows, done = hot.select("core", "context", F.lit(0).alias("lo"), F.lit(length - core).alias("hi"), F.lit(0).alias("shift"), "copies", "left", "body"), None
    while True:
        rows = written(rows.mapInArrow(cut, kinds), "pieces")
        over = rows.select("key", "piece").distinct().groupBy("key").count().where(F.col("count") > KINDS).select("key")
        over = written(over, "over")
        some = rows.join(over, "key", "left_anti")
        done = some if done is None else done.unionByName(some)
        if over.isEmpty():
            return done.drop("lo", "hi")
        rows = rows.join(over, "key", "left_semi").select("core", "context", "lo", "hi", "shift", "copies", "left", "body")


def repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """(doc, a, b): string starts a <= p < b in a text (by its hash) that occur elsewhere too.

    Exact. Copies of a context are merged on the map side first, with their number; where a core has different
    contexts, those are sent on as bytes and ordered. Contexts of a core with more than KINDS of them are cut into pieces
    (``_cut_hot``), so that a large family of near copies goes to many tasks and meets in the same order.
    """
    spark = docs.sparkSession
    all_ = written(contexts(docs, length, core), "contexts")
    same = all_.groupBy("core", "context").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "at", "n", "left")).alias("one"))
    per = same.groupBy("core").agg(F.sum("copies").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    live = written(same.join(per.select("core", "kinds"), "core"), "live")
    mixed = live.where("kinds > 1").select("core", "context", "copies", "kinds", "one.*")
    want = mixed.groupBy("doc").agg(F.collect_list(F.struct("core", "context", "copies", "kinds", "at", "n", "left")).alias("want"))
    texts = id_and_bytes(docs).select(F.xxhash64("doc_id", "text").alias("doc"), "text")
    got = texts.join(want, "doc").select("text", F.explode("want").alias("w"))
    body = F.col("text").substr(F.col("w.at").cast("int") + 1, F.col("w.n") + length - 1)
    reps = written(got.select("w.core", "w.context", "w.copies", "w.kinds", "w.left", body.alias("body")).dropDuplicates(["core", "context"]), "bodies")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def order(batches):
        schema = pa.schema([("key", pa.int64()), ("piece", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
        for t in key_runs(batches, "key", CONTEXTS):
            hits = repeated_starts(t.column("body").to_pylist(), t.column("left").to_numpy().astype(np.int64), t.column("copies").to_numpy(), length)
            yield batch(schema, t.column("key").to_numpy(), t.column("piece").to_numpy(), [_ranges(h) for h in hits])

    def ordered(rows):  # (key, piece, copies, left, body) -> (key, piece, ranges)
        rows = rows.select("key", "piece", "copies", "left", "body").repartition(n, "key").sortWithinPartitions("key")
        return rows.mapInArrow(order, "key long, piece long, ranges array<struct<a:int,b:int>>").where("size(ranges) > 0")

    few = reps.where(F.col("kinds") <= KINDS).select(F.col("core").alias("key"), F.col("context").alias("piece"), "copies", "left", "body")
    marked = ordered(few).toDF("core", "context", "ranges")
    hot = reps.where(F.col("kinds") > KINDS)
    if not hot.isEmpty():
        pieces = written(_cut_hot(hot, length, core), "cut")
        merged = pieces.groupBy("key", "piece").agg(F.sum("copies").alias("copies"), F.first("left").alias("left"), F.first("body").alias("body"))
        ranges = F.transform("ranges", lambda r: F.struct((r["a"] + F.col("shift")).cast("int").alias("a"), (r["b"] + F.col("shift")).cast("int").alias("b")))
        marked = marked.unionByName(pieces.select("core", "context", "key", "piece", "shift").join(ordered(merged), ["key", "piece"]).select("core", "context", ranges.alias("ranges")))
    whole = live.where("copies > 1 and kinds = 1").select("core", "context", F.array(F.struct(F.lit(0).alias("a"), F.col("one.n").alias("b"))).alias("ranges"))
    out = all_.join(marked.unionByName(whole), ["core", "context"]).select("doc", "at", F.explode("ranges").alias("r"))
    return out.select("doc", (F.col("at") + F.col("r.a")).alias("a"), (F.col("at") + F.col("r.b")).alias("b"))


def dedup(docs: DataFrame, length: int = LENGTH, core: int = CORE, texts: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, kept (binary).

    Every byte goes that lies in a string of ``length`` bytes which begins anywhere else too, in another
    document or the same; matches never cross documents. Shorter, null and empty texts lose
    nothing; of equal rows each loses what it shares with the others.
    """
    spans = repeats(docs, length, core).groupBy("doc").agg(F.array_distinct(F.collect_list(F.struct("a", "b"))).alias("spans"))
    src = id_and_bytes(docs).withColumn("doc", F.xxhash64("doc_id", "text")).join(spans, "doc", "left").select("doc_id", "text", F.expr("transform(spans, s -> s.a)").alias("a"), F.expr("transform(spans, s -> s.b)").alias("b"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * texts)

    def run(batches):
        for b in batches:
            rows = []
            for doc, text, a, e in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                text, removed, merged = text.as_py(), 0, []
                for s, t in sorted(zip(a or [], e or [])):
                    t += length - 1
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], t)
                    else:
                        merged.append([s, t])
                kept, at = [], 0
                for s, t in merged:
                    kept.append(text[at:s])
                    removed, at = removed + t - s, t
                kept = b"".join([*kept, text[at:]])
                rows.append((doc, len(text), removed, len(merged), hashlib.sha256(kept).hexdigest()) + (kept,) * texts)
            if rows:
                yield batch(schema, *zip(*rows))

    return src.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
