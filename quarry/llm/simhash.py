"""SimHash near-duplicates: fingerprints, a binary-trie self-join and components."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm import nearcopies
from quarry.llm.common import batch, fresh, id_and_bytes, key_runs, mix64, written
from quarry.llm.components import connected_components

SHINGLE, BITS, ERRORS = 4, 64, 4
#: A bucket with more fingerprints is dealt out over pairs of parts of about this size.
PART = 40_000
#: Shingles of a long text whose bits are counted at once.
SHINGLES = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 (seed 42) of the text's word shingles.

    Repeated shingles count each time; a text of fewer words has one shingle; no word gives zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return h(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    stops, ones = (ends[size - 1 :] - 1).tolist(), np.zeros(BITS, np.int64)
    for k in range(0, len(stops), SHINGLES):
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts[k : k + SHINGLES], stops[k : k + SHINGLES])], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(stops), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64)
            yield batch(schema, b.column(0), fps.view(np.int64))

    return id_and_bytes(docs).mapInArrow(run, "doc_id long, fp long")


def trie_self_join(group: np.ndarray, fps: np.ndarray, errors: int = ERRORS):
    """Links between fingerprints of one group that differ in at most ``errors`` bits.

    Fingerprints sorted by (group, value) are a forest of binary tries whose nodes are index
    ranges. A frontier of node pairs goes down together one bit at a time, with the differing bits
    so far; a pair over the budget is pruned, and a pair that can't exceed it any more is taken
    whole, by links to its first members. Yields index arrays (i, j); together they connect every
    linked pair, though not each by its own link.
    """
    order = np.lexsort((fps, group))
    f, g = fps[order], group[order]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    ends = np.r_[starts[1:], len(g)]
    alone = ends - starts > 1
    s, e = starts[alone], ends[alone]
    stack = [(0, s, e, s, e, np.zeros(len(s), np.int8))]
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if not len(a0):
            continue
        if len(a0) > 100_000:
            h = len(a0) // 2
            stack += [(depth, *(x[:h] for x in (a0, a1, b0, b1, err))), (depth, *(x[h:] for x in (a0, a1, b0, b1, err)))]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j, w = a0[single], b0[single], err[single]
            rest = BITS - depth
            x = (f[i] ^ f[j]) & np.uint64((1 << rest) - 1)
            near = (np.bitwise_count(x) + w <= errors) & (i != j)
            yield order[i[near]], order[j[near]]
        whole = ~single & (err + (BITS - depth) <= errors)
        if whole.any():
            for p0, p1, q0, q1 in zip(a0[whole], a1[whole], b0[whole], b1[whole]):
                members = np.r_[np.arange(p0, p1), np.arange(q0, q1)]
                yield order[members], np.full(len(members), order[p0])
        go = ~single & ~whole
        if not go.any():
            continue
        a0, a1, b0, b1, err = (x[go] for x in (a0, a1, b0, b1, err))
        bit = np.uint64(BITS - 1 - depth)
        am, bm = _split(f, a0, a1, bit), _split(f, b0, b1, bit)
        same = (a0 == b0) & (a1 == b1)
        parts = []
        for p0, p1, q0, q1, add, keep in ((a0, am, b0, bm, 0, None), (am, a1, bm, b1, 0, None), (a0, am, bm, b1, 1, None), (am, a1, b0, bm, 1, ~same)):
            ok = (p1 > p0) & (q1 > q0) & (err + add <= errors)
            ok &= ~((p0 == q0) & (p1 - p0 == 1) & (q1 - q0 == 1))
            if keep is not None:
                ok &= keep
            parts.append((p0[ok], p1[ok], q0[ok], q1[ok], err[ok] + np.int8(add)))
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))


def _split(f: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First index in [lo, hi) whose ``bit`` is set, by binary search in every range at once."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        up = ((f[np.minimum(mid, len(f) - 1)] >> bit) & np.uint64(1)) == 0
        lo = np.where(open_ & up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def spanning_links(group: np.ndarray, fps: np.ndarray, errors: int = ERRORS) -> tuple[np.ndarray, np.ndarray]:
    """The trie join's links thinned to a forest: at most one link a fingerprint."""
    root = np.arange(len(fps))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in trie_self_join(group, fps, errors):
        a, b = root[i], root[j]
        for x, y in np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0).tolist():
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    for _ in range(64):
        up = root[root]
        if (up == root).all():
            break
        root = up
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return linked, root[linked]


def block_count(n: int, errors: int = ERRORS, part: int = PART) -> int:
    """Bit blocks that copy each of ``n`` fingerprints least often: more blocks give more and longer keys."""
    def copies(m):
        return comb(m, errors) * max(1.0, n / 2.0 ** (BITS * (m - errors) / m) / part)

    return min(range(errors + 1, errors + 5), key=copies)


def masks(blocks: int, errors: int = ERRORS) -> list[int]:
    """Signed 64-bit masks of every choice of ``blocks - errors`` bit blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    sums = [sum(c) for c in combinations(own, blocks - errors)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in sums]


def scattered(fp: np.ndarray) -> np.ndarray:
    """The node that stands for each fingerprint, whatever its bits: a bijection."""
    return mix64(fp.view(np.uint64)).view(np.int64)


def links(distinct: DataFrame, errors: int = ERRORS, part: int = PART, blocks: int | None = None, node=None) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)`` fingerprints whose links connect all pairs within ``errors`` bits, or what ``node`` makes of them.

    Of ``blocks`` bit blocks two linked fingerprints agree in all but ``errors`` at least, so each
    is dealt out by every choice of ``blocks - errors`` blocks; their number follows from the number of
    fingerprints (``block_count``). A key with more than ``part`` fingerprints is cut into parts
    and every pair of parts is one unit of work.
    """
    keys = masks(blocks or block_count(distinct.count(), errors, part), errors)
    spec = F.array(*[F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("v")) for k, m in enumerate(keys)])
    rows = distinct.select("fp", F.explode(spec).alias("s")).select("fp", F.col("s.t").alias("t"), F.col("s.v").alias("v"))
    sizes = rows.groupBy("t", "v").count().where(f"count > {part}").select("t", "v", F.ceil(F.col("count") / part).cast("int").alias("parts"))
    rows = rows.join(sizes, ["t", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    unit = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(pairs)
    rows = rows.select("fp", "t", "v", F.explode(unit).alias("p")).select("fp", F.xxhash64("t", "v", "p.i", "p.j").alias("unit"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in key_runs(batches, "unit", 20_000):
            fp = t.column("fp").to_numpy().view(np.uint64)
            i, j = spanning_links(t.column("unit").to_numpy(), fp, errors)
            ends = fp[i].view(np.int64), fp[j].view(np.int64)
            yield batch(schema, *(map(node, ends) if node else ends))

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def joined(distinct: DataFrame, errors: int = ERRORS) -> DataFrame:
    """``distinct(fp)`` -> ``(fp, label)``: one label for all fingerprints that links of at most ``errors`` bits connect.

    A task never runs two Python steps at once: each would need a worker, and an executor keeps as many as it ever needed, with
    all that the later stages' tasks leave in them.
    """
    schema = pa.schema([("fp", pa.int64()), ("node", pa.int64())])

    def name(batches):
        for b in batches:
            yield batch(schema, b.column(0), scattered(b.column(0).to_numpy()))

    labels = connected_components(links(distinct, errors, node=scattered))
    named = distinct.mapInArrow(name, "fp long, node long")
    return named.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, errors: int = ERRORS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, component_size.

    component_id is the smallest doc_id reachable over links of at most ``errors`` differing bits.
    Null texts count as empty, empty texts share the zero fingerprint and are linked like any
    other, repeated rows are kept, no rows give no rows. Exact copies meet once, by fingerprint:
    only distinct fingerprints are joined.
    """
    fps = written(fingerprints(docs, size), "fp")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "nodes")
    nodes = nodes.join(joined(nodes.select("fp"), errors), "fp")
    least = nodes.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("n").alias("component_size"))
    by_fp = nodes.select("fp", "label").join(least, "label").select("fp", "component_id", "component_size")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return fps.join(by_fp, "fp").select("doc_id", hexed, "component_id", "component_size")


def near_groups(rows: DataFrame) -> DataFrame:
    """``rows(row, text)`` -> ``(row, key)``: one key for all rows whose fingerprints the trie join connects."""
    fps = written(fingerprints(rows.select(F.col("row").alias("doc_id"), "text")).toDF("row", "fp"), "fp")
    distinct = written(fps.select("fp").distinct(), "nodes")
    return fps.join(joined(distinct), "fp").select("row", F.col("label").alias("key"))


def keep_one(docs: DataFrame, size: int = nearcopies.SHINGLE, similarity: float = nearcopies.SIMILARITY) -> DataFrame:
    """The documents without near-duplicates: of each component exactly one row stays.

    That is the one with the smallest id; null ids come last, and rows of one id are told apart by their
    place in the input: of equal rows one stays, and rows of one id with unlike texts are different documents.
    Near-duplicates have ``similarity`` or more of their ``size``-word shingles in common. Candidates are the groups that
    the trie join of the fingerprints connects, held to that similarity exactly. Fingerprints of such texts lie up to
    14 bits apart, so MinHash bands beside it bring the pairs that are out of its reach (``nearcopies``).
    """
    row = fresh(docs, "_row")
    held = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    rows = id_and_bytes(held, F.col(row).alias("row")).select("row", "doc_id", "text")
    found = nearcopies.components(rows, size, similarity, near_groups(rows))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    out = found.groupBy("label").agg(first).select(F.col("first.row").alias(row))
    return held.join(out, row, "left_semi").drop(row)
