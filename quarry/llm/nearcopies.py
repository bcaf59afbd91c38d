"""Near copies by the exact Jaccard similarity of word shingles; candidates from given groups and from MinHash bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import batch, key_runs, mix64, written
from quarry.llm.components import connected_components
from quarry.llm.decontaminate import _WordHashes, shingle_hashes, shingles

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at similarity 0.8 shares no band of ROWS MinHashes with probability (1 - 0.8 ** 5) ** 32 = 3e-6.
BANDS, ROWS = 32, 5
#: Buckets are compared with one member of each up to STARS times, while a round brings what is apart below GAIN of what it was.
STARS, GAIN = 6, 0.7
#: What is still apart is compared in units of at most two parts of a bucket, of about so many texts and bytes of shingle hashes each.
PART, PART_BYTES = 16384, 8 << 20
#: A text that is compared with more others than this is sent to several tasks, each with its share of them.
HUB = 4096
_ODD = mix64(np.arange(1, BANDS * ROWS + 1).astype(np.uint64))[:, None] | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def band_keys(words: list[bytes], hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """A key of each band for the words' shingles; fewer words than a shingle has meet by equality alone."""
    if len(words) < size:
        return np.empty(0, np.int64)
    h = mix64(np.unique(shingle_hashes(words, hashes, size)))
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(h), 512):
        np.minimum(least, (h[k : k + 512] * _ODD).min(axis=1), out=least)
    rows, key = least.reshape(BANDS, ROWS), np.arange(BANDS).astype(np.uint64)
    for k in range(ROWS):
        key = mix64(key * _STEP + rows[:, k])
    return key.view(np.int64)


def signatures(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``rows(row, doc_id, text)`` -> ``(row, doc_id, node, bands)``; texts of the same A-Z lower-cased words share a node."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        hashes = _WordHashes()
        for b in batches:
            nodes, keys = [], []
            for t in b.column(2):
                words = t.as_py().lower().split()
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                keys.append(band_keys(words, hashes, size))
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, keys)]).astype(np.int32), np.concatenate([np.empty(0, np.int64), *keys]))
            yield batch(schema, b.column(0), b.column(1), np.array(nodes, np.uint64).view(np.int64), lists)

    return rows.mapInArrow(run, "row long, doc_id long, node long, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` whose texts' sets of shingles have at least this Jaccard similarity, exactly."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        last, right = None, set()
        for t in batches:
            out = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in t.columns)):
                if b != last:
                    last, right = b, shingles(tb.lower().split(), size)
                left = shingles(ta.lower().split(), size)
                both = len(left & right)
                if both >= similarity * (len(left) + len(right) - both):
                    out.append((a, b))
            yield batch(schema, *(zip(*out) if out else [[], []]))

    left, right = pairs, texts.toDF("b", "tb")
    on = ["b"]
    hubs = written(pairs.groupBy("b").agg(F.count("*").alias("n")).where(F.col("n") > HUB).select("b", F.ceil(F.col("n") / HUB).cast("int").alias("shares")), "hubs")
    if not hubs.isEmpty():  # few: at most one of HUB pairs
        left = left.join(F.broadcast(hubs), "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("shares")), F.lit(0)).cast("int").alias("share"))
        right = right.join(F.broadcast(hubs), "b", "left").select("b", "tb", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"))
        on = ["b", "share"]
    both = left.join(texts.toDF("a", "ta"), "a").join(right, on).select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """``texts(node, text)`` -> ``(node, h)``: the different hashes of each text's shingles, as 64-bit integers in bytes."""
    schema = pa.schema([("node", pa.int64()), ("h", pa.binary())])

    def run(batches):
        hashes = _WordHashes()
        for b in batches:
            yield batch(schema, b.column(0), [np.unique(shingle_hashes(t.lower().split(), hashes, size)).tobytes() for t in b.column(1).to_pylist()])

    return texts.select("node", "text").mapInArrow(run, "node long, h binary")


def similar(sets: list[np.ndarray], labels: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of sets of different labels, and of different sides if there are two, whose Jaccard similarity is high
    enough: a forest that joins all labels which such pairs join.

    Two such sets share one of their rarest members, as many as may be missing from the other and one more; only sets that do
    are compared, so what most have in common costs nothing.
    """
    names, label, many = np.unique(labels, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return []
    sizes = np.array([len(x) for x in sets])
    _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    owner = np.repeat(np.arange(len(sets)), sizes)
    member = rank[word]
    member = member[np.lexsort((member, owner))]  # of each set, the rarest first
    at = np.r_[0, np.cumsum(sizes)]
    lead = np.minimum(sizes, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1)
    rare = np.flatnonzero(np.arange(len(member)) - np.repeat(at[:-1], sizes) < np.repeat(lead, sizes))
    order = np.argsort(member[rare], kind="stable")
    holder, cuts = owner[rare][order], np.r_[0, np.cumsum(np.bincount(member[rare], minlength=len(count)))]
    root, out, mark = np.arange(len(names)), [], np.zeros(len(count), bool)
    two = (side != side[0]).any()
    for a in np.flatnonzero(label != many.argmax()).tolist():  # of each pair one at least is outside the commonest label
        own = member[at[a] : at[a + 1]]
        met = [holder[i:j] for i, j in zip(cuts[own[: lead[a]]].tolist(), cuts[own[: lead[a]] + 1].tolist()) if j > i + 1]
        if not met:
            continue
        found = np.unique(np.concatenate(met))
        fits = (root[label[found]] != root[label[a]]) & (sizes[found] >= similarity * sizes[a]) & (sizes[a] >= similarity * sizes[found])
        found = found[fits & (side[found] != side[a])] if two else found[fits]
        if not len(found):
            continue
        mark[own] = True
        both = np.add.reduceat(mark[np.concatenate([member[at[b] : at[b + 1]] for b in found.tolist()])].astype(np.int64), np.r_[0, np.cumsum(sizes[found])[:-1]])
        mark[own] = False
        for b in found[both >= similarity * (sizes[a] + sizes[found] - both)].tolist():
            if root[label[b]] != root[label[a]]:
                root[root == root[label[b]]] = root[label[a]]
                out.append((a, b))
    return out


def links_apart(now: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """``now(key, node, label)`` -> ``(a, b)``: pairs that join all labels joined by a similar pair of one bucket.

    A bucket is cut into parts, and every pair of parts is one unit of work: a text goes to as many units as there are parts,
    and pairs never become rows. Parts are bounded by their texts' shingles, so that a task holds two of PART_BYTES, or a single
    text.
    """
    sets = written(shingle_sets(texts, size), "sets")
    sized = now.join(sets.select("node", F.length("h").alias("bytes")), "node")
    parts = sized.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / PART, F.sum("bytes") / PART_BYTES)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    rows = now.join(parts, "key").withColumn("own", own).select("key", "node", "label", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    lo, hi = F.least("own", "j"), F.greatest("own", "j")
    units = rows.select(F.xxhash64("key", lo, hi).alias("unit"), "node", "label", (F.col("own") > F.col("j")).cast("int").alias("side"))
    units = units.join(sets, "node").select("unit", "node", "label", "side", "h")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for t in key_runs(batches, "unit", 1):
            unit, node, label, side = (t.column(k).to_numpy() for k in range(4))
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column(4)]
            cuts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1], True]).tolist()
            found = [(node[i + a], node[i + b]) for i, j in zip(cuts, cuts[1:]) for a, b in similar(sets[i:j], label[i:j], side[i:j], similarity)]
            yield batch(schema, *(zip(*found) if found else [[], []]))

    n = int(now.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long").distinct()


def components(rows: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, groups: DataFrame | None = None) -> DataFrame:
    """``rows(row, doc_id, text)`` -> ``(row, doc_id, label)``: one label for all texts joined by links.

    A link is a Jaccard similarity of ``similarity`` or more between the sets of ``size``-word shingles of
    two texts, verified on the shingles themselves; texts without words are copies of each other. Texts
    are compared that share a band, or a key of ``groups(row, key)``. A bucket's texts are first compared with one of them, another
    one each round as long as that joins many, so that a large group of copies is joined by a linear number of pairs; then all
    that are still apart are compared within their buckets, whatever their size (``links_apart``).
    """
    signed = written(signatures(rows, size), "signed")
    reps = written(signed.groupBy("node").agg(F.min("row").alias("row")), "reps")
    one = signed.join(reps.select("row"), "row", "left_semi")
    keys = one.select("node", F.explode("bands").alias("key"))
    if groups is not None:  # texts without bands have no shingle and meet by equality alone
        keys = keys.unionByName(one.where(F.size("bands") > 0).join(groups, "row").select("node", F.xxhash64(F.lit("group"), "key").alias("key")))
    met = written(keys.join(keys.groupBy("key").count().where("count > 1").select("key"), "key").select("key", "node"), "met")
    texts = reps.join(met.select("node").distinct(), "node", "left_semi")
    texts = written(rows.select("row", "text").join(texts, "row").select("node", "text"), "texts")
    before, labels, links, tested = None, None, None, None
    for k in range(STARS + 1):
        now = met.withColumn("label", F.col("node")) if labels is None else met.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
        order = F.xxhash64("node", "key", F.lit(k))
        first = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min_by("node", order).alias("b"), F.min_by("label", order).alias("other")).where("lo < hi").select("key", "b", "other")
        now = written(now.join(first, "key"), "apart")
        left = now.count()
        if not left:
            break
        last = k == STARS or before is not None and left > GAIN * before
        before = left
        if last:
            pairs = links_apart(now.select("key", "node", "label"), texts.join(now.select("node").distinct(), "node", "left_semi"), size, similarity)
        else:
            pairs = now.where("label <> other").select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        pairs = written(pairs if tested is None or last else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        new = written(verified(pairs, texts, size, similarity), "links")
        tested, links = (pairs, new) if tested is None else (tested.unionByName(pairs), links.unionByName(new))
        labels = written(connected_components(links), "labels")
        if last:
            break
    found = signed.select("row", "doc_id", "node")
    if labels is None:
        return found.withColumnRenamed("node", "label")
    return found.join(labels, "node", "left").select("row", "doc_id", F.coalesce("label", "node").alias("label"))
