"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import batch, id_and_bytes, kept, mix64, written

SHINGLE, CONTAINMENT = 5, 0.8
#: MinHash functions an item: a document that holds 80 % of an item misses all with probability 0.2 ** 32.
HASHES = 32
#: Items and bytes of items sent to the executors at once; a larger benchmark is searched in blocks by a hash of the item.
BLOCK, BLOCK_BYTES = 20_000, 8 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 150_000:
            self[word] = h
        return h


def shingle_hashes(words: list[bytes], hashes: dict, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words; fewer words make one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k, out = min(size, n), None
    for j in range(k):
        part = h[j : n - k + 1 + j]
        out = part.copy() if out is None else out * _STEP + part
    return out ^ np.uint64(k)


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Index:
    """MinHash signatures of the items, by size class: class c holds items of 2**c to 2**(c+1) - 1 shingles.

    A signature is the set of shingles that are least under HASHES permutations, all of them for
    small items. A document is only probed in classes whose items it is large enough to contain. Built once on
    the driver and sent as arrays and texts; an item's exact shingles are cut when it is first verified.
    """

    def __init__(self, items: list[tuple[int | None, bytes]], size: int = SHINGLE, containment: float = CONTAINMENT):
        self.size, self.containment, hashes = size, containment, _WordHashes()
        self.items, self.classes, self.exact = [], [], {}
        by_class: dict[int, list] = {}
        for item_id, text in items:
            words = text.lower().split()
            if not words:
                continue
            h = np.unique(shingle_hashes(words, hashes, size))
            sign = h
            if len(h) > HASHES:
                sign = np.unique(np.array([h[mix64(h ^ mix64(np.array([k], np.uint64))).argmin()] for k in range(HASHES)]))
            by_class.setdefault(len(shingles(words, size)).bit_length() - 1, []).extend((x, len(self.items)) for x in sign.tolist())
            self.items.append((item_id, text, h))
        for c, pairs in sorted(by_class.items()):
            keys = np.array([p[0] for p in pairs], np.uint64)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[keys >> np.uint64(44)] = True
            self.classes.append((2**c, np.packbits(seen), keys[order], np.array([p[1] for p in pairs])[order]))

    def search(self, text: bytes, hashes: dict, first: bool = False) -> list[tuple[int | None, int, int]]:
        """(item_id, item's shingles, of those in the text) of each item contained in the text, or of the ``first`` found."""
        words = text.lower().split()
        h = shingle_hashes(words, hashes, self.size)
        found: list[tuple[int | None, int, int]] = []
        for least, seen, keys, items in self.classes:
            if len(h) < self.containment * least:
                break
            top = h >> np.uint64(44)
            probe = h[(seen[top >> np.uint64(3)] >> (np.uint8(7) - (top & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).astype(bool)]
            if not len(probe):
                continue
            at, to = np.searchsorted(keys, probe), np.searchsorted(keys, probe, "right")
            hit = {i for a, b in zip(at[to > at], to[to > at]) for i in items[a:b].tolist()}
            for i in sorted(hit):
                item_id, item, own = self.items[i]
                exact = self.exact.get(i)
                if exact is None:
                    if len(self.exact) >= 1000:
                        self.exact.clear()
                    exact = self.exact[i] = shingles(item.lower().split(), self.size)
                # only the places whose hash is one of the item's can hold its shingles
                place = np.flatnonzero(own[np.minimum(np.searchsorted(own, h), len(own) - 1)] == h).tolist()
                both = len(exact & {b" ".join(words[p : p + self.size]) for p in place})
                if both >= self.containment * len(exact):
                    found.append((item_id, len(exact), both))
                    if first:
                        return found
        return found


def _indexes(docs: DataFrame, benchmark: DataFrame, size: int, containment: float):
    """A broadcast index of every block of the benchmark's different items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).distinct()
    many = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-many.n // BLOCK), -(-many.size // BLOCK_BYTES))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        texts = sorted(((r.item_id, bytes(r.text)) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        yield docs.sparkSession.sparkContext.broadcast(Index(texts, size, containment))


def search(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found, containment) of every contained benchmark item.

    An item counts as contained if ``containment`` or more of its distinct word shingles (A-Z
    lower-cased) occur anywhere in the document. Texts of fewer than ``size`` words are one
    shingle, so an item that short is found only as a document's whole text, as in the SQL; null and empty items and
    documents never match. Null ids are kept as null, repeated rows give one row. Documents are never shuffled: each is
    scanned once for every block of BLOCK items or BLOCK_BYTES.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_found", pa.int64())])
    out = None
    for sent in _indexes(docs, benchmark, size, containment):

        def run(batches, sent=sent):
            index, hashes = sent.value, _WordHashes()
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for m in index.search(t.as_py(), hashes)]
                yield batch(schema, *(zip(*rows) if rows else [[]] * 4))

        part = id_and_bytes(docs).mapInArrow(run, "doc_id long, item_id long, n_shingles long, n_found long")
        out = part if out is None else out.unionByName(part)
    return out.distinct().withColumn("containment", F.col("n_found") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """The rows that contain no benchmark item, with all their columns.

    Every row is judged by its own text, whatever its id: a contaminated row with a null id goes too, and a clean row stays
    though another row of its id goes. A larger benchmark filters once a block, what is left being written in
    between. Empty tables give an empty table.
    """
    for k, sent in enumerate(_indexes(docs, benchmark, size, containment)):
        docs = written(docs, "clean") if k else docs

        def verdict(sent=sent):
            index, hashes = sent.value, _WordHashes()
            return lambda texts: [not index.search(t.as_py(), hashes, first=True) for t in texts]

        docs = kept(docs, verdict)
    return docs


def oracle(size: int = SHINGLE, containment: float = CONTAINMENT) -> str:
    """DuckDB SQL for the query: exact containment by brute force over all shingles."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"list_filter(regexp_split_to_array({low}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    grams = f"list_distinct(list_transform(range(1, greatest(len(w) - {size - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {size - 1}], ' ')))"
    return f"""
with i as (select item_id, {grams} as g from (select item_id, {words} as w from benchmark where text is not null) where len(w) > 0),
d as (select doc_id, {grams} as g from (select doc_id, {words} as w from documents where text is not null) where len(w) > 0),
ig as (select item_id, len(g) as n, unnest(g) as s from i), dg as (select doc_id, unnest(g) as s from d)
select doc_id, item_id, n as n_shingles, count(*) as n_found, count(*) / n as containment
from dg join ig using (s) group by doc_id, item_id, n having count(*) >= {containment} * n"""
