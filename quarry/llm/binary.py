"""Token-id files in Simple-8b: word-aligned codes whose selectors pack varying counts of ids.

A file set is a Parquet folder whose rows are runs of whole documents: shard, first (ids of the
shard before the run), doc_ids, lengths and payload. A payload is little-endian: ``S8B1``, n_ids,
n_words, n_escapes and block words as u32, one u32 offset (ids before it) per block of words, the
escapes as u32 places and u64 values, then the u64 words. Any block decodes on its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quarry.llm.common import batch, id_and_bytes, new_path
from quarry.llm.tokens import encoder

END = 2
#: (ids a word, bits an id) of selectors 0 to 15: fixed values of the Simple-8b format.
SELECTORS = [(240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
BLOCK = 256
#: A run is closed at the first document end after so many ids.
RUN = 1 << 16
_MAGIC = b"S8B1"
_COUNTS = np.array([c for c, _ in SELECTORS], np.uint8)
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)


def encode(ids: np.ndarray) -> bytes:
    """Unsigned integers of up to 64 bits; those of 2**60 and more are escapes, stored apart."""
    v = ids.astype(np.uint64)
    n = len(v)
    big = np.flatnonzero(v >> np.uint64(60))
    escapes = v[big]
    v = np.where(v >> np.uint64(60), np.uint64(0), v)
    if n and int(v.max()) < len(_BITS):
        bits = _BITS[v]
    else:
        bits = np.frexp(v.astype(np.float64))[1].astype(np.int8)
        bits = np.where((bits > 0) & (v >> np.maximum(bits - 1, 0).astype(np.uint64) == 0), bits - 1, bits)  # a rounded-up float
    # most[w]: the most bits of any of w ids from each place on, zeros after the end
    most = {1: np.append(bits, np.zeros(240, np.int8))}
    choice = np.full(n, len(SELECTORS) - 1, np.uint8)
    for k in range(len(SELECTORS) - 2, -1, -1):
        count, width = SELECTORS[k]
        half = 1
        while 2 * half <= count:
            if 2 * half not in most:
                most[2 * half] = np.maximum(most[half][:-half], most[half][half:])
            half *= 2
        fits = np.maximum(most[half][:n], most[half][count - half : count - half + n]) <= width
        if not fits.any():
            break  # more and narrower ids fit even less
        choice[fits] = k
    step = _COUNTS[choice].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    starts = np.array(starts, np.int64)
    sel = choice[starts] if n else np.empty(0, np.int8)
    words = sel.astype(np.uint64) << np.uint64(60)
    padded = np.r_[v, np.zeros(240, np.uint64)]
    for k, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(sel == k)
        if width and len(own):
            at, word = starts[own], words[own]
            for j in range(count):
                word |= padded[at + j] << np.uint64(j * width)
            words[own] = word
    head = np.array([n, len(words), len(big), BLOCK], "<u4").tobytes()
    return _MAGIC + head + starts[::BLOCK].astype("<u4").tobytes() + big.astype("<u4").tobytes() + escapes.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def decode(payload: bytes, first_block: int = 0, blocks: int | None = None) -> np.ndarray:
    """The ids of a payload, or of ``blocks`` blocks from ``first_block`` on, as u64."""
    if payload[:4] != _MAGIC:
        raise ValueError("not a Simple-8b payload")
    n, n_words, n_escapes, block = np.frombuffer(payload, "<u4", 4, 4).tolist()
    n_blocks, at = -(-n_words // block), 20
    offsets = np.frombuffer(payload, "<u4", n_blocks, at)
    at += 4 * n_blocks
    places = np.frombuffer(payload, "<u4", n_escapes, at)
    values = np.frombuffer(payload, "<u8", n_escapes, at + 4 * n_escapes)
    words = np.frombuffer(payload, "<u8", n_words, at + 12 * n_escapes)
    last = n_blocks if blocks is None else min(n_blocks, first_block + blocks)
    if first_block >= last:
        return np.empty(0, np.uint64)
    words = words[first_block * block : last * block]
    sel = (words >> np.uint64(60)).astype(np.int8)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[sel]
    starts = np.cumsum(counts) - counts
    base = int(offsets[first_block])
    size = (int(offsets[last]) if last < n_blocks else n) - base
    out = np.zeros(int(counts.sum()), np.uint64)
    for k, (count, width) in enumerate(SELECTORS):
        own = np.flatnonzero(sel == k)
        if width and len(own):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(width)
            out[starts[own][:, None] + np.arange(count)] = (words[own][:, None] >> shifts) & np.uint64((1 << width) - 1)
    out = out[:size]
    own = (places >= base) & (places < base + size)
    out[places[own].astype(np.int64) - base] = values[own]
    return out


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    """Encode whole texts (null: empty), append ``end`` to each and write them in ascending doc_id order.

    Texts move once, by range of doc_id and a hash of the text, so that rows of one id can lie in several ranges; a task sorts
    its range and writes one shard, so shards in order are the ids in order. Null ids come first.
    """
    schema = pa.schema([("shard", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def run(batches):
        own, tail, shard = encoder(tokenizer), end.to_bytes(4, "little"), TaskContext.get().partitionId()
        held, docs_, lens, first, total = [], [], [], 0, 0

        def row():
            ids = np.frombuffer(b"".join(held), "<u4")
            return batch(schema, [shard], [first], [docs_], [lens], [encode(ids)])

        for b in batches:
            for doc, ids in own.rows(b.column(0).to_pylist(), b.column(1)):
                ids += tail
                held.append(ids)
                docs_.append(doc)
                lens.append(len(ids) // 4)
                total += lens[-1]
                if total >= RUN:
                    yield row()
                    first += total
                    held, docs_, lens, total = [], [], [], 0
        if docs_:
            yield row()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = id_and_bytes(docs).withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows.mapInArrow(run, "shard int, first long, doc_ids array<long>, lengths array<long>, payload binary").write.option("compression", "zstd").parquet(path)


def read(spark, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema("shard int, first long, doc_ids array<long>, lengths array<long>, payload binary").parquet(path)
    sizes = files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    base = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for shard, first, doc_ids, lengths, payload in zip(*(b.column(k).to_pylist() for k in range(5))):
                raw, ends = decode(payload).astype("<u4").tobytes(), np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * e]) for a, e in zip(starts.tolist(), ends.tolist())]
                yield batch(schema, [shard] * len(crc), doc_ids, starts + first, lengths, crc)

    rows = files.mapInArrow(run, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end: int = END, path: str | None = None) -> DataFrame:
    """``write`` and ``read``: a row per row of ``docs``. A null or empty text is its end id alone, texts are encoded whole. Rows
    go by doc_id, null ids first, and rows of one id by a hash of their texts, so repeated rows follow each other; an empty
    table gives no rows, and further columns are ignored.
    """
    path = path or new_path(docs.sparkSession, "ids")
    write(docs, path, tokenizer, end)
    return read(docs.sparkSession, path)
