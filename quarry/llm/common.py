"""Helpers shared by the training-data operators.

Words everywhere are maximal runs outside ``\\x20\\x09-\\x0D``; on UTF-8 bytes that is exactly
``bytes.split()``, and ``bytes.lower()`` lower-cases exactly A-Z.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quarry.sources.shared import BATCH_BYTES, bounded, new_path, shared_dir, spread, written  # noqa: F401


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def id_and_bytes(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id as long and the whole text as UTF-8 bytes; a null text is empty."""
    bounded(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more)


def every(docs: DataFrame) -> list[Column]:
    """All columns of ``docs``, whatever their names hold."""
    return [F.col(quoted(c)) for c in docs.columns]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def fold(mod: int, doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod ``mod`` is 2; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == 2, F.lit(False))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def kept(docs: DataFrame, verdict: Callable) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns: one pass on the map side, nothing is shuffled.

    ``verdict()`` is called once a task and gives a function from an Arrow column of UTF-8 texts (null: empty) to a boolean
    array, true for the rows that stay. Rows are judged one by one, whatever their id: null and repeated
    ids, repeated rows and clashing names need no care.
    """

    def run(batches):
        judge = verdict()
        for b in batches:
            yield b.select(range(b.num_columns - 1)).filter(pa.array(judge(b.column(b.num_columns - 1)), pa.bool_()))

    bounded(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    plain = [f"c{k}" for k in range(len(docs.columns))]  # a UDF's columns can't have names with dots
    schema = T.StructType([T.StructField(n, f.dataType, f.nullable) for n, f in zip(plain, docs.schema)])
    return docs.select(*[c.alias(n) for c, n in zip(every(docs), plain)], text).mapInArrow(run, schema).toDF(*docs.columns)


def key_runs(batches, key: str, least: int):
    """Tables of at least ``least`` rows, cut only where ``key`` changes; the input comes sorted by it."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        k = t.column(key).to_numpy()
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if cut:
            yield t.slice(0, cut)
            held, rows = t.slice(cut).to_batches(), t.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def as_bytes(column: pa.BinaryArray) -> list[bytes]:
    """The values of a binary column without nulls; many times faster than ``to_pylist``."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
