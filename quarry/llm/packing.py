"""Cost-balanced packing of documents into sequences of bounded length."""

from __future__ import annotations

import heapq
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quarry.llm.common import batch, id_and_bytes
from quarry.llm.tokens import encoder

LENGTH, END = 1024, 0
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, in token forward passes.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Rests of so many documents are packed together; they lose under one sequence to padding.
GROUP = 4096


def cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], size: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) for items shorter than ``size``, longest first.

    Just enough sequences are opened for the sum of the lengths; each item goes to the sequence of
    least cost that has room. What doesn't fit there is cut off and goes on to the next, so all
    sequences together miss fewer than ``size`` tokens.
    """
    out, heap = [], [(0.0, s, 0) for s in range(-(-sum(lengths) // size))]
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        start, left = 0, lengths[i]
        while left:
            c, s, filled = heapq.heappop(heap)
            n = min(left, size - filled)
            out.append((i, start, n, s, filled))
            start, left, filled = start + n, left - n, filled + n
            if filled < size:
                heapq.heappush(heap, (c + cost(n), s, filled))
    return out


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: empty, so its end alone) and ``end``; texts are read whole, however
    long. Rows are packed one by one: repeated rows and ids give pieces of their own, an empty table gives none, and further
    columns are ignored. Ties of cost go to the sequence opened first, those of length to the row read first. Full runs of ``length`` ids
    make sequences of their own; the rests of ``group`` documents are packed by ``assign``. Nothing
    is shuffled and a task holds one group. sequence_id is the task's number and a count in it.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches):
        own, tail = encoder(path), end.to_bytes(4, "little")
        rests, rows, count = [], [], (TaskContext.get().partitionId()) << 36

        def flush():
            nonlocal count
            top = count
            for i, a, n, s, off in assign([len(r[2]) // 4 for r in rests], length):
                doc, first, ids, total = rests[i]
                rows.append((doc, first + a, n, zlib.crc32(ids[4 * a : 4 * (a + n)]), total, count + s, off))
                top = max(top, count + s + 1)
            count = top
            rests.clear()

        for b in batches:
            for doc, ids in own.rows(b.column(0).to_pylist(), b.column(1)):
                ids += tail
                total = len(ids) // 4
                full = total - total % length
                for a in range(0, full, length):
                    rows.append((doc, a, length, zlib.crc32(ids[4 * a : 4 * (a + length)]), total, count, 0))
                    count += 1
                if full < total:
                    rests.append((doc, full, ids[4 * full :], total))
                if len(rests) >= group:
                    flush()
            if rows:
                yield batch(schema, *zip(*rows))
                rows.clear()
        flush()
        if rows:
            yield batch(schema, *zip(*rows))

    return id_and_bytes(docs).mapInArrow(run, ", ".join(f"{f.name} long" for f in schema))
