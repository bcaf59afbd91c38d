"""Vectors as arrays of double, and the deterministic default embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

DIM = 64
#: Words whose buckets a worker remembers, twice.
KNOWN = 1 << 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero, so its cosine with anything is 0."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))[0]


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def hash_bucket(word: str, dim: int = DIM) -> int:
    return int.from_bytes(hashlib.md5(word.encode()).digest()[:3], "big") % dim


class Buckets(dict):
    """word -> bucket, remembered for the words met last: KNOWN of them, and as many before those, from which words that are met
    again come back. Common words so stay, whatever the number of rare ones."""

    def __init__(self, dim: int = DIM):
        self.dim, self.before = dim, {}

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.before = self.copy()
            self.clear()
        found = self.before.get(word)
        self[word] = found = hash_bucket(word, self.dim) if found is None else found
        return found


def hash_embedder(dim: int = DIM):
    """Arrow UDF: unit vector of the lower-cased words' hashed counts."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bucket = Buckets(dim).__getitem__

        def one(text):
            v = np.bincount(list(map(bucket, (text or "").lower().split())), minlength=dim).astype(np.float64)
            n = np.sqrt((v * v).sum())
            return v / n if n else v

        for s in batches:
            yield s.map(one)

    return embed
