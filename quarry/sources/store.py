"""Keyed caches that are committed by manifest.

A writer stages rows as Parquet files in a folder of their own and then publishes one small manifest that names it, by a rename.
Rows without a manifest are invisible, so a writer that is killed leaves nothing half written and a retry
publishes no row twice. Two writers never touch each other's files; where both publish a key, the earlier manifest's row is
the one that every reader sees.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


class Store:
    """A cache of ``schema`` in ``folder`` with one row for each value of ``keys`` (null is a value of its own).

    The driver holds the manifests' names only: one a commit, until ``compact`` makes one of them.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = T.StructType.fromDDL(schema)
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join([self.folder, *parts]))
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def commits(self) -> list[str]:
        """Names of the folders that hold visible rows, the earliest first."""
        log = self._path("_commits")
        if not self._fs.exists(log):
            return []
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(log) if f.getPath().getName().endswith(".json"))
        if not names:
            return []
        files = [f"{self.folder}/_commits/{n}" for n in names]
        said = {r.name: json.loads(r.value) for r in self.spark.read.text(files, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").collect()}
        gone = {x for m in said.values() for x in m["replaces"]}
        return [m["data"] for n in names if (m := said[n])["data"] not in gone]

    def read(self) -> DataFrame:
        """The visible rows; an absent folder is an empty cache."""
        commits = self.commits()
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{c}" for c in commits])
        if len(commits) == 1:  # a commit has a key once
            return rows
        rows = rows.withColumn("_order", F.substring_index(F.col("_metadata.file_path"), "/data/", -1))
        again = rows.groupBy(*self.keys).agg(F.count("*").alias("_n"), F.min("_order").alias("_first")).where("_n > 1").drop("_n")
        if again.isEmpty():  # the keys tell, without a shuffle of the rows
            return rows.drop("_order")
        same = reduce(Column.__and__, [F.col(f"r.{k}").eqNullSafe(F.col(f"a.{k}")) for k in self.keys])
        kept = rows.alias("r").join(again.alias("a"), same, "left").where("a._first is null or r._order = a._first")
        return kept.select(*[F.col(f"r.{f.name}") for f in self.schema])

    def stage(self, rows: DataFrame, unique: bool = False) -> str:
        """Write ``rows``, one of each key, where no reader looks; returns the name that ``publish`` takes. ``unique`` rows have
        each key once already and are not shuffled."""
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        (rows if unique else rows.dropDuplicates(self.keys)).write.parquet(f"{self.folder}/data/{name}")
        return name

    def publish(self, name: str, replaces: list[str] = ()) -> None:
        """Make staged rows visible, all at once: the manifest appears by a rename. Publishing a name again changes nothing."""
        target, draft = self._path("_commits", f"{name}.json"), self._path("_commits", f".{name}-{uuid.uuid4().hex}")
        if self._fs.exists(target):
            return
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"data": name, "replaces": list(replaces)}).encode()))
        out.close()
        if not self._fs.rename(draft, target) and not self._fs.exists(target):
            raise OSError(f"could not publish {target}")

    def add(self, rows: DataFrame, unique: bool = False) -> None:
        """Stage and publish; no rows publish nothing."""
        name = self.stage(rows, unique)
        if not self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{name}").isEmpty():
            self.publish(name)

    def compact(self) -> None:
        """One commit for all that are visible now; what another writer publishes meanwhile stays as it is."""
        commits = self.commits()
        if len(commits) > 1:
            self.publish(self.stage(self.read()), commits)


def text_store(spark: SparkSession, folder: str) -> Store:
    """Processed texts by document id and a hash of the source text."""
    return Store(spark, folder, "doc_id string, source_hash string, text string", ["doc_id", "source_hash"])


def boundary_store(spark: SparkSession, folder: str) -> Store:
    """Chunk boundaries by document id and a hash of the text."""
    return Store(spark, folder, "doc_id string, text_hash string, boundary_ids array<int>", ["doc_id", "text_hash"])
