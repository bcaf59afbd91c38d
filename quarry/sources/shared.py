"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a local folder in local mode (tests), an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        handle = spark.sparkContext._jsc.sc().getCheckpointDir()
        if handle.isDefined():
            return handle.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(base := tempfile.mkdtemp(prefix="quarry-"))
    return base


_MADE: list[tuple] = []


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; ``clean`` or the end of the program deletes what is there."""
    path = f"{shared_dir(spark)}/quarry-{tag}-{uuid.uuid4().hex}"
    _MADE.append((spark._jvm, spark._jsc.hadoopConfiguration(), path))
    return path


@atexit.register
def clean() -> None:
    """Delete every intermediate table this program made. Frames that still read them fail afterwards."""
    while _MADE:
        jvm, conf, path = _MADE.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def written(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of files that are worth a task of their own.
TASK_BYTES = 1 << 20


def row_groups(spark: SparkSession, files: list[str], enough: int) -> int:
    """Row groups of Parquet ``files``, from their footers; counting stops at ``enough``."""
    hadoop, parquet = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.parquet.hadoop
    conf, n = spark._jsc.hadoopConfiguration(), 0
    for f in files:
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(hadoop(f), conf))
        n += reader.getRowGroups().size()
        reader.close()
        if n >= enough:
            break
    return n


def spread(scan: DataFrame) -> DataFrame:
    """``scan``, a plain read of Parquet files, with its rows dealt out where a few large row groups would leave most cores idle.

    A row group is read by one task. So rows are dealt out where there are fewer row groups than tasks worth starting,
    and the scan has less than one split a core: so much is shuffled at most, whatever the input's size. Footers are read
    only of files that are fewer than those tasks. Any other scan fills the cores with splits of its own and stays as it is.
    """
    spark = scan.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    tasks = min(cores, size // TASK_BYTES)
    if size >= cores * split:
        return scan
    files = list(scan._jdf.inputFiles())
    if len(files) >= tasks or row_groups(spark, files, tasks) >= tasks:
        return scan
    return scan.repartition(tasks)


#: Bytes of an Arrow batch, unless the session has a bound of its own: what a Python worker and the JVM beside it hold at once.
BATCH_BYTES = 4 << 20
_BOUND, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", (64 << 20, "64m")


def bounded(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes; a session that sets the bound itself keeps it."""
    if spark.conf.get(_BOUND, "64m").rstrip("bB") in map(str, _UNSET):
        spark.conf.set(_BOUND, str(BATCH_BYTES))
