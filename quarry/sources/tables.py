"""Sources and sinks: path lists, text caches, QA files, boundary caches, summaries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quarry.functions.text import doc_id_from_path
from quarry.operators.evaluate import summary
from quarry.schemas import QA
from quarry.sources.shared import written
from quarry.sources.store import boundary_store


#: Rows of ``write_results``.
RESULTS = "qa_idx long, user_input string, reference string, response string, retrieved_contexts array<string>, reranking_scores array<double>"


#: Bytes of whole files, and splits of a few small ones, that a task reads.
TASK_BYTES, TASK_SPLITS = 32 << 20, 64


def as_url(path: Column) -> Column:
    """A path's URL in the one form, of two that Spark has for a store without a host, that the ``path`` of ``binaryFile`` has too."""
    return F.regexp_replace(path, "^([^:/]+):///", "$1:/")


def whole_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``path`` and ``content`` of whole files as Spark's ``binaryFile`` source has them, with many files to a task, and of empty ones.

    Spark counts a small file as 4 MB, so each task of its own would read some 32 of them, whatever they hold; here as
    many of those splits go to a task as keep all cores busy, 64 (some 2,048 files) or 32 MB at most.
    Its file sources list empty files and then leave them out: where fewer files are read than listed, the rest are added.
    """
    files = spark.read.format("binaryFile").load(paths)
    size = files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    listed, found = files._jdf.inputFiles(), files.select(as_url(F.col("_metadata.file_path")).alias("file"))
    files = files.select("path", "content")
    splits = files.rdd.getNumPartitions()
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-splits // TASK_SPLITS), -(-size // TASK_BYTES))
    if tasks < splits:
        files, found = files.coalesce(tasks), found.coalesce(tasks)
    if found.count() == len(listed):
        return files
    names = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, len(listed))
    spark._jvm.java.lang.System.arraycopy(listed, 0, names, 0, len(listed))  # they stay in the JVM
    named = spark._jsparkSession.createDataset(spark._jvm.java.util.Arrays.asList(names), spark._jvm.org.apache.spark.sql.Encoders.STRING())
    empty = DataFrame(named.toDF(), spark).select(as_url(F.col("value")).alias("file")).join(found, "file", "left_anti")
    path = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    return files.unionAll(empty.select(path.alias("path"), F.lit(b"").alias("content")))


def from_paths(spark: SparkSession, paths: list[str], convert: Callable[[bytes], str] | None = None) -> DataFrame:
    """Raw documents, their ids from the paths; texts are read as whole files.

    Bytes that are not UTF-8 text, such as a PDF's, go through ``convert`` (a PDF reader); without one they fail the query.
    """
    files = whole_files(spark, paths)
    is_text = F.is_valid_utf8(F.col("content").cast("string")) & ~F.startswith("content", F.lit(b"%PDF"))
    if convert is None:
        other = F.raise_error(F.concat(F.lit("not a text file, and no converter given: "), "path"))
    else:

        @F.pandas_udf("string")
        def other_text(content: pd.Series) -> pd.Series:
            return content.map(lambda c: None if c is None else convert(bytes(c)))

        other = other_text(F.when(~is_text, F.col("content")))
    text = F.when(is_text, F.col("content").cast("string")).otherwise(other)
    return files.select(doc_id_from_path(F.col("path")).alias("doc_id"), F.col("path").alias("source_path"), text.alias("text"), F.lit("").alias("preprocessor_name"))


def from_pages(pages: DataFrame) -> DataFrame:
    """HTML pages as documents: the stand-in for page-wise PDF extraction."""
    from quarry.operators.preprocess import html_to_text

    return pages.select(F.concat(F.lit("page_"), "page_id").alias("doc_id"), F.col("url").alias("source_path"), html_to_text(F.coalesce("html", F.lit(""))).alias("text"), F.lit("raw_text").alias("preprocessor_name"))


def file_name() -> Column:
    """A whole file's name as it is; ``_metadata.file_name`` has it as a URL does (``a%20b`` for ``a b``)."""
    return F.substring_index("path", "/", -1)


def text_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of a folder of whole-text files, which are not compressed."""
    files = whole_files(spark, folder).withColumn("name", file_name())
    return files.select(F.regexp_extract("name", "^(.*)\\.[^.]+$", 1).alias("doc_id"), F.col("content").cast("string").alias("text"))


def write_texts(docs: DataFrame, folder: str) -> None:
    """Every row's ``text`` as a file ``name`` in ``folder``, which appears whole by a rename; a retried task writes the same again. A
    null text is an empty file.

    A task drafts in a hidden folder of its own: tasks that make drafts beside the files wait for each other at every one.
    """
    from quarry.sources.paged import file_system

    def run(batches):
        store, inner = file_system(folder)
        own = f"{inner}/.{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        for pdf in batches:
            for name, text in zip(pdf["name"], pdf["text"]):
                with store.open_output_stream(f"{own}/.draft") as f:
                    f.write((text or "").encode())
                store.move(f"{own}/.draft", f"{inner}/{name}")
            yield pd.DataFrame({"n": [len(pdf)]})
        store.delete_dir(own)

    docs.select("name", "text").mapInPandas(run, "n long").agg(F.sum("n")).collect()


def converted(docs: DataFrame, cache: DataFrame, name: str) -> DataFrame:
    """Documents whose converted text must be in the cache already; a miss fails the query."""
    x = docs.withColumn("doc_id", F.concat("doc_id", F.lit(f"_{name}"))).drop("text").join(cache, "doc_id", "left")
    text = F.when(F.col("text").isNull(), F.raise_error(F.concat(F.lit("not in the text cache: "), "doc_id"))).otherwise(F.col("text"))
    return x.withColumn("text", text).withColumn("preprocessor_name", F.lit(name))


def load_yaml(path: str, spark: SparkSession | None = None) -> dict:
    """A configuration; with a session from any store that Spark reads."""
    import yaml

    if spark is not None:
        return yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) or {}
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def qa_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(qa_idx, user_input, reference) of a JSON array, whose order numbers its objects, or of the lines that ``write_results`` writes,
    which bring their numbers along."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    first = lines.select(F.substring(F.ltrim("value"), 1, 1).alias("c")).first()
    if first is not None and first.c != "[":
        rows = spark.read.schema(RESULTS).json(path).select("qa_idx", "user_input", "reference")
        if rows.where("qa_idx is null").isEmpty():
            return rows
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", f"array<struct<{QA.replace(' string', ':string')}>>")).alias("qa_idx", "q")).select(F.col("qa_idx").cast("long").alias("qa_idx"), "q.*")


def boundary_cache(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text_hash, boundary_ids) of ``<doc_id>__<hash>.json`` files; files that don't parse are misses. ``keep_boundaries``
    takes them into a ``boundary_store``, the one form in which boundaries are read and written."""
    name = "^(.*)__([0-9a-f]+)\\.json$"
    ids = F.from_json(F.col("content").cast("string"), "boundary_ids array<int>", {"mode": "PERMISSIVE"})["boundary_ids"]
    files = whole_files(spark, folder).withColumn("name", file_name())
    rows = files.select(F.regexp_extract("name", name, 1).alias("doc_id"), F.regexp_extract("name", name, 2).alias("text_hash"), ids.alias("boundary_ids"))
    return rows.where("boundary_ids is not null")


def keep_boundaries(found: DataFrame, folder: str) -> DataFrame:
    """Add what is not marked as cached to the boundary store in ``folder``; returns the store's rows."""
    store = boundary_store(found.sparkSession, folder)
    new = found.where(~F.coalesce("cached", F.lit(False))) if "cached" in found.columns else found
    store.add(new.select("doc_id", "text_hash", "boundary_ids"))
    return store.read()


def write_results(rows: DataFrame, path: str) -> None:
    """Enriched QA pairs as JSON lines, one file. Only the rows go through one task; what makes them stays as it is."""
    rows.repartition(1).write.mode("overwrite").json(path)


def write_summary(parts: list[DataFrame], path: str) -> None:
    """One CSV with the union of all columns; nothing without parts."""
    if parts:
        summary(parts).repartition(1).write.mode("overwrite").csv(path, header=True)


def write_evaluation(rows: DataFrame, path: str) -> None:
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).repartition(1).write.mode("overwrite").csv(path, header=True, escape='"')


def with_ordinals(chunks: DataFrame) -> DataFrame:
    """``ordinal``: the storage order (document, chunk) as 0.. without one task for all rows.

    Chunks are range-partitioned, sorted and written once (range bounds are sampled, so a second run of the
    same plan could cut elsewhere); partition sizes then give each partition its first number, a row a partition that
    every task gets, so texts are shuffled once.
    """
    n = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.repartitionByRange(n, "doc_id", "chunk_idx").sortWithinPartitions("doc_id", "chunk_idx").withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    rows = rows.withColumn("_k", F.col("_m") - F.shiftleft(F.col("_p").cast("long"), 33))
    rows = written(rows.drop("_m"), "ordinals")
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    base = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))
    return rows.join(F.broadcast(base), "_p").withColumn("ordinal", F.col("_b") + F.col("_k")).drop("_p", "_k", "_b")
