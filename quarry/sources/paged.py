"""Files of pages: a Spark data source that opens files in tasks and yields them page by page."""

from __future__ import annotations

import fnmatch
import json
import posixpath
from collections.abc import Callable, Iterable, Iterator
from typing import BinaryIO

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.text import doc_id_from_path

#: Bytes of files that one partition reads, at most, unless a single file has more.
RUN_BYTES = 32 << 20
#: Smaller partitions are joined, up to RUN_BYTES, where there would be more of them: starting each costs a tenth of a second.
RUNS = 256
PAGE = "path string, page int, text string"


def form_feed_pages(file: BinaryIO, path: str) -> Iterator[str]:
    """UTF-8 text whose pages end with form feeds, as PDF-to-text tools write it; read piece by piece."""
    rest = b""
    while piece := file.read(1 << 20):
        *whole, rest = (rest + piece).split(b"\f")
        for page in whole:
            yield page.decode()
    if rest:
        yield rest.decode()


def file_system(path: str):
    """(file system, path in it) of a plain path or a URI that Arrow knows: file, hdfs, s3, gs, abfs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at ``path``, a file, a folder (and what lies below it) or a pattern for its last part; hidden
    names are left out."""
    from pyarrow import fs

    store, inner = file_system(path)
    lead = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    pattern = posixpath.basename(inner) if any(c in posixpath.basename(inner) for c in "*?[") else None
    info = store.get_file_info(posixpath.dirname(inner) if pattern else inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(info.path, recursive=pattern is None))
    names = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    return [(lead + p, n) for p, n in names if pattern is None or fnmatch.fnmatch(posixpath.basename(p), pattern)]


class _Run(InputPartition):
    def __init__(self, files: list[str]):
        super().__init__(files)


class _Reader(DataSourceReader):
    def __init__(self, convert, paths: list[str], most: int):
        self.convert, self.paths, self.most = convert, paths, most

    def partitions(self):
        """A partition a run of files of ``most`` bytes together, or of what leaves RUNS of them."""
        runs, size, files = [[]], 0, [f for p in self.paths for f in listed(p)]
        most = max(self.most, min(RUN_BYTES, sum(n for _, n in files) // RUNS))
        for path, n in files:
            if runs[-1] and size + n > most:
                runs.append([])
                size = 0
            runs[-1].append(path)
            size += n
        return [_Run(r) for r in runs if r]

    def read(self, partition):
        if partition is None:  # no files
            return
        for path in partition.value:
            store, inner = file_system(path)
            with store.open_input_stream(inner) as file:
                for k, text in enumerate(self.convert(file, path), 1):
                    yield path, k, text


def page_source(convert: Callable[[BinaryIO, str], Iterable[str]], name: str = "paged_files") -> type[DataSource]:
    """A data source ``name`` over files that ``convert(open file, path)`` turns into their pages' texts in order."""

    class PagedFiles(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return PAGE

        def reader(self, schema):
            return _Reader(convert, json.loads(self.options["paths"]), int(self.options.get("runBytes", RUN_BYTES)))

    return PagedFiles


def read_pages(spark: SparkSession, paths: list[str], convert: Callable[[BinaryIO, str], Iterable[str]] = form_feed_pages, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(path, page, text) of the files at ``paths``: pages count from 1 within a file.

    A task opens its run of files one after the other and holds a page at a time, no file as a whole unless ``convert``
    does. An empty file has no pages. Stores that Arrow can't open (``S.from_paths`` reads those through Spark) and a
    converter's error fail the query.
    """
    spark.dataSource.register(page_source(convert))
    return spark.read.format("paged_files").option("paths", json.dumps(paths)).option("runBytes", str(run_bytes)).load()


def pages_as_documents(pages: DataFrame, name: str = "raw_text", *more: Column) -> DataFrame:
    """One document per file of ``pages(path, page, text)``: the texts of its pages in order, each with a line end; empty
    pages are left out. ``more`` are further aggregates over a file's pages, taken in the same pass."""
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.when(F.length("text") > 0, F.struct("page", "text")))), lambda p: F.concat(p["text"], F.lit("\n"))))
    docs = pages.groupBy("path").agg(text.alias("text"), *more)
    return docs.select(F.concat(doc_id_from_path(F.col("path")), F.lit(f"_{name}")).alias("doc_id"), F.col("path").alias("source_path"), "text", F.lit(name).alias("preprocessor_name"), *docs.columns[2:])
