"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination and packing of ``documents``.

All stages judge rows by their text: null and repeated ids and repeated rows need no care, a null text counts as empty,
very long texts are read whole, an empty table stays empty, and further columns, whatever their names, are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, lines, packing, simhash, toxicity
from quarry.llm.common import new_path, read
from quarry.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go; texts without a learnt term get the labels' share of toxic documents as their score."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that spread over many sources go but at their first place; n_chars follows the text. A null text stays null; of
    equal first places (repeated rows) all keep the line."""
    return lines.strip_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest id stays, null ids last, one of repeated rows. Texts
    without words are copies of each other."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains a benchmark item go; null and empty texts stay."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences; a null or empty text is its end token alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("near-dedup", dedup_documents), ("decontamination", drop_contaminated), ("packing", pack)]

#: The classifier and the packing have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again as the next one's docs."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
