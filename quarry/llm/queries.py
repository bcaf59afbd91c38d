"""The registered queries of the training-data operators, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import binary, chat, clusters, decontaminate, language, lines, maxent, packing, quality, simhash, spelling, suffixes, toxicity
from quarry.llm.common import read

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filter_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_language(read(spark, sf_dir, "documents"))


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary.round_trip(read(spark, sf_dir, "documents"), tokenizer_path())


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(read(spark, sf_dir, "documents"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(read(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(read(spark, sf_dir, "documents"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.expand(chat.with_probe(read(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_packing, op3_language, op4_decontamination, op5_simhash, op6_lines, op7_quality, op8_maxent, op9_simple8b, op10_suffixes, op11_lloyd, op12_spelling, op13_chat, pipeline)}

ORACLE_SQL = {"op4_decontamination": decontaminate.oracle(), "op6_lines": lines.oracle(), "op11_lloyd": clusters.oracle(), "op12_spelling": spelling.oracle(), "op13_chat": chat.oracle()}
