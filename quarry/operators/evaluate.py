"""Metrics and their aggregation over runs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.operators.retrieve import REFUSAL

#: Tokens of context a question gets.
TOKEN_LIMIT = 1500


def claims(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "\\W+"), lambda w: w != ""))


def token_f1(response: Column, reference: Column) -> Column:
    """TP / (TP + (FP + FN) / 2) over distinct words; 0 where both are empty."""
    a, b = claims(response), claims(reference)
    both = F.size(F.array_intersect(a, b))
    total = both + 0.5 * (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))
    return F.when(total == 0, 0.0).otherwise(both / total)


def supported(of: Column, by: Column) -> Column:
    """Share of the claims of ``of`` that ``by`` has: recall for the reference by the contexts, faithfulness for the response."""
    a = claims(of)
    return F.when(F.size(a) == 0, F.lit(None).cast("double")).otherwise(F.size(F.array_intersect(a, claims(by))) / F.size(a))


def rejected(response: Column) -> Column:
    return (F.trim(response) == REFUSAL).cast("int")


def relevancy(question: Column, response: Column) -> Column:
    """Cosine of the distinct words of question and response; 0 where either has none."""
    a, b = claims(question), claims(response)
    return F.when(F.least(F.size(a), F.size(b)) == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b)))


def evaluate(rows: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """answer_correctness, context_recall, faithfulness and, where ``rows`` have a user_input, answer_relevancy of
    ``rows(response, reference, retrieved_contexts)``; a ``judge`` replaces them."""
    if judge is not None:
        return judge(rows)
    ctx = F.array_join("retrieved_contexts", " ")
    more = {"answer_relevancy": relevancy(F.col("user_input"), F.col("response"))} if "user_input" in rows.columns else {}
    return evaluate_minimal(rows).withColumns({"context_recall": supported(F.col("reference"), ctx), "faithfulness": supported(F.col("response"), ctx), **more})


def evaluate_minimal(rows: DataFrame, judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """answer_correctness alone, for experiments with many runs."""
    if judge is not None:
        return judge(rows)
    return rows.withColumn("answer_correctness", token_f1(F.col("response"), F.col("reference")))


def evaluate_rejection(rows: DataFrame) -> DataFrame:
    return rows.withColumn("negative_rejection", rejected(F.col("response")))


def means(rows: DataFrame, by: list[str] = [], prefix: str = "") -> DataFrame:
    """Means of all numeric columns; nulls and NaNs are skipped."""
    numeric = [c for c, t in rows.dtypes if c not in by and (t in ("int", "bigint", "smallint", "tinyint", "float", "double") or t.startswith("decimal"))]
    return rows.groupBy(*by).agg(*[F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(prefix + c) for c in numeric])


def average_tokens(chunks: DataFrame, tokens: Column, by: list[str] = []) -> DataFrame:
    return chunks.groupBy(*by).agg(F.coalesce(F.avg(tokens), F.lit(1.0)).alias("avg_chunk_tokens"))


def budget(avg: Column) -> tuple[Column, Column]:
    """(top_k, top_n) for chunks of ``avg`` tokens."""
    n = F.greatest(F.lit(1), F.floor(F.lit(TOKEN_LIMIT) / avg)).cast("int")
    return (3 * n).cast("int"), n


def best(runs: DataFrame, score: str = "answer_correctness", order: str = "run_idx") -> DataFrame:
    """The run with the greatest score; missing counts as 0, the first wins ties."""
    return runs.orderBy(F.desc(F.coalesce(score, F.lit(0.0))), order).limit(1)


def summary(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sweep(hits: DataFrame, thresholds: list[float], top_n: int) -> DataFrame:
    """Reranked hits at every threshold at once: scored and ranked once, then filtered."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reranking_score"), "ordinal")))
    each = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    return ranked.where(F.col("rank") <= top_n).select("*", each).where(F.col("reranking_score") >= F.col("threshold"))


def attach(qa: DataFrame, results: DataFrame) -> DataFrame:
    """Responses and contexts joined to their QA pairs by index."""
    return qa.join(results, "qa_idx", "left")
