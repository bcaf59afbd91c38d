"""Queries as a stream: each micro-batch goes through the online pipeline once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarry.plans.pipeline import OnlinePipeline


def answer_stream(queries: DataFrame, index: DataFrame, pipeline: OnlinePipeline, path: str, checkpoint: str):
    """Start a stream that appends the answers of ``queries(query_id, original_query)`` to a Parquet folder."""

    def each(rows: DataFrame, batch_id: int) -> None:
        pipeline.batch(index, rows).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return queries.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
