"""Semantic operators over streams: the row-wise ones run on each micro-batch, with the same verdict store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from lucidframe.operators.context import Semantic
from lucidframe.operators.semantic import sem_classify, sem_filter


def filter_stream(ctx: Semantic, stream: DataFrame, text: Column, condition: str, path: str, checkpoint: str):
    """A query that appends to path the rows whose text satisfies the condition. A batch that is run again replaces its own
    folder, and asks the model nothing that is stored."""

    def batch(df: DataFrame, number: int) -> None:
        sem_filter(ctx, df, text, condition).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def classify_stream(ctx: Semantic, stream: DataFrame, text: Column, conditions: list[str], names: list[str], path: str, checkpoint: str):
    def batch(df: DataFrame, number: int) -> None:
        sem_classify(ctx, df, text, conditions, names).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
