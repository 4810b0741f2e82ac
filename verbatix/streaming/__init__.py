"""Streaming use of the batch operators: a score store that grows batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def upsert_stream(scores: DataFrame, store: str, checkpoint: str, keys: tuple[str, ...] = ("model", "prompt"), order: str = "value") -> StreamingQuery:
    """Upserts each micro-batch of scores into a versioned store; a batch that is run again is there already.

    Of a batch's rows with equal keys the last by order counts; of those equal in it too, the greatest row.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = F.struct(order, *[c for c in batch.columns if c != order])
        last = batch.groupBy(*keys).agg(F.max(rows).alias("_last")).select(*[F.col("_last")[c].alias(c) for c in batch.columns])
        Store(batch.sparkSession, store, keys).put(last, f"batch-{number}")

    return scores.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
