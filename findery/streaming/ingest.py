"""Streaming ingest into a lifecycle index: one operation for each micro-batch.

The batch number is part of the idempotency key, so a batch that Spark runs
again after a failure answers with its first result: each batch counts once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from findery.plans.lifecycle import IndexIdentity, Insert, Lifecycle, Operation


def last_of_each(batch: DataFrame, order: str) -> DataFrame:
    """The last row of each id by ``order``; an index takes an id once in an operation."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col(order).desc()))
    return batch.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def ingest(
    stream: DataFrame, lifecycle: Lifecycle, index: IndexIdentity, checkpoint: str, order: str | None = None, name: str = "stream"
) -> StreamingQuery:
    """Starts a query that inserts every micro-batch of ``id, provenance, vector`` or ``text``."""

    def insert(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            members = last_of_each(batch, order).drop(order) if order else batch
            if not members.isEmpty():
                lifecycle.apply(Operation(index, f"{name}-{number}", Insert(members)))
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
