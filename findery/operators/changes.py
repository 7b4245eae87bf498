"""What an operation does to an index's member table, as joins.

``members(id, provenance)`` is a batch, ``table(id, provenance, introduced,
supersedes)`` what the index holds. Every function gives ``changes(id, change,
previous)``, and the next table where there is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FIELDS = ("provenance", "introduced", "supersedes")


def _previous(table: DataFrame) -> DataFrame:
    return table.select(F.col("id").alias("old_id"), F.struct(*_FIELDS).alias("previous"))


def _written(version: int) -> list[Column]:
    return [
        F.col("id"),
        F.col("provenance"),
        F.lit(version).cast("long").alias("introduced"),
        F.col("previous.introduced").alias("supersedes"),
    ]


def insert(members: DataFrame, table: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """``inserted`` or ``replaced`` for each member of the batch."""
    met = members.join(_previous(table), F.col("id") == F.col("old_id"), "left")
    changes = met.select("id", F.when(F.col("old_id").isNull(), "inserted").otherwise("replaced").alias("change"), "previous")
    after = table.join(members.select("id"), "id", "left_anti").select("id", *_FIELDS).unionByName(met.select(*_written(version)))
    return changes, after


def remove(ids: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``removed`` or ``absent_on_remove`` for each id named."""
    met = ids.select("id").distinct().join(_previous(table), F.col("id") == F.col("old_id"), "left")
    changes = met.select(
        "id", F.when(F.col("old_id").isNull(), "absent_on_remove").otherwise("removed").alias("change"), "previous"
    )
    return changes, table.join(ids.select("id"), "id", "left_anti").select("id", *_FIELDS)


def rebuild(members: DataFrame, table: DataFrame, version: int) -> tuple[DataFrame, DataFrame]:
    """``inserted``, ``replaced`` or ``dropped`` for each member of the batch or the table."""
    met = members.join(_previous(table), F.col("id") == F.col("old_id"), "full_outer")
    change = F.when(F.col("id").isNull(), "dropped").when(F.col("old_id").isNull(), "inserted").otherwise("replaced")
    changes = met.select(F.coalesce("id", "old_id").alias("id"), change.alias("change"), "previous")
    return changes, met.filter(F.col("id").isNotNull()).select(*_written(version))


def destroy(table: DataFrame) -> DataFrame:
    """``retired`` for every member."""
    return table.select("id", F.lit("retired").alias("change"), F.struct(*_FIELDS).alias("previous"))


def with_provenance(hits: DataFrame, table: DataFrame, version: int) -> DataFrame:
    """Ranked hits with the provenance of each id and the version that answered."""
    return hits.join(table.select("id", "provenance"), "id", "left").select(
        "rank", "id", "score", "provenance", F.lit(version).cast("long").alias("version")
    )
