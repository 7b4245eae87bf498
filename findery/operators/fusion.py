"""Reciprocal-rank fusion of any number of rankings."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findery.errors import InvalidKConstant

DEFAULT_K = 60.0
#: Fused rows that one task ranks.
RANKED_TOGETHER = 200_000


def rrf(rankings: DataFrame, k: float = DEFAULT_K, limit: int | None = None, few: bool = False) -> DataFrame:
    """``rank, id, score`` from ``ranking_idx, rank, id``: positions only, the best one of an id in a ranking.

    Sums are in double, in order of ``ranking_idx``; the order is by the double
    sum, then id, and the score is narrowed to 32 bits last. ``few`` says that the
    rankings are the best hits of one query, which one task can rank.
    """
    if not (isinstance(k, int | float) and math.isfinite(k) and k > 0):
        raise InvalidKConstant(str(k))
    best = rankings.groupBy("ranking_idx", "id").agg(F.min("rank").alias("best"))
    parts = F.array_sort(F.collect_list(F.struct("ranking_idx", (F.lit(1.0) / (F.lit(float(k)) + F.col("best"))).alias("part"))))
    fused = best.groupBy("id").agg(parts.alias("parts")).select(
        "id", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"]).alias("exact")
    )
    order = [F.col("exact").desc(), F.col("id").asc()]
    if limit is not None or few:
        best = fused if limit is None else fused.orderBy(*order).limit(limit)
        ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # the window sees few rows
    else:
        ranked = _numbered(fused)
    return ranked.select("rank", "id", F.col("exact").cast("float").alias("score"), "exact")


def _numbered(fused: DataFrame) -> DataFrame:
    """``id, exact`` with its ``rank``: ranks within ranges of ``exact``, and what the ranges before hold."""
    rows = fused.count()
    ranges = -(-rows // RANKED_TOGETHER)
    bounds = fused.approxQuantile("exact", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    above = F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x > F.col("exact"))) if bounds else F.lit(0)
    ranged = fused.withColumn("range", above)
    counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("held"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = counts.select("range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col("exact").desc(), "id"))
    return ranged.withColumn("own", own).join(starts, "range").withColumn("rank", (F.col("own") + F.col("start")).cast("int"))


def as_rankings(*rankings: DataFrame) -> DataFrame:
    """One table of rankings from tables of ``rank, id``."""
    out = None
    for i, r in enumerate(rankings):
        part = r.select(F.lit(i).alias("ranking_idx"), F.col("rank").cast("int").alias("rank"), "id")
        out = part if out is None else out.unionByName(part)
    return out


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, k: float = DEFAULT_K, limit: int | None = None) -> DataFrame:
    """Fusion of the text hits and the vector hits of a query."""
    return rrf(as_rankings(text_hits, vector_hits), k, limit, few=True)
