"""Connected components of links, as joins and partial aggregates over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.shared import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join deals both sides anew and can split a node with many links
    least = written(
        both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "least"
    )
    moved = written(
        both.join(least.hint("merge"), "u")
        .filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("least").alias("v"))
        .distinct(),
        "large-stars",
    )
    discard(least)
    return moved


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("least")), "least")
    moved = down.join(least.hint("merge"), "u").filter(F.col("v") > F.col("least")).select(F.col("v").alias("u"), F.col("least").alias("v"))
    found = written(moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct(), "small-stars")
    discard(least)
    return found


def _settled(edges: DataFrame) -> bool:
    """Whether all components are stars: every node has one link, down to a node that has none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("links"), F.lit(0).alias("root")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("links"), F.lit(1).alias("root"))
    )
    each = ends.groupBy("x").agg(F.sum("links").alias("links"), F.max("root").alias("root"))
    return each.filter("links + root > 1").agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links(u, v)`` that isn't the smallest of its component, its root.

    Alternating large and small stars until there are only stars. A node with many
    links is aggregated before the shuffle and joined by splittable joins; each
    round is a written table, so lineage stays short.
    """
    edges = written(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter(F.col("u") > F.col("v"))
        .distinct(),
        "links",
    )
    while not _settled(edges):
        large = _large_star(edges)
        found = _small_star(large)
        discard(edges)
        discard(large)
        edges = found
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots._findery_path = edges._findery_path  # for discard
    return roots
