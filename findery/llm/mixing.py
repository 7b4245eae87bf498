"""Mixing sources to target weights by subset-sum budget fitting.

Sources in code-point order (null last) get the weights of a repeating list and
share a total of words; no target exceeds ``max_repeats`` times its source, and
what is over goes to the others by weight. A source's documents are counted by
exact length. Whole passes over a source come first; the remaining budget is
fitted by taking an even share of every length, then the longest documents that
still fit, then an exact bounded-knapsack dynamic programme over the last words.
The lengths' counts are then met by the documents that a seeded hash puts first.

Defined results: a null text has size 0 and takes 0 words; a null source is a
source of its own; a source without words has target 0; repeated rows are
documents of their own; an empty table gives an empty table. ``mixed_documents``
keeps all columns; ``mix`` ignores others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.llm.shared import discard, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 17
#: Words that the dynamic programme fits exactly; larger rests are first brought below it.
EXACT_BUDGET = 1 << 15
#: Documents of one source and length that are ranked together.
RANKED_TOGETHER = 512
#: Equal rows that are written out together.
TOGETHER = 10_000
#: Sources up to which the table of targets is sent to every executor.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    marks = F.regexp_replace(text, "[^\\x20\\x09-\\x0D]+", "w")
    return F.coalesce(F.length(marks) - F.length(F.replace(marks, F.lit("w"), F.lit(""))), F.lit(0)).cast("long")


def source_targets(
    sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> list[tuple[int, str | None, int, float]]:
    """``(position, source, size, target)``: shares of all words by weight, held to the limit."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode("utf-8")))
    weight = [weights[i % len(weights)] for i in range(len(ordered))]
    target: list[float | None] = [None] * len(ordered)
    left = float(sum(n for _, n in ordered))
    while True:
        free = [i for i, t in enumerate(target) if t is None]
        total = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / total > max_repeats * ordered[i][1]]
        if not over:
            break
        for i in over:
            target[i] = float(max_repeats * ordered[i][1])
            left -= target[i]
    for i in free:
        target[i] = left * weight[i] / total
    return [(i, source, n, target[i]) for i, (source, n) in enumerate(ordered)]


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come near to ``budget``, not over.

    An even share of every length and then the longest that fit bring the rest
    below ``EXACT_BUDGET``; of what is left of the lengths, the sum nearest to that
    rest is found exactly. ``lengths`` are distinct and positive. Memory is bounded by the number of
    lengths times ``EXACT_BUDGET`` bits.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.astype(np.int64).copy()
    take = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    rest = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= EXACT_BUDGET:
            break
        more = min(int(counts[i] - take[i]), (rest - EXACT_BUDGET) // int(lengths[i]))
        if more > 0:
            take[i] += more
            rest -= more * int(lengths[i])
    rest = min(rest, EXACT_BUDGET + int(lengths.max()))
    # bounded knapsack: bit s of reach[j] says that the first j (length, multiple) items can make s words
    items = []
    for i in np.argsort(-lengths, kind="stable"):
        free, multiple = min(int(counts[i] - take[i]), rest // int(lengths[i])), 1
        while free > 0:
            multiple = min(multiple, free)
            items.append((int(i), multiple, int(lengths[i]) * multiple))
            free -= multiple
            multiple *= 2
    mask = (1 << (rest + 1)) - 1
    reach = [1]
    for _, _, words in items:
        reach.append((reach[-1] | reach[-1] << words) & mask)
        if reach[-1] >> rest & 1:
            break
    at = reach[-1].bit_length() - 1
    for (i, multiple, words), before in zip(reversed(items[: len(reach) - 1]), reversed(reach[:-1]), strict=True):
        if not before >> at & 1:
            take[i] += multiple
            at -= words
    return take


def _fits(max_repeats: int):
    def fit(groups: pd.DataFrame) -> pd.DataFrame:
        size, target = int(groups["source_size"].iloc[0]), float(groups["target"].iloc[0])
        budget = round(target)
        passes = min(budget // size, max_repeats) if size else 0
        lengths, counts = groups["size"].to_numpy(np.int64), groups["docs"].to_numpy(np.int64)
        take = np.zeros(len(groups), dtype=np.int64)
        some = lengths > 0
        if passes < max_repeats:
            take[some] = fit_budget(lengths[some], counts[some], budget - passes * size)
        return pd.DataFrame({"sid": groups["sid"], "size": lengths, "docs": counts, "passes": passes, "more": take})

    return fit


def _decided(documents: DataFrame, weights: Sequence[int], max_repeats: int, seed: int) -> DataFrame:
    """``source, doc_id, draw, size, source_size, target, rows, passes, more`` of rows equal in all of the first four.

    ``rows`` are as many as there are; each is taken ``passes`` times and ``more`` of them once again.
    """
    spark = documents.sparkSession
    base = written(
        documents.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw"),
        )
        .groupBy("source", "size", "draw", "doc_id")
        .agg(F.count(F.lit(1)).alias("rows")),
        "mix-base",
    )
    by_length = written(base.groupBy("source", "size").agg(F.sum("rows").alias("docs")), "mix-lengths")
    sizes = [
        (r["source"], int(r["words"]))
        for r in by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words")).toLocalIterator()
    ]
    targets = spark.createDataFrame(
        source_targets(sizes, weights, max_repeats) if sizes else [],
        "sid int, target_source string, source_size long, target double",
    )
    if len(sizes) <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    on_source = F.col("source").eqNullSafe(F.col("target_source"))
    fitted = written(
        by_length.join(targets, on_source)
        .select("sid", "size", "docs", "source_size", "target")
        .groupBy("sid")
        .applyInPandas(_fits(max_repeats), "sid int, size long, docs long, passes long, more long"),
        "mix-fits",
    )
    discard(by_length)
    parts = F.ceil(F.col("docs") / RANKED_TOGETHER)
    # lengths grow in number with the documents, so they are not sent to every executor
    dealt = written(
        base.join(targets, on_source)
        .join(fitted.hint("shuffle_merge"), ["sid", "size"])
        .withColumn("part", F.pmod(F.shiftright(F.col("draw"), 20), parts))
        .drop("target_source", "docs"),
        "mix-dealt",
    )
    for table in (base, fitted):
        discard(table)
    # documents of the same source and length that come in parts before one's own
    earlier = Window.partitionBy("sid", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("sid", "size", "part")
        .agg(F.sum("rows").alias("in_part"))
        .withColumn("start", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)))
        .drop("in_part")
    )
    before = Window.partitionBy("sid", "size", "part").orderBy("draw", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("rows").over(before), F.lit(0))
    return (
        dealt.join(starts.hint("shuffle_merge"), ["sid", "size", "part"])
        .withColumn("more", F.least(F.col("rows"), F.greatest(F.lit(0), F.col("more") - first)))
        .select("source", "doc_id", "draw", "size", "source_size", "target", "rows", "passes", "more")
    )


def mix(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row.

    The driver sees one row for each source; the lengths of a source meet in
    one task as counts. Rows equal in source, ``doc_id`` and text are one with a
    number, and documents of one source and length are dealt by their seeded hash
    to as many parts as their number asks for, so neither a large source nor
    thousands of copies meet in one task.
    """
    decided = _decided(documents, weights, max_repeats, seed)
    # equal rows come back in steps, which are dealt anew before they are written out
    step = F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(TOGETHER)))
    facts = ["doc_id", "size", "source_size", "target", "passes"]
    many = decided.filter("rows > 1").withColumn("first", step).repartition("doc_id", "draw", "first")
    number = F.explode(F.sequence(F.col("first"), F.least(F.col("first") + TOGETHER, F.col("rows")) - 1))
    single = decided.filter("rows = 1").select(*facts, "more")
    repeated = many.withColumn("number", number).select(*facts, (F.col("number") < F.col("more")).cast("long").alias("more"))
    return single.unionByName(repeated).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).alias("taken")
    )


def mixed_documents(
    documents: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """The documents of the mix with all their columns, each row as often as the mix takes it.

    Decisions are made on narrow rows and joined back once, by source, ``doc_id``
    and draw. Of rows equal in these the first, in any order, are taken once more.
    """
    decided = written(
        _decided(documents, weights, max_repeats, seed)
        .filter("size > 0 AND passes * rows + more > 0")
        .select(F.struct("source", "doc_id", "draw").alias("of"), "rows", "passes", "more"),
        "mix-decided",
    )
    # the documents are one column, so that no name of theirs clashes
    whole = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"),
        F.struct("source", "doc_id", F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw")).alias("own"),
    )
    on_own = F.col("own").eqNullSafe(F.col("of"))
    out = whole.join(decided.filter("rows = 1").hint("merge"), on_own).select("row", (F.col("passes") + F.col("more")).alias("copies"))
    many = decided.filter("rows > 1")
    if not many.isEmpty():
        found = written(whole.join(many.hint("merge"), on_own).withColumn("id", F.monotonically_increasing_id()), "mix-repeated")
        # equal rows are numbered within the parts of the written table, and the parts by what comes before them
        part = F.shiftright("id", 33).alias("part")
        earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = (
            found.groupBy("of", part)
            .agg(F.count(F.lit(1)).alias("in_part"))
            .select("of", "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("start"))
            .withColumnsRenamed({"of": "start_of", "part": "start_part"})
        )
        within = F.row_number().over(Window.partitionBy("of", "part").orderBy("id"))
        numbers = (
            found.select("id", "of", part, "passes", "more")
            .withColumn("number", within)
            .join(starts, F.col("of").eqNullSafe(F.col("start_of")) & (F.col("part") == F.col("start_part")))
            .select(
                F.col("id").alias("numbered"),
                (F.col("passes") + (F.col("start") + F.col("number") <= F.col("more")).cast("long")).alias("copies"),
            )
        )
        out = out.unionByName(found.join(numbers, F.col("id") == F.col("numbered")).select("row", "copies"))
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return out.filter("copies > 0").withColumn("copy", copy).select("row.*")
