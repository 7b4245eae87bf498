"""Chat formatting by cumulative-snapshot collapse (DataFrame functions only).

A chat service logs a conversation again after every turn, so most logged
conversations are prefixes of a longer one. ``format_chats`` numbers the turns
of each conversation, keeps a rolling hash of the turns so far (the XOR of 64-bit
hashes of position, role and text, under two seeds), and drops every
conversation whose full hash is a proper prefix of another conversation. Of
conversations with the same turns the smallest ``conv_id`` stays, and null only if
there is no other. What is left is rendered with a chat template.

Defined results:

* rows that agree in conversation, turn, role and text are one logged turn;
* turns with equal ``turn`` are ordered by role, then text, nulls first;
* a null ``conv_id`` is one conversation like any other, a null role is
  rendered as ``unknown`` and a null text as the empty string (null and empty
  still count as different turns when prefixes are compared);
* an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.llm.shared import written

TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>\n"


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "idx", F.to_json(F.struct("role", "text")))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """One row per distinct turn with its position ``idx`` (from 1), nulls of role and text kept."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()
    )
    same = (
        F.lag("turn").over(order).eqNullSafe(F.col("turn"))
        & F.lag("role").over(order).eqNullSafe(F.col("role"))
        & F.lag("text").over(order).eqNullSafe(F.col("text"))
        & (F.row_number().over(order) > 1)
    )
    return (
        turns.withColumn("repeat", F.coalesce(same, F.lit(False)))
        .withColumn("idx", F.sum(F.when(F.col("repeat"), 0).otherwise(1)).over(order))
        .filter(~F.col("repeat"))
        .drop("repeat")
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Rolling hashes ``p1, p2`` of the turns up to each position, and the number of turns ``n``."""
    order = Window.partitionBy("conv_id").orderBy("idx")
    return (
        turns.withColumn("h1", _turn_hash(11))
        .withColumn("h2", _turn_hash(29))
        .select(
            "conv_id",
            "idx",
            F.bit_xor("h1").over(order).alias("p1"),
            F.bit_xor("h2").over(order).alias("p2"),
            F.max("idx").over(Window.partitionBy("conv_id")).alias("n"),
        )
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies`` of the conversations that no longer one begins with.

    Both sides of the anti-join are aggregated to one row per hash first, so a
    first turn or a whole conversation that a third of the log shares is one row.
    """
    prefixes = written(prefix_hashes(turns), "prefixes")
    ends = (
        prefixes.filter(F.col("idx") == F.col("n"))
        .groupBy("p1", "p2", "n")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    )
    inner = prefixes.filter(F.col("idx") < F.col("n")).select("p1", "p2", F.col("idx").alias("n")).distinct()
    return ends.join(inner, ["p1", "p2", "n"], "left_anti").select(
        "conv_id", F.col("n").cast("long").alias("n_turns"), "copies"
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, copies, text, n_chars`` of every maximal conversation, rendered."""
    turns = numbered_turns(conversations)
    kept = maximal_conversations(turns).withColumnRenamed("conv_id", "kept_id")
    piece = F.concat(
        F.lit(TURN_OPEN),
        F.coalesce("role", F.lit("unknown")),
        F.lit("\n"),
        F.coalesce("text", F.lit("")),
        F.lit(TURN_CLOSE),
    )
    rendered = (
        turns.select("conv_id", "idx", piece.alias("piece"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("idx", "piece"))).alias("pieces"))
        .select("conv_id", F.array_join(F.col("pieces.piece"), "").alias("text"))
    )
    return rendered.join(kept, rendered.conv_id.eqNullSafe(kept.kept_id)).select(
        "conv_id", "n_turns", "copies", "text", F.length("text").cast("long").alias("n_chars")
    )


ORACLE_SQL = """
WITH turns AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS idx
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
prefixes AS (
  SELECT conv_id, idx,
         string_agg(CAST(to_json([role, text]) AS VARCHAR), ',') OVER (PARTITION BY conv_id ORDER BY idx) AS prefix,
         max(idx) OVER (PARTITION BY conv_id) AS n
  FROM turns),
ends AS (
  SELECT min(conv_id) AS conv_id, n, prefix, count(*) AS copies FROM prefixes WHERE idx = n GROUP BY n, prefix),
kept AS (
  SELECT * FROM ends WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE idx < n)),
rendered AS (
  SELECT conv_id, string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '')
                             || '<|im_end|>' || chr(10), '' ORDER BY idx) AS text
  FROM turns GROUP BY conv_id)
SELECT k.conv_id, CAST(k.n AS BIGINT) AS n_turns, CAST(k.copies AS BIGINT) AS copies, r.text,
       CAST(length(r.text) AS BIGINT) AS n_chars
FROM kept k JOIN rendered r ON k.conv_id IS NOT DISTINCT FROM r.conv_id
"""
