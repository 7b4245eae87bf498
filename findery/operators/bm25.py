"""Full-text index: upserts, statistics, BM25 for one query or a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from findery.errors import DuplicateMember, InvalidIdentifier
from findery.functions.text import document_terms, tokenize
from findery.schemas import FtsConfig

K1, B = 1.2, 0.75
#: Rows of queries and terms up to which they are sent to every executor; larger batches are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Terms up to which a query names them in a filter that reaches the scan of stored postings.
FILTER_TERMS = 256
#: Contributions are added as whole multiples of this, so that a sum doesn't depend on their order.
UNIT = 2.0**-40


def idf(n_docs: Column, df: Column) -> Column:
    return F.ln(1 + (n_docs - df + F.lit(0.5)) / (df + F.lit(0.5)))


def term_score(idf_value: Column, tf: Column, length: Column, average: Column) -> Column:
    norm = 1 - B + B * length / average
    return idf_value * tf * (K1 + 1) / (tf + K1 * norm)


def check_ids(batch: DataFrame) -> None:
    """Refuses null ids and ids that the batch names twice: a table has no last one."""
    if not batch.filter(F.col("id").isNull()).isEmpty():
        raise InvalidIdentifier("null id")
    twice = batch.groupBy("id").count().filter("count > 1").orderBy("id").first()
    if twice is not None:
        raise DuplicateMember(str(twice["id"]))


class Bm25Index:
    """``docs(id, length)`` and ``tf(id, term, tf, length)``; immutable, every change gives another index.

    A posting holds its document's length, so scoring needs no join with ``docs``.
    """

    def __init__(self, docs: DataFrame, tf: DataFrame, config: FtsConfig | None = None):
        self.docs, self.tf = docs, tf
        self.config = config or FtsConfig.simple()

    @staticmethod
    def empty(spark: SparkSession, config: FtsConfig | None = None, id_type: str = "bigint") -> Bm25Index:
        config = config or FtsConfig.simple()
        config.check()
        docs = spark.createDataFrame([], f"id {id_type}, length bigint")
        return Bm25Index(docs, spark.createDataFrame([], f"id {id_type}, term string, tf bigint, length bigint"), config)

    @staticmethod
    def build(documents: DataFrame, config: FtsConfig | None = None, check: bool = True) -> Bm25Index:
        """From ``id, text``. A null text has no tokens."""
        config = config or FtsConfig.simple()
        config.check()
        if check:
            check_ids(documents)
        terms = document_terms(documents.select("id", F.coalesce("text", F.lit("")).alias("text")))
        tf = (
            terms.select("id", "length", F.explode("terms").alias("term"))
            .groupBy("id", "length", "term")
            .agg(F.count(F.lit(1)).alias("tf"))
            .select("id", "term", "tf", "length")
        )
        return Bm25Index(terms.select("id", "length"), tf, config)

    def insert(self, documents: DataFrame) -> Bm25Index:
        """Adds documents; one with a known id replaces it."""
        added = Bm25Index.build(documents, self.config)
        left = self._without(documents.select("id"))
        return Bm25Index(left.docs.unionByName(added.docs), left.tf.unionByName(added.tf), self.config)

    def remove(self, ids: DataFrame) -> Bm25Index:
        """Without the documents named; unknown ids change nothing."""
        self.config.check()
        return self._without(ids.select("id"))

    def _without(self, ids: DataFrame) -> Bm25Index:
        ids = ids.distinct()
        return Bm25Index(self.docs.join(ids, "id", "left_anti"), self.tf.join(ids, "id", "left_anti"), self.config)

    def __len__(self) -> int:
        return self.docs.count()

    def is_empty(self) -> bool:
        return self.docs.isEmpty()

    def member_ids(self) -> DataFrame:
        return self.docs.select("id").orderBy("id")

    def stats(self) -> DataFrame:
        """One row: documents, tokens and mean length (0 where there are no tokens)."""
        return self.docs.agg(
            F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_terms")
        ).withColumn("avgdl", F.coalesce(F.try_divide("total_terms", "n_docs"), F.lit(0.0)))

    def document_frequency(self) -> DataFrame:
        return self.tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def query(self, text: str, k: int) -> DataFrame:
        """``rank, id, score`` of the ``k`` best documents: 32-bit score descending, then id."""
        self.config.check()
        spark = self.docs.sparkSession
        queries = spark.createDataFrame([(0, text)], "query_id int, text string")
        scored = self._scores(queries)
        best = scored.orderBy(F.col("score").desc(), "id").limit(max(0, k))
        rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "id"))
        return best.select(rank.alias("rank"), "id", "score", "exact")  # the window sees k rows

    def query_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, rank, id, score`` for every row of ``query_id, text``."""
        self.config.check()
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
        return (
            self._scores(queries)
            .withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select("query_id", "rank", "id", "score", "exact")
        )

    def _scores(self, queries: DataFrame) -> DataFrame:
        asked = queries.select(
            "query_id", F.explode(F.array_distinct(tokenize(F.coalesce("text", F.lit(""))))).alias("term")
        )
        terms = asked.select("term").distinct()
        few = [r["term"] for r in terms.limit(FILTER_TERMS + 1).collect()]  # bounded
        # only the postings of the terms asked for go on
        if len(few) <= FILTER_TERMS:
            postings = self.tf.filter(F.col("term").isin(few)) if few else self.tf.limit(0)
            asked = F.broadcast(asked) if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else asked
        elif asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
            asked = F.broadcast(asked)
            postings = self.tf.join(F.broadcast(terms), "term", "left_semi")
        else:
            postings = self.tf.join(terms, "term", "left_semi")
        # names all columns of a posting, so that both uses of the postings share one exchange
        held = (F.col("tf") > 0) & (F.col("length") > 0) & F.col("id").isNotNull()
        frequency = postings.groupBy("term").agg(F.count_if(held).alias("df"))
        value = term_score(
            idf(F.col("n_docs"), F.col("df")), F.col("tf"), F.col("length"), F.nullif("avgdl", F.lit(0.0))
        )
        weighted = (
            postings.join(frequency, "term")
            .crossJoin(F.broadcast(self.stats()))  # one row
            .select("term", "id", F.round(value / F.lit(UNIT)).cast("long").alias("part"))
        )
        return (
            weighted.join(asked, "term")
            .groupBy("query_id", "id")
            .agg((F.sum("part") * F.lit(UNIT)).alias("exact"))
            .withColumn("score", F.col("exact").cast("float"))
        )
