"""Whole-index snapshots: Parquet beside a manifest, named by a pointer that moves at once.

A save writes a fresh folder and then the next pointer ``{name}/{seq}.json``; a
reader takes the highest one, so it sees the last whole save or none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findery.errors import CorruptSnapshot, IndexNotFound, Persistence, SnapshotFormat, UnsupportedSnapshotVersion
from findery.operators.bm25 import Bm25Index
from findery.operators.hnsw import HnswIndex
from findery.operators.vectors import VectorIndex, check_vectors
from findery.schemas import FORMAT_VERSION, Family, config_from_json
from findery.sources.files import Files

#: The family of snapshots of navigable graphs.
GRAPH = "graph"


def write_tables(tables: dict[str, DataFrame], path: str, by_term: bool = True) -> dict:
    """Writes tables below ``path``; their schemas and row counts for the manifest.

    Postings are laid out by term, so that a filter on terms skips most files and
    row groups; lengths come from the postings as written, not from the texts again.
    Without ``by_term`` they stay in the order they come in.
    """
    out = {}
    for name, df in tables.items():
        if name == "tf" and by_term:
            # as they come first: dealing by ranges reads its input twice, and that shouldn't read the texts twice
            df.write.parquet(f"{path}/unsorted")
            spark = df.sparkSession
            unsorted = spark.read.schema(df.schema).parquet(f"{path}/unsorted")
            unsorted.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.parquet(f"{path}/{name}")
            Files(spark, path).delete("unsorted")
        else:
            df.write.parquet(f"{path}/{name}")
        out[name] = {"schema": df.schema.jsonValue(), "rows": df.sparkSession.read.parquet(f"{path}/{name}").count()}
    return out


def read_tables(spark: SparkSession, path: str, facts: dict) -> dict[str, DataFrame]:
    """The tables that a manifest names; a missing file or row is corruption, not a short answer."""
    out = {}
    for name, fact in facts.items():
        schema = T.StructType.fromJson(fact["schema"])
        try:
            df = spark.read.schema(schema).parquet(f"{path}/{fact.get('folder', name)}")
            rows = df.count()
        except Exception as e:
            raise CorruptSnapshot(f"{name} can't be read: {e}") from e
        if rows != fact["rows"]:
            raise CorruptSnapshot(f"{name} has {rows} rows, not {fact['rows']}")
        out[name] = df
    return out


def check_fts(index: Bm25Index) -> None:
    """What a stored text index must hold: positive counts, no empty term, lengths that add up, unique keys."""
    odd = F.expr("tf <= 0 OR term = '' OR term IS NULL OR id IS NULL")
    sums = (
        index.tf.groupBy("id", "term")
        .agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("n"), F.min("length").alias("low"), F.max("length").alias("high"), F.count_if(odd).alias("odd"))
        .groupBy("id")
        .agg(F.sum("tf").alias("total"), F.max("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("odd").alias("odd"))
    )
    docs = index.docs.groupBy("id").agg(F.count(F.lit(1)).alias("times"), F.min("length").alias("length"))
    uneven = docs.join(sums, "id", "full_outer").filter(
        "length IS NULL OR id IS NULL OR times > 1 OR coalesce(total, 0) <> length OR n > 1 OR odd > 0 OR low <> length OR high <> length"
    )
    if not uneven.isEmpty():
        raise CorruptSnapshot("the text index contradicts itself")


def check_vector_payload(index: VectorIndex) -> None:
    try:
        check_vectors(index.config, index.vectors)
    except Exception as e:
        raise CorruptSnapshot(str(e)) from e
    if not index.vectors.groupBy("id").count().filter("count > 1").isEmpty():
        raise CorruptSnapshot("a member is stored twice")


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    def save_vector_index(self, name: str, index: VectorIndex) -> None:
        self._save(Family.VECTOR, name, index.config.to_json(), {"vectors": index.vectors})

    def save_fts_index(self, name: str, index: Bm25Index) -> None:
        index.config.check()
        self._save(Family.FTS, name, index.config.to_json(), {"docs": index.docs, "tf": index.tf})

    def load_vector_index(self, name: str) -> VectorIndex:
        config, tables = self._load(Family.VECTOR, name)
        index = VectorIndex(tables["vectors"], config)
        check_vector_payload(index)
        return index

    def load_fts_index(self, name: str) -> Bm25Index:
        config, tables = self._load(Family.FTS, name)
        index = Bm25Index(tables["docs"], tables["tf"], config)
        check_fts(index)
        return index

    def save_graph_index(self, name: str, index: HnswIndex) -> None:
        self._save(GRAPH, name, index.config.to_json() | {"shards": index.count}, {"shards": index.shards})

    def load_graph_index(self, name: str) -> HnswIndex:
        """The graphs as they were saved; one that breaks an invariant is refused."""
        config, tables, stored = self._read(GRAPH, name)
        if not isinstance(stored.get("shards"), int) or stored["shards"] < 1:
            raise CorruptSnapshot(f"{name}: no number of shards")
        index = HnswIndex(tables["shards"], config, stored["shards"])
        index.check()
        return index

    def _save(self, family: str, name: str, config: dict, tables: dict[str, DataFrame]) -> None:
        folder = f"data/{family}/{uuid.uuid4().hex}"
        try:
            facts = write_tables(tables, f"{self.files.root}/{folder}")
        except Exception as e:
            raise Persistence(f"saving {name}: {e}") from e
        manifest = {"format_version": FORMAT_VERSION, "family": str(family), "config": config, "folder": folder, "tables": facts}
        while True:
            seq = len(self._pointers(family, name)) + 1
            if self.files.create(f"{family}/{name}/{seq:020d}.json", json.dumps(manifest).encode()):
                return

    def _pointers(self, family: str, name: str) -> list[str]:
        return [f for f in self.files.list(f"{family}/{name}") if f.endswith(".json")]

    def _load(self, family: str, name: str) -> tuple:
        return self._read(family, name)[:2]

    def _read(self, family: str, name: str) -> tuple:
        """Configuration, tables, and the configuration as it is stored."""
        pointers = self._pointers(family, name)
        if not pointers:
            raise IndexNotFound(name)
        try:
            manifest = json.loads(self.files.read(f"{family}/{name}/{pointers[-1]}"))
        except ValueError as e:
            raise CorruptSnapshot(f"{name}: no manifest") from e
        if not isinstance(manifest, dict) or manifest.get("format_version") != FORMAT_VERSION:
            raise UnsupportedSnapshotVersion(f"{name}: format {manifest.get('format_version') if isinstance(manifest, dict) else None}")
        if manifest.get("family") != str(family):
            raise SnapshotFormat(f"{name} is {manifest.get('family')}")
        if set(manifest) != {"format_version", "family", "config", "folder", "tables"}:
            raise CorruptSnapshot(f"{name}: unknown or missing fields")
        tables = read_tables(self.spark, f"{self.files.root}/{manifest['folder']}", manifest["tables"])
        return config_from_json(manifest["config"]), tables, manifest["config"]
