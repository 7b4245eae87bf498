"""Registered queries that run the lifecycle, the stores and the refusals for real, and the SQL of what must come out.

One script per table folder: an index of all documents goes through create,
insert, a second insert (ids doubled, so that some members are replaced and some
are new), remove, rebuild and destroy; an index of all embeddings beside it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery import errors as E
from findery.operators.bm25 import Bm25Index
from findery.operators.fusion import as_rankings, rrf
from findery.operators.vectors import VectorIndex, check_vector
from findery.plans import digest as D
from findery.plans import identity
from findery.plans.lifecycle import Create, Destroy, IndexIdentity, Insert, Lifecycle, Operation, Rebuild, Remove
from findery.schemas import FtsConfig, HnswConfig, TokenizerConfig, VectorDistance, config_from_json
from findery.sources import keys
from findery.sources.files import Files
from findery.sources.folders import shared_dir
from findery.sources.log import DestroyWrite, FileLog, LifecycleStore, MemoryLog, StageWrite, WriterLock
from findery.sources.snapshot import SnapshotStore
from findery.streaming.ingest import ingest

Query = Callable[[SparkSession, str], DataFrame]

#: Fixed values of the registered queries.
NOTES = IndexIdentity("example", "documents")
POINTS = IndexIdentity("example", "embeddings.v1")
TERMS = "the licensed erneat"
K = 10
ASKED_VECTOR = 7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _members(spark: SparkSession, sf_dir: str, times: int = 1, provenance: str = "source") -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select((F.col("doc_id") * times).alias("id"), F.col(provenance).alias("provenance"), "text")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("provenance"), F.col("embedding").alias("vector"))


def _lifecycle(spark: SparkSession) -> Lifecycle:
    root = f"{shared_dir(spark)}/lifecycle-{uuid.uuid4().hex}"
    return Lifecycle(spark, root, LifecycleStore(FileLog(Files(spark, root))))


class _Script:
    """The operations in order, as far as they were asked for; every step is applied once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.lifecycle = _lifecycle(spark)
        self.receipts: dict[str, object] = {}
        self.published: dict[str, object] = {}
        members = lambda *a: _members(spark, sf_dir, *a)
        self.steps: dict[str, Operation] = {
            "create-1": Operation(NOTES, "create-1", Create(FtsConfig.simple())),
            "insert-2": Operation(NOTES, "insert-2", Insert(members())),
            "insert-3": Operation(NOTES, "insert-3", Insert(members(2, "lang"))),
            "remove-4": Operation(NOTES, "remove-4", Remove(members(3).select("id"))),
            "rebuild-5": Operation(NOTES, "rebuild-5", Rebuild(FtsConfig.simple(), members(2, "lang"))),
            "destroy": Operation(NOTES, "destroy", Destroy({"days": 30, "why": ["end", None, True]})),
            "points-1": Operation(POINTS, "points-1", Create(HnswConfig(64, VectorDistance.COSINE))),
            "points-2": Operation(POINTS, "points-2", Insert(_points(spark, sf_dir))),
            "points-3": Operation(POINTS, "points-3", Remove(_points(spark, sf_dir).select((F.col("id") * 3).alias("id")))),
        }

    def until(self, last: str) -> _Script:
        own = self.steps[last].index
        for key, step in self.steps.items():
            if step.index == own and key not in self.receipts:
                self.receipts[key] = self.lifecycle.apply(step)
                if not isinstance(step.change, Destroy):
                    self.published[key] = self.lifecycle.index(own)
            if key == last:
                return self
        return self


@cache
def _script(application: str, sf_dir: str) -> _Script:
    return _Script(SparkSession.active(), sf_dir)


def _run(spark: SparkSession, sf_dir: str, last: str) -> _Script:
    return _script(spark.sparkContext.applicationId, sf_dir).until(last)


def lifecycle_published_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "remove-4").published["remove-4"].members


def lifecycle_rebuilt_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "rebuild-5").published["rebuild-5"].members


def lifecycle_text_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _run(spark, sf_dir, "remove-4").published["remove-4"].query_text(TERMS, K)
    return hits.withColumn("score", F.round(F.col("score").cast("double"), 2))


def lifecycle_vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    published = _run(spark, sf_dir, "points-3").published["points-3"]
    asked = _points(spark, sf_dir).filter(F.col("id") == ASKED_VECTOR).first()["vector"]
    return published.query_vector(asked, K).withColumn("score", F.round(F.col("score").cast("double"), 2))


def lifecycle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    script, out = _run(spark, sf_dir, "destroy"), None
    for key in ("insert-2", "insert-3", "remove-4", "rebuild-5", "destroy"):
        old = [F.col(f"previous.{c}").alias(f"old_{c}") for c in ("provenance", "introduced", "supersedes")]
        rows = script.lifecycle.changes_of(script.receipts[key].record).select(F.lit(key).alias("operation"), "id", "change", *old)
        out = rows if out is None else out.unionByName(rows)
    return out


def lifecycle_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each step as it was applied, and once more: the same key with the same content answers with the first result."""
    script, rows = _run(spark, sf_dir, "destroy"), []
    for key, receipt in script.receipts.items():
        if script.steps[key].index == NOTES:
            again = script.lifecycle.apply(script.steps[key])
            record = receipt.record
            rows.append((key, receipt.version, receipt.replayed, again.version, again.replayed, record["transition"], record["from"], len(record["digest"])))
    return spark.createDataFrame(
        rows, "operation string, version long, replayed boolean, again long, again_replayed boolean, transition string, from_version long, digits long"
    )


def lifecycle_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = _run(spark, sf_dir, "destroy").until("points-3")
    rows = []
    for key, raw in script.lifecycle.store.list_heads():
        head = json.loads(raw)
        config = config_from_json(head["config"])
        rows.append((*keys.parse_head(key), head["state"], head["version"], str(config.family), json.dumps(head.get("retention"))))
    return spark.createDataFrame(rows, "namespace string, name string, state string, version long, family string, retention string")


def lifecycle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members and engine entries of every version, by its own accessors."""
    script = _run(spark, sf_dir, "destroy").until("points-3")
    rows = [
        (key, p.version, len(p), len(p.engine), p.is_empty(), p.engine.is_empty(), p.engine.member_ids().count())
        for key, p in script.published.items()
    ]
    return spark.createDataFrame(
        rows, "operation string, version long, members long, entries long, no_members boolean, no_entries boolean, member_ids long"
    )


def storage_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store lists after a finished operation, an unfinished one that was recovered, and another that is staged."""
    lifecycle = _lifecycle(spark)
    index = IndexIdentity("example", "nations")
    nations = _table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("provenance"), F.col("n_name").alias("text")
    )
    lifecycle.apply(Operation(index, "first", Create(FtsConfig.simple())))
    for key, finish in (("lost", lifecycle.recover), ("second", None)):
        prepared = lifecycle.prepare(Operation(index, key, Insert(nations)))
        prepared.stage()
        prepared.close()
        if finish is not None:
            finish()
    store, rows = LifecycleStore(lifecycle.store.log), []  # another reader of the same log
    rows += [("head", key, json.loads(raw)["state"]) for key, raw in store.list_heads()]
    rows += [("staging", key, json.loads(raw)["operation"]) for key, raw in store.list_staged()]
    rows += [("operation", key, json.loads(raw)["transition"]) for key, raw in store.list_operations(index.key)]
    rows += [
        ("quarantine", keys.quarantine(q.sequence, *keys.parse_version(q.version), "marker"), json.loads(q.marker)["operation"])
        for q in store.list_quarantined()
    ]
    rows.append(("version", keys.version("example", "nations", 1), str(store.read_version(keys.version("example", "nations", 1)) is not None)))
    rows.append(("staged", index.key, str(store.read_staging(index.key))))
    return spark.createDataFrame(rows, "kind string, storage_key string, detail string")


def storage_parsed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of every nation parsed back into their parts."""
    rows = []
    for r in _table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("name")).toLocalIterator():
        name, number = r["name"].replace(" ", "-"), int(r["n_nationkey"]) + 1
        parsed = keys.parse_quarantine(keys.quarantine(number, "example", name, number, "payload"))
        rows.append((*parsed, *keys.parse_operation(keys.operation("example", name, f"import:{number}"))[1:], keys.index_prefix("example", name)))
    return spark.createDataFrame(
        rows, "sequence long, namespace string, name string, version long, part string, own_name string, operation string, prefix string"
    )


def identity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which names of nations, in several spellings, are namespaces, index names and operation keys."""
    rows = []
    for r in _table(spark, sf_dir, "nation").select("n_name").toLocalIterator():
        for text in (r["n_name"], r["n_name"].lower(), f"-{r['n_name'].lower()}", r["n_name"].lower() * 12, f"{r['n_name']}:7"):
            found = []
            for check in (identity.check_namespace, identity.check_name, identity.check_key):
                try:
                    found.append(check(text) == text)
                except E.InvalidIdentifier:
                    found.append(False)
            rows.append((text, *found))
    return spark.createDataFrame(rows, "text string, namespace boolean, name boolean, operation boolean")


def fts_member_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    index = Bm25Index.empty(spark).insert(docs).insert(docs.withColumn("id", F.col("id") * 2)).remove(docs.withColumn("id", F.col("id") * 3))
    return index.member_ids()


def vector_member_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _points(spark, sf_dir).select("id", "vector")
    index = VectorIndex.empty(spark, HnswConfig(64)).insert(rows).insert(rows.withColumn("id", F.col("id") * 2))
    return index.remove(rows.withColumn("id", F.col("id") * 3)).member_ids()


def streaming_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ingested as a stream."""
    lifecycle = _lifecycle(spark)
    index = IndexIdentity("example", "stream")
    lifecycle.apply(Operation(index, "create", Create(FtsConfig.simple())))
    source = f"{lifecycle.root}/incoming"
    _members(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema(_members(spark, sf_dir).schema).parquet(source)
    ingest(stream, lifecycle, index, f"{lifecycle.root}/checkpoint").awaitTermination()
    return lifecycle.index(index).members.select("id", "provenance")


def snapshot_member_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of both kinds of index after a snapshot; the second save under a name is the one that is read."""
    store = SnapshotStore(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    store.save_fts_index("all", Bm25Index.build(docs.withColumn("id", F.col("id") * 2)))
    store.save_fts_index("all", Bm25Index.build(docs))
    store.save_vector_index("all", VectorIndex.build(_points(spark, sf_dir).select("id", "vector"), HnswConfig(64)))
    text, points = store.load_fts_index("all"), store.load_vector_index("all")
    return text.member_ids().select(F.lit("fts").alias("family"), "id").unionByName(
        points.member_ids().select(F.lit("vector").alias("family"), "id")
    )


def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(v.__name__, str(v.category)) for v in E.VARIANTS], "error string, category string")


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is refused, and how: each case runs for real."""
    rows: list[tuple[str, str, str]] = []

    def case(name: str, act: Callable[[], object]) -> None:
        try:
            act()
        except E.FinderyError as e:
            rows.append((name, type(e).__name__, str(e.category)))
        else:
            rows.append((name, "none", "none"))

    lifecycle = _lifecycle(spark)
    index, other = IndexIdentity("example", "a"), IndexIdentity("example", "b")
    make = lambda r, kind="id long, provenance string, vector array<float>": spark.createDataFrame(r, kind)
    one, two = make([(1, "p", [1.0, 2.0])]), make([(2, "p", [1.0, 2.0])])
    text = make([(1, "p", "alpha")], "id long, provenance string, text string")
    apply = lambda key, change, at=index: lifecycle.apply(Operation(at, key, change))
    case("namespace", lambda: IndexIdentity("Example", "a"))
    case("name", lambda: IndexIdentity("example", ""))
    case("operation key", lambda: Operation(index, "-k", Create(HnswConfig(2))))
    case("digest", lambda: identity.check_digest("A" * 64))
    case("last version", lambda: identity.next_version(identity.MOST_VERSION))
    case("version key", lambda: keys.parse_version("example/a/12"))
    case("quarantine key", lambda: keys.parse_quarantine("0" * 20 + "/example/a/" + "0" * 19 + "1/marker"))
    case("dimensions", lambda: apply("k", Create(HnswConfig(0))))
    case("neighbours", lambda: HnswConfig(2, m_neighbours=0).check())
    case("construction", lambda: HnswConfig(2, ef_construction=0).check())
    case("tokenizer", lambda: apply("k", Create(FtsConfig(TokenizerConfig("NGram", ("3",))))))
    case("filters", lambda: FtsConfig(filters=(TokenizerConfig("Stemmer"),)).check())
    case("empty insert", lambda: apply("k", Insert(one.limit(0))))
    case("empty remove", lambda: apply("k", Remove(one.select("id").limit(0))))
    case("duplicate member", lambda: apply("k", Insert(one.unionByName(one))))
    case("id type", lambda: apply("k", Insert(make([(1.5, "p", [1.0])], "id double, provenance string, vector array<float>"))))
    case("null id", lambda: apply("k", Insert(make([(None, "p", [1.0])]))))
    case("component", lambda: apply("k", Insert(make([(1, "p", [float("nan"), 1.0])]))))
    case("both contents", lambda: apply("k", Insert(one.withColumn("text", F.lit("x")))))
    case("rebuild dimensions", lambda: apply("k", Rebuild(HnswConfig(3), one)))
    case("rebuild family", lambda: apply("k", Rebuild(HnswConfig(3), text)))
    case("float retention", lambda: apply("k", Destroy({"days": 0.5})))
    case("deep retention", lambda: apply("k", Destroy(json.loads("[" * 65 + "]" * 65))))
    case("float in a digest", lambda: D.item(1.5))
    case("insert into nothing", lambda: apply("k", Insert(one)))
    case("no index", lambda: lifecycle.index(index))
    case("create", lambda: apply("create", Create(HnswConfig(2))))
    case("create again", lambda: apply("again", Create(HnswConfig(2))))
    case("same key", lambda: apply("create", Create(HnswConfig(3))))
    case("text for vectors", lambda: apply("k", Insert(text)))
    case("insert dimensions", lambda: apply("k", Insert(make([(1, "p", [1.0])]))))
    case("insert", lambda: apply("insert", Insert(one)))
    case("text query", lambda: lifecycle.index(index).query_text("alpha", 1))
    prepared = lifecycle.prepare(Operation(index, "staged", Insert(two)))
    case("writer", lambda: lifecycle.prepare(Operation(index, "k", Insert(two))))
    staged = prepared.stage()
    prepared.close()
    case("staged state", lambda: apply("k", Insert(two)))
    case("another index", lambda: apply("create", Create(HnswConfig(2)), other))
    lifecycle.recover()
    case("publish after recovery", staged.publish)
    store = lifecycle.store
    case("stage over another head", lambda: store.stage(StageWrite(index.key, "old", keys.version("example", "a", 9), "m", "p", "example/a/x")))
    head = store.read_head(index.key)
    case("stage a stored version", lambda: store.stage(StageWrite(index.key, head, keys.version("example", "a", 2), "m", "p", "example/a/x")))
    case("recorded operation", lambda: store.destroy(DestroyWrite(index.key, head, "{}", keys.operation("example", "a", "insert"), "{}")))
    case("large value", lambda: LifecycleStore(MemoryLog(), 10).stage(StageWrite("a/b", None, keys.version("a", "b", 1), "m" * 11, "p", "a/b/k")))
    folder = f"{lifecycle.root}/{store.read_version(keys.version('example', 'a', 2))}"
    make([(5, "p", 2, None)], "id long, provenance string, introduced long, supersedes long").write.mode("overwrite").parquet(f"{folder}/members")
    case("another member table", lambda: lifecycle.index(index))
    Files(spark, folder).delete("vectors")
    case("lost vectors", lambda: lifecycle.index(index))
    lock = WriterLock()
    guard = lock.acquire()
    case("lock of this thread", lock.acquire)
    guard.close()
    case("lock when free", lambda: lock.acquire().close())
    snapshots = SnapshotStore(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")
    case("no snapshot", lambda: snapshots.load_fts_index("x"))
    snapshots.save_fts_index("x", Bm25Index.build(text))
    pointer = snapshots.files.list("fts/x")[-1]
    manifest = json.loads(snapshots.files.read(f"fts/x/{pointer}"))
    for number, (name, change) in enumerate((("snapshot format", {"format_version": 9}), ("snapshot family", {"family": "vector"}), ("snapshot fields", {"extra": 1})), 2):
        snapshots.files.create(f"fts/x/{number:020d}.json", json.dumps(manifest | change).encode())
        case(name, lambda: snapshots.load_fts_index("x"))
    points = VectorIndex.build(one.select("id", "vector"), HnswConfig(2))
    case("query dimensions", lambda: points.query([1.0], 1))
    case("query component", lambda: check_vector(HnswConfig(2), [1.0, float("inf")]))
    largest = 3.4028234663852886e38
    far = VectorIndex.build(make([(1, "p", [largest, largest])]).select("id", "vector"), HnswConfig(2))
    case("distance", lambda: far.query([0.0, 0.0], 1))
    hits = as_rankings(make([(1, "a")], "rank int, id string"))
    for bad in (0, -1.0, float("nan"), float("inf")):
        case(f"fusion constant {bad}", lambda bad=bad: rrf(hits, bad))
    return spark.createDataFrame(rows, "name string, error string, category string")


def queries() -> dict[str, Query]:
    found = (
        lifecycle_published_members, lifecycle_rebuilt_members, lifecycle_text_hits, lifecycle_vector_hits, lifecycle_audit,
        lifecycle_receipts, lifecycle_heads, lifecycle_sizes, storage_listing, storage_parsed_keys, identity_grammar,
        fts_member_ids, vector_member_ids, streaming_members, snapshot_member_ids, error_categories, refusals,
    )
    return {f.__name__: f for f in found}


# ---- the same in SQL ----------------------------------------------------------------------------------------------

#: The member table after each version, and the batches that made it.
_STEPS = """docs AS (SELECT doc_id AS id, source AS provenance, text FROM documents),
twice AS (SELECT doc_id * 2 AS id, lang AS provenance, text FROM documents),
thrice AS (SELECT DISTINCT doc_id * 3 AS id FROM documents),
t2 AS (SELECT id, provenance, 2::BIGINT AS introduced, NULL::BIGINT AS supersedes, text FROM docs),
t3 AS (SELECT * FROM t2 WHERE id NOT IN (SELECT id FROM twice) UNION ALL
  SELECT n.id, n.provenance, 3::BIGINT, o.introduced, n.text FROM twice n LEFT JOIN t2 o ON n.id = o.id),
t4 AS (SELECT * FROM t3 WHERE id NOT IN (SELECT id FROM thrice)),
t5 AS (SELECT n.id, n.provenance, 5::BIGINT AS introduced, o.introduced AS supersedes FROM twice n LEFT JOIN t4 o ON n.id = o.id)"""

_ERRORS = {
    "refused": "DimensionMismatch InvalidVector DistanceNotRepresentable InvalidHnswConfig InvalidKConstant InvalidIdentifier "
    "FamilyMismatch DuplicateMember EmptyBatch TransitionNotPermitted RecordMismatch UnencodableOperation WriterHeld",
    "not_found": "IndexNotFound",
    "unsupported": "NotYetImplemented UnsupportedSnapshotVersion",
    "corrupt": "SnapshotFormat CorruptSnapshot VersionStored",
    "storage": "Persistence",
    "conflict": "HeadChanged OperationConflict StagedStateMissing OperationRecorded",
    "recovery_required": "StagedStateExists",
}

_REFUSED = [
    ("namespace", "InvalidIdentifier"), ("name", "InvalidIdentifier"), ("operation key", "InvalidIdentifier"),
    ("digest", "InvalidIdentifier"), ("last version", "InvalidIdentifier"), ("version key", "CorruptSnapshot"),
    ("quarantine key", "CorruptSnapshot"), ("dimensions", "InvalidHnswConfig"), ("neighbours", "InvalidHnswConfig"),
    ("construction", "InvalidHnswConfig"), ("tokenizer", "NotYetImplemented"), ("filters", "NotYetImplemented"),
    ("empty insert", "EmptyBatch"), ("empty remove", "EmptyBatch"), ("duplicate member", "DuplicateMember"),
    ("id type", "InvalidIdentifier"), ("null id", "InvalidIdentifier"), ("component", "InvalidVector"),
    ("both contents", "FamilyMismatch"), ("rebuild dimensions", "DimensionMismatch"), ("rebuild family", "FamilyMismatch"),
    ("float retention", "UnencodableOperation"), ("deep retention", "UnencodableOperation"),
    ("float in a digest", "UnencodableOperation"), ("insert into nothing", "TransitionNotPermitted"),
    ("no index", "IndexNotFound"), ("create", "none"), ("create again", "TransitionNotPermitted"),
    ("same key", "OperationConflict"), ("text for vectors", "FamilyMismatch"), ("insert dimensions", "DimensionMismatch"),
    ("insert", "none"), ("text query", "FamilyMismatch"), ("writer", "WriterHeld"), ("staged state", "StagedStateExists"),
    ("another index", "none"), ("publish after recovery", "StagedStateMissing"), ("stage over another head", "HeadChanged"),
    ("stage a stored version", "VersionStored"), ("recorded operation", "OperationRecorded"), ("large value", "Persistence"),
    ("another member table", "CorruptSnapshot"), ("lost vectors", "CorruptSnapshot"), ("lock of this thread", "WriterHeld"),
    ("lock when free", "none"), ("no snapshot", "IndexNotFound"), ("snapshot format", "UnsupportedSnapshotVersion"),
    ("snapshot family", "SnapshotFormat"), ("snapshot fields", "CorruptSnapshot"), ("query dimensions", "DimensionMismatch"),
    ("query component", "InvalidVector"), ("distance", "DistanceNotRepresentable"), ("fusion constant 0", "InvalidKConstant"),
    ("fusion constant -1.0", "InvalidKConstant"), ("fusion constant nan", "InvalidKConstant"),
    ("fusion constant inf", "InvalidKConstant"),
]


def _values(rows: list[tuple], columns: str) -> str:
    def text(value: object) -> str:
        if isinstance(value, int) and not isinstance(value, bool):
            return f"{value}::BIGINT"
        return "NULL" if value is None else repr(value) if isinstance(value, str) else str(value)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({columns})"


def _audit() -> str:
    out = []
    for operation, batch, before, kinds in (
        ("insert-2", "docs", "(SELECT * FROM t2 WHERE FALSE)", ("inserted", "replaced")),
        ("insert-3", "twice", "t2", ("inserted", "replaced")),
        ("remove-4", "thrice", "t3", ("absent_on_remove", "removed")),
    ):
        out.append(
            f"SELECT '{operation}' AS operation, n.id, CASE WHEN o.id IS NULL THEN '{kinds[0]}' ELSE '{kinds[1]}' END AS change, "
            f"o.provenance AS old_provenance, o.introduced AS old_introduced, o.supersedes AS old_supersedes FROM {batch} n LEFT JOIN {before} o ON n.id = o.id"
        )
    out.append(
        "SELECT 'rebuild-5', coalesce(n.id, o.id), CASE WHEN n.id IS NULL THEN 'dropped' WHEN o.id IS NULL THEN 'inserted' ELSE 'replaced' END, "
        "o.provenance, o.introduced, o.supersedes FROM twice n FULL JOIN t4 o ON n.id = o.id"
    )
    out.append("SELECT 'destroy', id, 'retired', provenance, introduced, supersedes FROM t5")
    return f"WITH {_STEPS} {' UNION ALL '.join(out)}"


def oracle_sql(bm25: Callable[[str, str], str], knn: Callable[..., str]) -> dict[str, str]:
    """``bm25(terms, documents)`` and ``knn(distance, vectors)`` give the SQL of the plain searches."""
    category = {name: c for c, names in _ERRORS.items() for name in names.split()} | {"none": "none"}
    of = "CAST(count(*) AS BIGINT)"
    sizes = " UNION ALL ".join(
        f"SELECT '{key}' AS operation, {version}::BIGINT AS version, {of} AS members, {of} AS entries, count(*) = 0 AS no_members, "
        f"count(*) = 0 AS no_entries, {of} AS member_ids FROM {table}"
        for key, version, table in (
            ("create-1", 1, "(SELECT 1 WHERE FALSE)"), ("insert-2", 2, "t2"), ("insert-3", 3, "t3"), ("remove-4", 4, "t4"),
            ("rebuild-5", 5, "t5"), ("points-1", 1, "(SELECT 1 WHERE FALSE)"), ("points-2", 2, "embeddings"),
            ("points-3", 3, "(SELECT * FROM embeddings WHERE vec_id NOT IN (SELECT vec_id * 3 FROM embeddings))"),
        )
    )
    nation = "lower(replace(n_name, ' ', '-'))"
    spellings = "[n_name, lower(n_name), '-' || lower(n_name), repeat(lower(n_name), 12), n_name || ':7']"
    left = "vec_id NOT IN (SELECT vec_id * 3 FROM embeddings)"
    return {
        "lifecycle_published_members": f"WITH {_STEPS} SELECT id, provenance, introduced, supersedes FROM t4",
        "lifecycle_rebuilt_members": f"WITH {_STEPS} SELECT id, provenance, introduced, supersedes FROM t5",
        "lifecycle_text_hits": f"WITH {_STEPS}, hits AS ({bm25(TERMS, 'SELECT id, text FROM t4')}) "
        "SELECT rank, id, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 2) AS score, provenance, 4::BIGINT AS version FROM hits JOIN t4 USING (id)",
        "lifecycle_vector_hits": f"WITH hits AS ({knn('cosine', f'SELECT vec_id AS id, embedding AS vector FROM embeddings WHERE {left}')}) "
        "SELECT rank, id, round(CAST(CAST(score AS FLOAT) AS DOUBLE), 2) AS score, CAST(label AS VARCHAR) AS provenance, 3::BIGINT AS version FROM hits JOIN embeddings ON vec_id = id",
        "lifecycle_audit": _audit(),
        "lifecycle_receipts": _values(
            [
                (key, version, False, version, True, key.split("-")[0], before, 64)
                for key, version, before in (("create-1", 1, None), ("insert-2", 2, 1), ("insert-3", 3, 2), ("remove-4", 4, 3), ("rebuild-5", 5, 4), ("destroy", 5, 5))
            ],
            "operation, version, replayed, again, again_replayed, transition, from_version, digits",
        ),
        "lifecycle_heads": _values(
            [
                ("example", "documents", "destroyed", 5, "fts", '{"days": 30, "why": ["end", null, true]}'),
                ("example", "embeddings.v1", "active", 3, "vector", "null"),
            ],
            "namespace, name, state, version, family, retention",
        ),
        "lifecycle_sizes": f"WITH {_STEPS} {sizes}",
        "storage_listing": _values(
            [
                ("head", "example/nations", "active"),
                ("staging", "example/nations/00000000000000000002", "second"),
                ("operation", "example/nations/first", "create"),
                ("quarantine", "00000000000000000001/example/nations/00000000000000000002/marker", "lost"),
                ("version", "example/nations/00000000000000000001", "True"),
                ("staged", "example/nations", "example/nations/00000000000000000002"),
            ],
            "kind, storage_key, detail",
        ),
        "storage_parsed_keys": f"SELECT n_nationkey + 1::BIGINT AS sequence, 'example' AS namespace, {nation} AS name, n_nationkey + 1::BIGINT AS version, 'payload' AS part, "
        f"{nation} AS own_name, 'import:' || (n_nationkey + 1) AS operation, 'example/' || {nation} || '/' AS prefix FROM nation",
        "identity_grammar": "SELECT text, regexp_full_match(text, '[a-z0-9][a-z0-9._-]{0,63}') AS namespace, regexp_full_match(text, '[a-z0-9][a-z0-9._-]{0,127}') AS name, "
        f"regexp_full_match(text, '[A-Za-z0-9][A-Za-z0-9._:-]{{0,127}}') AS operation FROM (SELECT unnest({spellings}) AS text FROM nation)",
        "fts_member_ids": f"WITH {_STEPS} SELECT id FROM t4",
        "vector_member_ids": "SELECT id FROM (SELECT vec_id AS id FROM embeddings UNION SELECT vec_id * 2 FROM embeddings) WHERE id NOT IN (SELECT vec_id * 3 FROM embeddings)",
        "streaming_members": "SELECT doc_id AS id, source AS provenance FROM documents",
        "snapshot_member_ids": "SELECT 'fts' AS family, doc_id AS id FROM documents UNION ALL SELECT 'vector', vec_id FROM embeddings",
        "error_categories": _values([(name, c) for c, names in _ERRORS.items() for name in names.split()], "error, category"),
        "refusals": _values([(name, error, category[error]) for name, error in _REFUSED], "name, error, category"),
    }
