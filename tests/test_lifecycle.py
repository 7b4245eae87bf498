"""Lifecycle: operations, replay, conflicts, staged state, faults, both logs; snapshots and streaming."""

import hashlib
import json
import struct
import threading

import pytest

from findery import errors as E
from findery.operators.bm25 import Bm25Index
from findery.operators.vectors import VectorIndex
from findery.plans import digest as D
from findery.plans import identity
from findery.plans.lifecycle import (
    Create,
    Destroy,
    IndexIdentity,
    Insert,
    Lifecycle,
    Operation,
    Prepared,
    Rebuild,
    Remove,
    Widths,
    check_payload,
)
from findery.schemas import FtsConfig, HnswConfig, StateKind, TokenizerConfig
from findery.sources import keys
from findery.sources.files import Files
from findery.sources.log import FileLog, LifecycleStore, MemoryLog, WriterLock
from findery.sources.snapshot import SnapshotStore

NOTES = IndexIdentity("example", "notes")


@pytest.fixture(params=["memory", "file"])
def lifecycle(spark, tmp_path, request):
    root = f"file://{tmp_path}"
    log = MemoryLog() if request.param == "memory" else FileLog(Files(spark, root))
    return Lifecycle(spark, root, LifecycleStore(log))


def vectors(spark, ids, dims=2):
    rows = [(i, f"p{i}", [float(i)] * dims) for i in ids]
    return spark.createDataFrame(rows, "id long, provenance string, vector array<float>").coalesce(1)


def ids(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "id long").coalesce(1)


def table(published):
    return sorted((r["id"], r["introduced"], r["supersedes"]) for r in published.members.collect())


def test_canonical_script(spark, lifecycle):
    apply = lambda key, change: lifecycle.apply(Operation(NOTES, key, change))
    assert apply("a", Create(HnswConfig(2))).version == 1
    assert lifecycle.index(NOTES).is_empty()
    assert apply("b", Insert(vectors(spark, [3, 1, 2]))).version == 2
    receipt = apply("c", Remove(ids(spark, 2)))
    assert receipt.version == 3
    assert [(r["id"], r["change"]) for r in lifecycle.changes_of(receipt.record).collect()] == [(2, "removed")]
    assert table(lifecycle.index(NOTES)) == [(1, 2, None), (3, 2, None)]
    receipt = apply("d", Rebuild(HnswConfig(3), vectors(spark, [1, 4], 3)))
    found = {r["id"]: r["change"] for r in lifecycle.changes_of(receipt.record).collect()}
    assert receipt.version == 4 and found == {1: "replaced", 4: "inserted", 3: "dropped"}
    assert receipt.record["previous_config"]["dimensions"] == 2
    published = lifecycle.index(NOTES)
    check_payload(published)
    assert table(published) == [(1, 4, 2), (4, 4, None)]
    hits = published.query_vector([1.0, 1.0, 1.0], 5).collect()
    assert [(h["id"], h["provenance"], h["version"]) for h in hits] == [(1, "p1", 4), (4, "p4", 4)]
    with pytest.raises(E.FamilyMismatch):
        published.query_text("x", 1)
    assert apply("e", Remove(ids(spark, 9))).version == 5
    destroyed = apply("f", Destroy({"days": 30}))
    assert destroyed.version == 5 and {r["change"] for r in lifecycle.changes_of(destroyed.record).collect()} == {"retired"}
    with pytest.raises(E.IndexNotFound):
        lifecycle.index(NOTES)
    assert lifecycle.record(NOTES)["retention"] == {"days": 30}
    assert apply("a", Create(HnswConfig(2))).replayed
    with pytest.raises(E.TransitionNotPermitted):
        apply("g", Create(HnswConfig(2)))
    with pytest.raises(E.OperationConflict):
        apply("a", Create(HnswConfig(9)))


def test_text_index(spark, lifecycle):
    docs = spark.createDataFrame([(1, "x", "alpha beta"), (2, "y", ""), (3, "z", None)], "id long, provenance string, text string")
    lifecycle.apply(Operation(NOTES, "a", Create(FtsConfig.simple())))
    lifecycle.apply(Operation(NOTES, "b", Insert(docs)))
    published = lifecycle.index(NOTES)
    check_payload(published)
    assert [(h["id"], h["provenance"]) for h in published.query_text("ALPHA", 3).collect()] == [(1, "x")]
    assert published.member(2)["provenance"] == "y" and len(published) == 3


def test_refusals_come_in_order(spark, lifecycle):
    op = lambda change: Operation(NOTES, "k", change)
    with pytest.raises(E.EmptyBatch):
        lifecycle.apply(op(Insert(vectors(spark, [1]).limit(0))))
    twice = vectors(spark, [1]).unionByName(vectors(spark, [1]))
    with pytest.raises(E.DuplicateMember):
        lifecycle.apply(op(Insert(twice)))
    with pytest.raises(E.InvalidIdentifier):
        lifecycle.apply(op(Insert(spark.createDataFrame([(1.5, "p", [1.0])], "id double, provenance string, vector array<float>"))))
    with pytest.raises(E.InvalidVector):
        lifecycle.apply(op(Insert(spark.createDataFrame([(1, "p", [float("nan")])], "id long, provenance string, vector array<float>"))))
    with pytest.raises(E.InvalidHnswConfig):
        lifecycle.apply(op(Create(HnswConfig(0))))
    with pytest.raises(E.NotYetImplemented):
        lifecycle.apply(op(Create(FtsConfig(TokenizerConfig("Simple", ("x",))))))
    with pytest.raises(E.DimensionMismatch):
        lifecycle.apply(op(Rebuild(HnswConfig(5), vectors(spark, [1]))))
    with pytest.raises(E.UnencodableOperation):
        lifecycle.apply(op(Destroy(0.5)))
    deep = 1
    for _ in range(65):
        deep = [deep]
    with pytest.raises(E.UnencodableOperation):
        lifecycle.apply(op(Destroy(deep)))
    with pytest.raises(E.TransitionNotPermitted):
        lifecycle.apply(op(Insert(vectors(spark, [1]))))
    assert lifecycle.record(NOTES) is None and lifecycle.store.list_staged() == []


def test_staged_state_blocks_its_index_until_recovery(spark, lifecycle):
    lifecycle.apply(Operation(NOTES, "a", Create(HnswConfig(2))))
    prepared = lifecycle.prepare(Operation(NOTES, "b", Insert(vectors(spark, [1]))))
    assert isinstance(prepared, Prepared) and prepared.index == NOTES and prepared.resulting == (2, StateKind.ACTIVE)
    prepared.stage()
    with pytest.raises(E.WriterHeld):
        lifecycle.prepare(Operation(NOTES, "c", Insert(vectors(spark, [2]))))
    prepared.close()
    assert lifecycle.index(NOTES).is_empty()
    with pytest.raises(E.StagedStateExists):
        lifecycle.apply(Operation(NOTES, "c", Insert(vectors(spark, [2]))))
    other = IndexIdentity("example", "notes.v2")
    assert lifecycle.apply(Operation(other, "a", Create(HnswConfig(2)))).version == 1
    assert lifecycle.recover() == [keys.version("example", "notes", 2)]
    assert lifecycle.store.list_quarantined()[0].sequence == 1
    assert lifecycle.apply(Operation(NOTES, "c", Insert(vectors(spark, [2])))).version == 2


def test_another_writer_changes_the_head(spark, tmp_path):
    root, log = f"file://{tmp_path}", MemoryLog()
    one = Lifecycle(spark, root, LifecycleStore(log))
    two = Lifecycle(spark, root, LifecycleStore(log))  # another writer lock, as another process has
    one.apply(Operation(NOTES, "a", Create(HnswConfig(2))))
    prepared = one.prepare(Operation(NOTES, "b", Insert(vectors(spark, [1]))))
    two.apply(Operation(NOTES, "c", Insert(vectors(spark, [2]))))
    with pytest.raises(E.HeadChanged):
        prepared.stage()
    prepared.close()
    assert one.apply(Operation(NOTES, "b", Insert(vectors(spark, [1])))).version == 3


class Faulty(MemoryLog):
    """Fails once, before or after an entry took effect."""

    def __init__(self):
        super().__init__()
        self.mode, self.at = None, 0

    def append(self, number, data):
        if self.mode and json.loads(data)["type"] == "publish":
            mode, self.mode = self.mode, None
            if mode == "after":
                super().append(number, data)
            raise E.Persistence("fault")
        return super().append(number, data)


@pytest.mark.parametrize("mode", ["before", "after"])
def test_a_lost_acknowledgement(spark, tmp_path, mode):
    log = Faulty()
    lifecycle = Lifecycle(spark, f"file://{tmp_path}", LifecycleStore(log))
    create = Operation(NOTES, "a", Create(HnswConfig(2)))
    log.mode = mode
    with pytest.raises(E.Persistence):
        lifecycle.apply(create)
    if mode == "after":
        assert lifecycle.apply(create).replayed
    else:
        with pytest.raises(E.StagedStateExists):
            lifecycle.apply(create)
        lifecycle.recover()
        assert not lifecycle.apply(create).replayed


def test_corruption_is_told_apart(spark, tmp_path):
    lifecycle = Lifecycle(spark, f"file://{tmp_path}", LifecycleStore(MemoryLog()))
    lifecycle.apply(Operation(NOTES, "a", Create(HnswConfig(2))))
    lifecycle.apply(Operation(NOTES, "b", Insert(vectors(spark, [1, 2]))))
    folder = lifecycle.store.read_version(keys.version("example", "notes", 2))
    for part in (tmp_path / folder / "vectors").glob("*.parquet"):
        part.unlink()
    with pytest.raises(E.CorruptSnapshot):
        lifecycle.index(NOTES)


def test_a_version_is_checked_when_it_is_read(spark, tmp_path):
    root = f"file://{tmp_path}"
    lifecycle = Lifecycle(spark, root, LifecycleStore(MemoryLog()))
    lifecycle.apply(Operation(NOTES, "a", Create(HnswConfig(2))))
    lifecycle.apply(Operation(NOTES, "b", Insert(vectors(spark, [1, 2]))))
    folder = lifecycle.store.read_version(keys.version("example", "notes", 2))
    other = spark.createDataFrame([(1, "p1", 2, None), (3, "p3", 2, None)], lifecycle.index(NOTES).members.schema)
    other.write.mode("overwrite").parquet(f"{root}/{folder}/members")
    with pytest.raises(E.CorruptSnapshot):
        lifecycle.index(NOTES)
    with pytest.raises(E.CorruptSnapshot):
        lifecycle.apply(Operation(NOTES, "c", Insert(vectors(spark, [9]))))
    unchecked = Lifecycle(spark, root, lifecycle.store, check_on_read=False)
    assert len(unchecked.index(NOTES)) == 2


def test_values_over_the_limit_are_refused_before_a_write(spark, tmp_path):
    store = LifecycleStore(MemoryLog(), value_limit=100)
    lifecycle = Lifecycle(spark, f"file://{tmp_path}", store)
    with pytest.raises(E.Persistence):
        lifecycle.apply(Operation(NOTES, "a" * 120, Create(HnswConfig(2))))
    assert store.fold().count == 0 and not (tmp_path / "data").exists()
    store.value_limit = 4000
    assert lifecycle.apply(Operation(NOTES, "a" * 120, Create(HnswConfig(2)))).version == 1


def test_large_digests_depend_on_the_content_alone(spark, monkeypatch):
    from findery.plans import lifecycle as L

    monkeypatch.setattr(L, "STREAMED", 2)
    digest = lambda ids, dims=2, key="k": L.Checked(Operation(NOTES, key, Insert(vectors(spark, ids, dims))), Widths()).digest
    one = digest([3, 1, 2, 4])
    rows = vectors(spark, [4, 2, 3, 1]).repartition(3)
    assert one == L.Checked(Operation(NOTES, "other", Insert(rows)), Widths()).digest
    assert len({one, digest([3, 1, 2, 5]), digest([3, 1, 2]), digest([3, 1, 2, 4], 3)}) == 4


def test_digest_items(spark, lifecycle):
    s = lambda t: b"\x40" + struct.pack(">Q", len(t)) + t.encode()
    m = lambda n: b"\x51" + struct.pack(">Q", n)
    q = lambda n: b"\x50" + struct.pack(">Q", n)
    u32, u64 = (lambda x: b"\x12" + struct.pack(">I", x)), (lambda x: b"\x13" + struct.pack(">Q", x))
    member = lambda i, p, bits: (
        m(3) + s("id") + u64(i) + s("content") + b"\x60" + s("vector_bits") + q(len(bits)) + b"".join(map(u32, bits)) + s("provenance") + s(p)
    )
    whole = (
        m(3) + s("index") + m(2) + s("name") + s("notes") + s("namespace") + s("example") + s("change") + m(1) + s("members")
        + q(2) + member(1, "p", [0x3F000000, 0x40000000]) + member(2, "q", [0x3F800000, 0x80000000]) + s("transition") + s("Insert")
    )
    rows = [(2, "q", [1.0, -0.0]), (1, "p", [0.5, 2.0])]
    df = spark.createDataFrame(rows, "id long, provenance string, vector array<float>")
    from findery.plans.lifecycle import Checked

    checked = Checked(Operation(NOTES, "k", Insert(df)), Widths(domain=b"d\n"))
    assert checked.digest == hashlib.sha256(b"d\n" + whole).hexdigest()
    with pytest.raises(E.UnencodableOperation):
        D.item(1.5)
    with pytest.raises(E.UnencodableOperation):
        D.item(D.Int(256, 8))
    with pytest.raises(E.UnencodableOperation):
        D.item({1.5: "x"})
    assert D.item(None) == b"\x01" and D.item(D.Some(True)) == b"\x02\x04" and D.item(-1) == b"\x1b" + b"\xff" * 8
    assert D.item(D.Unit) == b"\x00" and D.item(b"a") == b"\x41" + struct.pack(">Q", 1) + b"a"


def test_names_keys_and_versions():
    for bad in ("", "A", "-a", "a" * 65, "ä", "a/b"):
        with pytest.raises(E.InvalidIdentifier):
            identity.check_namespace(bad)
    assert identity.check_key("import-7:X") == "import-7:X"
    with pytest.raises(E.InvalidIdentifier):
        identity.check_digest("A" * 64)
    with pytest.raises(E.InvalidIdentifier):
        identity.next_version(identity.MOST_VERSION)
    assert keys.version("example", "notes", 12) == "example/notes/00000000000000000012"
    assert keys.parse_version("example/notes/00000000000000000012") == ("example", "notes", 12)
    assert keys.parse_operation("example/notes/import-7") == ("example", "notes", "import-7")
    assert keys.parse_quarantine(keys.quarantine(1, "a", "b", 2, "marker")) == (1, "a", "b", 2, "marker")
    for bad in ("example/notes/12", "example/notes", "example/notes/" + "9" * 20, "example/notes/" + "0" * 20):
        with pytest.raises(E.CorruptSnapshot):
            keys.parse_version(bad)


def test_writer_lock_waits_and_refuses():
    lock = WriterLock()
    guard = lock.acquire()
    with pytest.raises(E.WriterHeld):
        lock.acquire()
    got = []
    thread = threading.Thread(target=lambda: got.append(lock.acquire()))
    thread.start()
    guard.close()
    thread.join(10)
    assert len(got) == 1


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    with pytest.raises(E.IndexNotFound):
        store.load_fts_index("x")
    docs = spark.createDataFrame([(1, "alpha"), (2, "")], "id long, text string")
    store.save_fts_index("x", Bm25Index.build(docs))
    store.save_fts_index("x", Bm25Index.build(docs.filter("id = 1")))
    assert len(store.load_fts_index("x")) == 1
    with pytest.raises(E.IndexNotFound):
        store.load_vector_index("x")
    store.save_vector_index("v", VectorIndex.build(vectors(spark, [1, 2]).drop("provenance"), HnswConfig(2)))
    assert len(store.load_vector_index("v")) == 2
    pointer = sorted((tmp_path / "fts" / "x").glob("*.json"))[-1]
    manifest = json.loads(pointer.read_text())
    for change, error in (
        ({"format_version": 9}, E.UnsupportedSnapshotVersion),
        ({"family": "vector"}, E.SnapshotFormat),
        ({"extra": 1}, E.CorruptSnapshot),
    ):
        (tmp_path / "fts" / "x" / f"{99:020d}.json").write_text(json.dumps(manifest | change))
        (tmp_path / "fts" / "x" / f".{99:020d}.json.crc").unlink(missing_ok=True)
        with pytest.raises(error):
            store.load_fts_index("x")


def test_streaming_ingest(spark, tmp_path):
    from findery.streaming.ingest import ingest

    lifecycle = Lifecycle(spark, f"file://{tmp_path}/store", LifecycleStore(MemoryLog()))
    lifecycle.apply(Operation(NOTES, "a", Create(HnswConfig(2))))
    vectors(spark, [1, 2]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(vectors(spark, [1]).schema).parquet(f"{tmp_path}/in")
    ingest(stream, lifecycle, NOTES, f"{tmp_path}/check").awaitTermination(120)
    assert len(lifecycle.index(NOTES)) == 2
