"""Posting lists: counts as the plain index has them, faults that the facts must show, and versions that share parts."""

import pytest
from pyspark.sql import functions as F

from findery import errors as E
from findery.operators import postings
from findery.operators.bm25 import Bm25Index
from findery.plans import lifecycle as L
from findery.plans.lifecycle import Create, IndexIdentity, Insert, Lifecycle, Operation, Remove
from findery.schemas import FtsConfig
from findery.sources.log import LifecycleStore, MemoryLog

NOTES = IndexIdentity("example", "notes")
TEXTS = [(3, "b", "Alpha beta alpha"), (1, "a", "beta ÉTÉ Σίσυφος"), (2, "a", ""), (5, "c", None), (4, "c", "x x x y")]


def members(spark, rows):
    return spark.createDataFrame(rows, "id long, provenance string, text string").repartition(2)


def postings_of(tf):
    return sorted(tuple(r) for r in tf.select("id", "term", "tf", "length").collect())


def test_lists_hold_what_the_plain_index_holds(spark, monkeypatch):
    docs = members(spark, TEXTS)
    want = postings_of(Bm25Index.build(docs).tf)
    assert postings_of(postings.rows(postings.counted(docs))) == want and len(want) == 7
    monkeypatch.setattr(postings, "RUN", 2)
    assert postings_of(postings.rows(postings.counted(docs))) == want


def test_facts_show_faults(spark, tmp_path):
    schema = "id long, term string, tf long, length long"
    good = [(1, "a", 2, 3), (1, "b", 1, 3), (2, "a", 1, 1)]
    for number, (odd, extra) in enumerate(((0, []), (1, [(1, "a", 1, 3)]), (1, [(1, "c", 0, 3)]), (1, [(1, "", 1, 3)]), (1, [(1, None, 1, 3)]))):
        for files in (1, 3):
            tf = spark.createDataFrame(good + extra, schema).repartition(files)
            path = f"file://{tmp_path}/{number}-{files}"
            postings.write_facts(tf, path)
            found = {r.id: r for r in postings.facts(tf, path).collect()}
            assert (found[1].odd > 0) == bool(odd) and found[2].odd == 0 and found[2].total == found[2].low == found[2].high == 1


@pytest.mark.parametrize("most", [1, 16])
def test_versions_share_the_parts_of_earlier_ones(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(L, "MOST_PARTS", most)
    root = f"file://{tmp_path}"
    lifecycle = Lifecycle(spark, root, LifecycleStore(MemoryLog()))
    written = []
    plain = postings.counted
    monkeypatch.setattr(postings, "counted", lambda docs: written.append(1) or plain(docs))
    lifecycle.apply(Operation(NOTES, "a", Create(FtsConfig.simple())))
    lifecycle.apply(Operation(NOTES, "b", Insert(members(spark, TEXTS))))
    lifecycle.apply(Operation(NOTES, "c", Insert(members(spark, [(1, "z", "gamma"), (7, "z", "alpha")]))))
    lifecycle.apply(Operation(NOTES, "d", Remove(members(spark, TEXTS[:1]).select("id"))))
    published = lifecycle.index(NOTES)
    left = [r for r in TEXTS if r[0] not in (1, 3)] + [(1, "z", "gamma"), (7, "z", "alpha")]
    assert len(written) == 2 and len(published.stored.parts) == min(most, 2)
    assert postings_of(published.engine.tf) == postings_of(Bm25Index.build(members(spark, left)).tf)
    assert {r.id: r.length for r in published.engine.docs.collect()} == {2: 0, 5: 0, 4: 4, 1: 1, 7: 1}
    assert [h.id for h in published.query_text("alpha beta gamma", 5).collect()] == [1, 7]
    folder = published.stored.parts[-1]["folder"]
    lists = spark.read.parquet(f"{root}/{folder}").collect()
    column = "tfs" if "tfs" in spark.read.parquet(f"{root}/{folder}").columns else "tf"
    change = F.transform("tfs", lambda x: x + 1) if column == "tfs" else F.col("tf") + 1
    kept = spark.createDataFrame(lists, spark.read.parquet(f"{root}/{folder}").schema)
    kept.withColumn(column, change).write.mode("overwrite").parquet(f"{root}/{folder}")
    with pytest.raises(E.CorruptSnapshot):
        lifecycle.index(NOTES)
