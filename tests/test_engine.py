"""Search operators against closed forms, contracts and a plain Python model."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from findery import errors as E
from findery.functions.text import tokenize
from findery.operators.bm25 import Bm25Index
from findery.operators.fusion import as_rankings, rrf
from findery.operators.vectors import VectorIndex
from findery.schemas import FtsConfig, HnswConfig, StateKind, TokenizerConfig, Transition, VectorDistance, is_permitted_from


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def vecs(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>")


def ranked(df):
    return [(r["id"], r["score"]) for r in df.orderBy("rank").collect()]


# fixed golden values: texts and the tokens that they must give
@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("Hello, WORLD-42 x_y", ["hello", "world", "42", "x", "y"]),
        ("", []),
        (" .,-_' \t\n", []),
        ("ΟΔΟΣ.ALPHA", ["οδος", "alpha"]),
        ("STRAẞE Café", ["straße", "café"]),
        ("İSTANBUL x٣", ["i̇stanbul", "x٣"]),
        ("i̇stanbul", ["i", "stanbul"]),
    ],
)
def test_tokenizer(spark, text, tokens):
    assert docs(spark, [(1, text)]).select(tokenize(F.col("text"))).first()[0] == tokens


def test_bm25_closed_form(spark):
    index = Bm25Index.build(docs(spark, [(1, "a b"), (2, "b c c")]))
    (only,) = ranked(index.query("c", 5))
    assert only[0] == 2 and math.isclose(only[1], math.log(2) * 4.4 / 3.38, rel_tol=1e-6)
    found = dict(ranked(index.query("B b", 5)))
    assert math.isclose(found[1], math.log(1.2) * 2.2 / 2.02, rel_tol=1e-6)
    assert math.isclose(found[2], math.log(1.2) * 2.2 / 2.38, rel_tol=1e-6)


def test_bm25_ties_limits_and_edges(spark):
    index = Bm25Index.build(docs(spark, [(9, "alpha beta gamma"), (2, "alpha beta gamma"), (5, "alpha alpha alpha alpha"), (7, ""), (8, None)]))
    assert [i for i, _ in ranked(index.query("alpha", 2))] == [5, 2]
    assert ranked(index.query("alpha", 0)) == [] and ranked(index.query("", 3)) == [] and ranked(index.query("zzz", 3)) == []
    scores = dict(ranked(index.query("beta", 9)))
    assert scores[9] == scores[2]
    assert len(index) == 5 and not index.is_empty()
    empty = Bm25Index.build(docs(spark, []))
    assert ranked(empty.query("alpha", 3)) == [] and empty.is_empty()


def test_bm25_replace_remove_and_refusals(spark):
    index = Bm25Index.build(docs(spark, [(7, "obsolete signal"), (1, "signal")]))
    index = index.insert(docs(spark, [(7, "current signal")]))
    assert ranked(index.query("obsolete", 3)) == [] and [i for i, _ in ranked(index.query("current", 3))] == [7]
    assert len(index.remove(docs(spark, [(7, ""), (99, ""), (7, "")]))) == 1
    with pytest.raises(E.DuplicateMember):
        index.insert(docs(spark, [(1, "x"), (1, "y")]))
    with pytest.raises(E.NotYetImplemented):
        Bm25Index(index.docs, index.tf, FtsConfig(TokenizerConfig("NGram", ("3",)))).query("x", 1)


def test_bm25_against_a_model(spark):
    r = random.Random(3)
    vocabulary = ["alpha", "Beta", "café", "straße", "ΟΔΟΣ", "x1", "gamma", "delta"]
    corpus = {i: " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 12))) for i in range(40)}
    index = Bm25Index.build(docs(spark, list(corpus.items())))
    low = lambda t: [w.lower() for w in t.split()]
    n, average = len(corpus), sum(len(low(t)) for t in corpus.values()) / len(corpus)
    queries = spark.createDataFrame([(0, "alpha beta beta"), (1, "Café zzz οδος"), (2, "")], "query_id int, text string")
    found = index.query_batch(queries, 100).collect()
    for q in queries.collect():
        want = {}
        for term in sorted(set(low(q["text"]))):
            df = sum(term in low(t) for t in corpus.values())
            if not df:
                continue
            weight = math.log(1 + (n - df + 0.5) / (df + 0.5))
            for i, t in corpus.items():
                tf = low(t).count(term)
                if tf:
                    want[i] = want.get(i, 0) + weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(low(t)) / average))
        got = {x["id"]: x["score"] for x in found if x["query_id"] == q["query_id"]}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)
    assert unicodedata.normalize("NFC", "café") == "café"


def test_vector_distances_and_ties(spark):
    index = VectorIndex.build(vecs(spark, [(9, [1.0, 2.0]), (2, [1.0, 2.0]), (4, [0.0, 0.0])]), HnswConfig(2))
    assert ranked(index.query([1.0, 2.0], 3)) == [(2, 0.0), (9, 0.0), (4, 5.0)]
    zero = VectorIndex(index.vectors, HnswConfig(2, VectorDistance.COSINE))
    assert ranked(zero.query([0.0, 0.0], 3)) == [(4, 0.0), (2, 1.0), (9, 1.0)]
    inner = VectorIndex(index.vectors, HnswConfig(2, VectorDistance.INNER_PRODUCT))
    assert ranked(inner.query([1.0, 1.0], 2)) == [(2, -3.0), (9, -3.0)]
    collapsed = VectorIndex.build(vecs(spark, [(9, [100000.0, 0.0]), (2, [100000.0, 1.0])]), HnswConfig(2))
    assert [i for i, _ in ranked(collapsed.query([0.0, 0.0], 2))] == [2, 9]
    assert len(index.remove(index.vectors.filter("id = 9"))) == 2
    assert dict(ranked(index.insert(vecs(spark, [(9, [0.0, 0.0])])).query([0.0, 0.0], 2))) == {4: 0.0, 9: 0.0}


def test_vector_refusals_in_order(spark):
    with pytest.raises(E.InvalidHnswConfig):
        VectorIndex.build(vecs(spark, [(1, [1.0])]), HnswConfig(0))
    with pytest.raises(E.DimensionMismatch):
        VectorIndex.build(vecs(spark, [(1, [1.0]), (2, [float("nan"), 1.0])]), HnswConfig(2))
    with pytest.raises(E.InvalidVector):
        VectorIndex.build(vecs(spark, [(1, [float("inf"), 0.0]), (2, [1.0])]), HnswConfig(2))
    largest = 3.4028234663852886e38
    index = VectorIndex.build(vecs(spark, [(1, [largest, largest])]), HnswConfig(2))
    with pytest.raises(E.DistanceNotRepresentable):
        index.query([0.0, 0.0], 1)
    assert len(ranked(VectorIndex(index.vectors, HnswConfig(2, VectorDistance.COSINE)).query([1.0, 0.0], 1))) == 1
    with pytest.raises(E.DimensionMismatch):
        index.query([0.0], 0)


def test_batch_refuses_distances_beyond_32_bits(spark):
    largest = 3.4028234663852886e38
    rows = [(i, [float(i), 0.0]) for i in range(300)] + [(900, [largest, largest])]
    index = VectorIndex.build(vecs(spark, rows).repartition(3), HnswConfig(2))
    queries = vecs(spark, [(1, [0.0, 0.0]), (2, [5.0, 0.0])]).withColumnRenamed("id", "query_id")
    # 300 distances that fit come first: the pool never reaches the one that doesn't
    assert [x["id"] for x in index.query_batch(queries, 1).orderBy("query_id").collect()] == [0, 5]
    with pytest.raises(Exception, match="DistanceNotRepresentable"):
        index.query_batch(queries, 301).collect()
    few = VectorIndex.build(vecs(spark, rows[-3:]), HnswConfig(2))
    with pytest.raises(Exception, match="DistanceNotRepresentable"):
        few.query_batch(queries, 1).collect()
    assert few.query_batch(queries, 1, check=False).count() == 2
    inner = VectorIndex.build(vecs(spark, [*rows, (901, [largest, largest])]), HnswConfig(2, VectorDistance.INNER_PRODUCT))
    with pytest.raises(Exception, match="DistanceNotRepresentable"):
        inner.query_batch(vecs(spark, [(1, [largest, largest])]).withColumnRenamed("id", "query_id"), 1).collect()
    with pytest.raises(E.DimensionMismatch):
        index.query_batch(vecs(spark, [(1, [0.0])]).withColumnRenamed("id", "query_id"), 1)


@pytest.mark.parametrize("kind", list(VectorDistance))
def test_batch_and_single_agree(spark, kind):
    r = random.Random(5)
    rows = [(i, [r.random() for _ in range(8)]) for i in range(64)] + [(100, [0.0] * 8)]
    index = VectorIndex.build(vecs(spark, rows).repartition(3), HnswConfig(8, kind))
    queries = vecs(spark, rows[:3]).withColumnRenamed("id", "query_id")
    batch = index.query_batch(queries, 5).collect()
    for q, v in rows[:3]:
        single = [i for i, _ in ranked(index.query(v, 5))]
        assert single == [x["id"] for x in sorted((x for x in batch if x["query_id"] == q), key=lambda x: x["rank"])]


def rankings(spark, *lists):
    return as_rankings(*[spark.createDataFrame([(p + 1, x) for p, x in enumerate(ids)], "rank int, id string") for ids in lists])


def test_rrf(spark):
    fused = ranked(rrf(rankings(spark, ["alpha", "beta", "gamma"], ["beta", "delta", "alpha"])))
    assert [i for i, _ in fused] == ["beta", "alpha", "delta", "gamma"]
    assert [i for i, _ in ranked(rrf(rankings(spark, "123", "425")))] == ["2", "1", "4", "3", "5"]
    twice = dict(ranked(rrf(rankings(spark, ["alpha", "beta", "alpha"]))))
    assert math.isclose(twice["alpha"], 1 / 61, rel_tol=1e-6) and math.isclose(twice["beta"], 1 / 62, rel_tol=1e-6)
    for bad in (0, -1, float("nan"), float("inf"), -float("inf")):
        with pytest.raises(E.InvalidKConstant):
            rrf(rankings(spark, "1"), bad)


def test_permissions_and_categories():
    assert sum(is_permitted_from(t, s) for t in Transition for s in StateKind) == 10
    assert len(E.VARIANTS) == 25 and {v.category for v in E.VARIANTS} == set(E.ErrorCategory)


def test_approximate_path_recalls(spark):
    from findery.operators.ann import CellIndex, recall

    r = random.Random(6)
    centers = [[r.uniform(-5, 5) for _ in range(16)] for _ in range(12)]
    rows = [(i, [c + r.gauss(0, 0.5) for c in centers[i % 12]]) for i in range(256)]
    config = HnswConfig(16)
    exact = VectorIndex.build(vecs(spark, rows), config)
    queries = vecs(spark, rows[:8]).withColumnRenamed("id", "query_id")
    index = CellIndex.build(exact.vectors, config, cells=12)
    found = recall(index.query_batch(queries, 10, probes=4), exact.query_batch(queries, 10)).collect()
    assert sum(x["recall"] for x in found) / len(found) >= 0.9
    assert CellIndex.build(exact.vectors.limit(0), config).query_batch(queries, 3).count() == 0


def test_approximate_path_recalls_at_its_defaults_without_structure(spark):
    from findery.operators.ann import CellIndex, recall

    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(64)]) for i in range(500)]
    config = HnswConfig(64)
    exact = VectorIndex.build(vecs(spark, rows), config)
    queries = vecs(spark, rows[:60]).withColumnRenamed("id", "query_id")
    found = recall(CellIndex.build(exact.vectors, config).query_batch(queries, 10), exact.query_batch(queries, 10)).collect()
    assert len(found) == 60 and sum(x["recall"] for x in found) / len(found) >= 0.9
