"""Seeded inserts, replacements and removals against a plain model, and models that differ in one rule, which must be told apart."""

import math
import random
import re

import pytest

from findery.operators.bm25 import Bm25Index

WORDS = ["alpha", "Alpha", "beta", "gamma", "GAMMA", "café", "straße", "STRAẞE", "ΟΔΟΣ", "x٣", "delta", "42", "epsilon", "zeta"]
ABSENT = ["zzz", "Absent", "q9"]
SEPARATORS = [" ", ", ", "-", "_", ".", "\t", "\n", "; ", " / ", "'", "  ", "!"]


def tokens(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


class Model:
    """BM25 over a dict of texts; each option breaks one rule."""

    def __init__(self, k1=1.2, b=0.75, classic=False, repeats=False, distinct=False, no_empty=False, cased=False, keep_first=False, keep_removed=False):
        self.k1, self.b, self.classic, self.repeats, self.distinct = k1, b, classic, repeats, distinct
        self.no_empty, self.cased, self.keep_first, self.keep_removed = no_empty, cased, keep_first, keep_removed
        self.texts = {}

    def insert(self, i, text):
        if not (self.keep_first and i in self.texts):
            self.texts[i] = text

    def remove(self, i):
        if not self.keep_removed:
            self.texts.pop(i, None)

    def split(self, text):
        return re.findall(r"[^\W_]+", text) if self.cased else tokens(text)

    def scores(self, query):
        docs = {i: self.split(t) for i, t in self.texts.items()}
        if self.no_empty:
            docs = {i: t for i, t in docs.items() if t}
        if not docs:
            return {}
        length = {i: len(set(t)) if self.distinct else len(t) for i, t in docs.items()}
        average, out = sum(length.values()) / len(docs), {}
        asked = self.split(query)
        for term in sorted(asked if self.repeats else set(asked)):
            df = sum(term in t for t in docs.values())
            weight = math.log(max(1e-9, (len(docs) - df + 0.5) / (df + 0.5))) if self.classic else math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            for i, t in docs.items():
                if tf := t.count(term):
                    out[i] = out.get(i, 0) + weight * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length[i] / average))
        return out


def workload(seed, operations, ids):
    r = random.Random(seed)

    def text(most, words):
        return "".join(r.choice(words) + r.choice(SEPARATORS) for _ in range(r.randint(0, most)))

    steps = []
    for _ in range(operations):
        i = r.randrange(ids)
        i = (1 << 62) - i if i % 5 == 0 else i
        steps.append(("remove", i, None) if r.random() < 0.25 else ("insert", i, text(12, WORDS)))
    return steps, [text(5, WORDS + ABSENT) for _ in range(6)] + ["alpha Alpha café", "ΟΔΟΣ οδος straße", ""]


def batches(steps):
    """Runs of one kind without a repeated id."""
    run, kind = {}, None
    for op, i, text in steps:
        if run and (op != kind or i in run):
            yield kind, run
            run = {}
        kind = op
        run[i] = text
    if run:
        yield kind, run


@pytest.mark.parametrize(("seed", "operations", "ids", "checks"), [(0xB25F0001, 60, 6, 3), (0xB25F0002, 50, 40, 2)])
def test_workload(spark, seed, operations, ids, checks):
    steps, probes = workload(seed, operations, ids)
    wrong = {
        "k1 1.25": Model(k1=1.25), "k1 1.2001": Model(k1=1.2001), "b 0.7": Model(b=0.7), "idf": Model(classic=True),
        "repeats": Model(repeats=True), "distinct": Model(distinct=True), "empty": Model(no_empty=True), "case": Model(cased=True),
        "first": Model(keep_first=True), "removed": Model(keep_removed=True),
    }
    right, told, changes = Model(), set(), 0
    queries = spark.createDataFrame(list(enumerate(probes)), "query_id int, text string")
    share = -(-operations // checks)
    index = Bm25Index.build(spark.createDataFrame([], "id long, text string"))
    for begin in range(0, operations, share):
        for kind, run in batches(steps[begin : begin + share]):
            frame = spark.createDataFrame(list(run.items()), "id long, text string").coalesce(1)
            index = index.insert(frame) if kind == "insert" else index.remove(frame)
            # written out now and then, as an index on disk is, so that plans stay short
            changes += 1
            if changes % 4 == 0:
                index = Bm25Index(
                    spark.createDataFrame(index.docs.collect(), index.docs.schema).coalesce(1),
                    spark.createDataFrame(index.tf.collect(), index.tf.schema).coalesce(1),
                )
            for model in (right, *wrong.values()):
                for i, text in run.items():
                    model.insert(i, text) if kind == "insert" else model.remove(i)
        found = {}
        for r in index.query_batch(queries, 1000).collect():
            found.setdefault(r["query_id"], {})[r["id"]] = r["score"]
        for q, probe in enumerate(probes):
            want, got = right.scores(probe), found.get(q, {})
            matched = len(set(tokens(probe)))
            near = lambda a, b, m=matched: abs(a - b) <= 32 * 2**-24 * (abs(b) + m)
            assert got.keys() == want.keys() and all(near(got[i], want[i]) for i in want)
            for name, model in wrong.items():
                other = model.scores(probe)
                if got.keys() != other.keys() or not all(near(got[i], other[i]) for i in other):
                    told.add(name)
    assert told == wrong.keys()
