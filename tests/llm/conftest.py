import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, content string, copies int, rest string, size int, key string"


def words(r, n, alphabet="abcdefghijklmnopqrstuvwxyz"):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 8))) for _ in range(n))


def texts():
    """Plain texts, copies, near copies, shared passages, junk, long and empty ones, and a null."""
    r = random.Random(11)
    passage = words(r, 60)
    base = [words(r, r.randint(30, 200)) + "." for _ in range(25)]
    near = []
    for t in base[:8]:
        w = t.split()
        for _ in range(2):
            w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    shared = [words(r, 25) + ". " + passage + " " + words(r, 20) + "." for _ in range(5)]
    odd = [None, "", " \n\t ", "a", "é", "ab ab ab ab ab " * 60, words(r, 8000), "x" * 3000, "Σ 漢字 🎉 " * 40, "a | b | c |\nd > e > f >", "<|endoftext|> and <|startoftext|>"]
    return base + base[:5] + near + shared + odd + [base[9]] * 6


def rows():
    out = []
    for i, t in enumerate(texts()):
        out.append((i, t, "en", None if i % 11 == 0 else f"s{i % 4}", len(t or ""), "clash", i, None, 5, "k"))
    return out


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nulls(spark):
    """Null ids, repeated ids and repeated rows."""
    r = random.Random(5)
    t = words(r, 80)
    made = [(None, t), (None, t), (1, t), (1, t), (2, words(r, 40)), (None, None), (3, ""), (3, words(r, 50))]
    return spark.createDataFrame([(i, x, None, None, None, None, None, None, None, None) for i, x in made], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
