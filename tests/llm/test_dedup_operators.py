"""Near copies of texts and vectors, repeated strings, pages, conversations and the pipeline against brute force."""

import hashlib
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from findery.llm import chat_format, cover_tree, dom, embedding_dedup, graph, html_extract, mixing, near_dedup, quality, suffix_dedup
from findery.llm.alignment import banded_distance
from findery.llm.html_pages import labelled_pages
from findery.llm.vocab import default_path
from tests.llm.conftest import rows


def codes_of(text):
    return near_dedup.word_codes([w.encode() for w in near_dedup.words_of(text)])


def join_up(ids, links):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_alignment_against_the_full_table():
    r = random.Random(2)
    for _ in range(400):
        a = [r.randint(0, 6) for _ in range(r.randint(0, 25))]
        b = [x for x in a if r.random() > 0.2] + [r.randint(0, 6) for _ in range(r.randint(0, 4))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        most = r.randint(0, 10)
        assert banded_distance(a, b, most) == (row[-1] if row[-1] <= most else None)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 120)]
    df = spark.createDataFrame(links, "u long, v long")
    nodes = {x for e in links for x in e}
    want = {i: root for i, root in join_up(nodes, links).items() if i != root}
    assert {x.node: x.root for x in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


def test_components_end_with_stars(spark, monkeypatch):
    rounds, large = [], graph._large_star
    monkeypatch.setattr(graph, "_large_star", lambda edges: rounds.append(1) or large(edges))
    stars = [(i, i % 7) for i in range(7, 60)]
    found = graph.components(spark.createDataFrame(stars, "u long, v long")).collect()
    assert {x.node: x.root for x in found} == dict(stars) and not rounds
    found = graph.components(spark.createDataFrame([*stars, (6, 0)], "u long, v long")).collect()
    assert {x.node: x.root for x in found} == {6: 0} | {i: i % 7 % 6 for i, _ in stars} and rounds


def test_near_groups(documents, empty, nulls):
    codes = {row[0]: codes_of(row[1]) for row in rows()}
    ids = [i for i, c in codes.items() if len(c)]
    links = [(a, b) for a in ids for b in ids if a < b and near_dedup.alike(codes[a], codes[b])]
    want = join_up(codes, links)
    found = near_dedup.near_groups(documents).collect()
    assert {r.doc_id: r.class_id for r in found} == want and all(r.kept == (r.doc_id == r.class_id) for r in found)
    kept = near_dedup.one_of_each(documents)
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert near_dedup.near_groups(empty).count() == 0 and near_dedup.one_of_each(empty).count() == 0
    found = sorted((r.doc_id is None, r.doc_id or 0, r.class_id is None, r.class_id or 0, r.kept) for r in near_dedup.near_groups(nulls).collect())
    assert found == [
        (False, 1, False, 1, True), (False, 1, False, 1, True), (False, 2, False, 2, True), (False, 3, False, 3, True),
        (False, 3, False, 3, True), (True, 0, False, 1, False), (True, 0, False, 1, False), (True, 0, True, 0, True),
    ]
    left = [(r.doc_id, r.text) for r in near_dedup.one_of_each(nulls).collect()]
    assert len(left) == len(set(left)) == 5 and {i for i, _ in left} == {1, 2, 3, None}


@pytest.mark.parametrize("ids", [[1, None, 5], [5, 5, 5], [None, None, None], ["b", "a", None]])
def test_one_of_each_keeps_one_row_of_a_class(spark, ids):
    r = random.Random(13)
    t = " ".join(f"w{r.randint(0, 999)}" for _ in range(60))
    kind = "string" if "a" in ids else "long"
    made = [(i, x, "n", "o") for i, x in zip(ids, [t, t.upper(), t + " more"], strict=True)]
    kept = near_dedup.one_of_each(spark.createDataFrame(made, f"doc_id {kind}, text string, digest string, blank string"))
    assert kept.columns == ["doc_id", "text", "digest", "blank"]
    assert [x.doc_id for x in kept.collect()] == [{1: 1, 5: 5, None: None, "b": "a"}[ids[0]]]


@pytest.mark.parametrize("words", [10, 20, 50, 80, 100, 101, 150, 300])
def test_share_of_near_copies_that_meet(words):
    r = random.Random(words)
    for similarity, least in ((0.8, 0.9), (0.85, 0.97), (0.9, 0.98), (0.95, 0.99)):
        edits = int(words * (1 - similarity) + 1e-9)
        if not edits:
            continue
        for even in (False, True):
            met = 0
            for _ in range(200):
                a = np.array([r.randrange(1 << 32) for _ in range(words)], dtype=np.uint32)
                b = a.copy()
                places = [int((i + 0.5) * words / edits) for i in range(edits)] if even else r.sample(range(words), edits)
                b[places] = [r.randrange(1 << 32) for _ in places]
                met += bool(set(near_dedup.buckets(a).tolist()) & set(near_dedup.buckets(b).tolist()))
            assert met >= 200 * least


def test_links_between_members_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    r = random.Random(8)
    base = [f"w{r.randint(0, 500)}" for _ in range(120)]
    made = []
    for i in range(24):
        w = list(base)
        for _ in range(4):
            w[r.randrange(len(w))] = f"n{i}{r.randint(0, 99)}"
        made.append((i, " ".join(w)))
    codes = {i: codes_of(t) for i, t in made}
    links = [(a, b) for a in codes for b in codes if a < b and near_dedup.alike(codes[a], codes[b], 0.94)]
    assert 5 < len(links) < 200
    found = near_dedup.near_groups(spark.createDataFrame(made, "doc_id long, text string"), 0.94).collect()
    assert {x.doc_id: x.class_id for x in found} == join_up(codes, links)


def test_filters_lose_no_link():
    r = random.Random(31)
    base = [[r.randrange(300) for _ in range(r.randint(30, 60))] for _ in range(4)]
    words = []
    for i in range(60):
        w = list(base[i % 4])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.randrange(300)
        words.append(np.array(w + ([7] * 300 if i in (5, 9) else []), dtype=np.int64))
    made = pd.DataFrame({"size": [len(w) for w in words], "node": range(60), "root": [i % 7 for i in range(60)], "slot": [i // 4 % 2 for i in range(60)]})
    made["bins"] = [x.astype(np.uint8).tobytes() if x.max() < 256 else None for x in (np.bincount(w % 256, minlength=256) for w in words)]
    for cross in (False, True):
        frame = made.assign(bucket=1, low=0, high=int(cross), cross=cross)
        stay = set(near_dedup._may_link(0.8)(frame)["node"])
        need = {
            x
            for i in range(60)
            for j in range(i)
            if made["root"][i] != made["root"][j] and (not cross or made["slot"][i] != made["slot"][j]) and near_dedup.alike(words[i], words[j])
            for x in (i, j)
        }
        assert need and need <= stay


def test_pairs_that_share_buckets_are_compared_once(monkeypatch):
    r = random.Random(17)
    base, places = [f"w{i}" for i in range(40)], [2, 7, 31, 40, 41, 79]
    texts = [r.sample(base, 40) for _ in range(14)]  # the same words in other orders: only alignment tells them apart
    texts[9] = [*texts[4][:-1], "changed"]
    held = {i: [(5 << 7) + p for p in places if i < 5 or i == 9 or r.random() < 0.7] for i in range(14)}
    made = pd.DataFrame({"node": range(14), "root": [i // 2 for i in range(14)], "slot": [i % 2 for i in range(14)]})
    made["words"] = [near_dedup.packed(" ".join(t).encode()) for t in texts]
    made["size"], made["bins"] = 40, [np.bincount(near_dedup.word_codes([w.encode() for w in t]) % 256, minlength=256).astype(np.uint8).tobytes() for t in texts]
    made["kept"] = [np.array(held[i], dtype=np.int64).tobytes() for i in range(14)]
    asked, alike = [], near_dedup.alike

    def counted(a, b, similarity):
        asked.append(1)
        return alike(a, b, similarity)

    monkeypatch.setattr(near_dedup, "alike", counted)
    links = []
    for bucket in [(5 << 7) + p for p in places]:
        members = made[[bucket in held[i] for i in range(14)]]
        for low, high in ((0, 0), (0, 1), (1, 1)):
            frame = members if low < high else members[members["slot"] == low]
            frame = frame.assign(bucket=bucket, low=low, high=high, cross=low < high)
            stay = set(near_dedup._may_link(0.8)(frame.drop(columns="words"))["node"])
            if stay:
                links += near_dedup._between_components(0.8)(frame[frame["node"].isin(stay)]).values.tolist()
    assert [sorted(x) for x in links] == [[4, 9]]
    assert len(asked) == sum(i // 2 != j // 2 and not set(held[i]).isdisjoint(held[j]) for i in range(14) for j in range(i))


def test_near_copies_at_the_threshold_meet(spark):
    r = random.Random(21)
    made, pairs = [], []

    def add(a, b):
        pairs.append((len(made), len(made) + 1))
        made.extend([(len(made), " ".join(a)), (len(made) + 1, " ".join(b))])

    for n in (100, 200):
        for step in (5, 6):  # every fifth or sixth word changed: no five words in a row stay
            for _ in range(50):
                a = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
                add(a, [f"n{r.randint(0, 10**6)}" if i % step == step // 2 else w for i, w in enumerate(a)])
    at_most_one_edit = len(pairs)
    for n in range(5, 10):
        for at in range(n):
            a = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
            add(a, [*a[:at], "changed", *a[at + 1 :]])
            add(a, [*a[:at], *a[at + 1 :]])
    codes = {i: codes_of(t) for i, t in made}
    assert all(near_dedup.alike(codes[a], codes[b]) for a, b in pairs)
    assert all(near_dedup.may_be_alike(codes[a], codes[b]) for a, b in pairs)
    found = {x.doc_id: x.class_id for x in near_dedup.near_groups(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    met = [found[a] == found[b] for a, b in pairs]
    assert all(met[at_most_one_edit:]) and sum(met[:at_most_one_edit]) >= 0.98 * at_most_one_edit


def test_moved_and_repeated_passages_are_not_linked():
    a = np.arange(400, dtype=np.uint32)
    assert not near_dedup.alike(a, np.concatenate([a[200:], a[:200]]))
    assert not near_dedup.alike(a, np.concatenate([a, a]))


@pytest.mark.parametrize("cell", [4096, 40])
def test_embeddings(spark, cell):
    r = np.random.default_rng(3)
    centers = r.normal(size=(6, 16))
    made = []
    for i in range(160):
        v = centers[i % 6] + r.normal(size=16) * 0.18 if i % 2 else r.normal(size=16)
        made.append((i, [float(np.float32(x)) for x in v], i % 3 if i % 17 else None))
    made += [(200 + i, made[5][1], made[5][2]) for i in range(4)]
    made += [(300, [0.0] * 16, 1), (301, None, 1), (302, [None] + [1.0] * 15, 1), (303, [float("nan")] + [1.0] * 15, 1), (304, [], 1), (305, [1.0], 1)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<float>, label int")
    good = {i: (np.array(v, float), la) for i, v, la in made if la is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [
        (a, b)
        for a in good
        for b in good
        if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0])
        and good[a][0] @ good[b][0] / (np.linalg.norm(good[a][0]) * np.linalg.norm(good[b][0])) >= 0.93
    ]
    roots = join_up([m[0] for m in made], links)
    found = embedding_dedup.near_copies(df, cell=cell).collect()
    assert len(links) > 50 and {x.vec_id: x.component_id for x in found} == roots
    assert {x.vec_id: x.n_links for x in found} == {i: sum(i in e for e in links) for i in roots}
    assert all(x.kept == (x.vec_id == x.component_id) for x in found)
    assert embedding_dedup.near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [None, 20])
def test_embeddings_with_odd_ids_and_columns(spark, cell):
    r = np.random.default_rng(9)
    base = [[float(x) for x in r.normal(size=8)] for _ in range(60)]
    made = [(i, base[i], 1, "a", "b", 7) for i in range(60)]
    made += [(None, base[0], 1, "a", "b", 7), (None, base[0], 1, "a", "b", 7), (3, base[3], 1, "a", "b", 7), (None, [9.0] * 8, 2, "a", "b", 7)]
    df = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int, key string, root string, links int")
    found = sorted(embedding_dedup.near_copies(df, cell=cell).collect(), key=lambda x: (x.vec_id is None, x.vec_id or 0, x.n_links))
    near = {i: sum(np.dot(base[i], b) / np.linalg.norm(base[i]) / np.linalg.norm(b) >= 0.93 for b in base) - 1 for i in range(60)}
    assert [x.n_links for x in found if x.vec_id == 3] == [near[3] + 1] * 2
    assert [x.n_links for x in found if x.vec_id == 0] == [near[0] + 2]
    assert [(x.component_id, x.kept, x.n_links) for x in found if x.vec_id is None] == [(None, True, 0), (0, False, near[0] + 2), (0, False, near[0] + 2)]


def test_cover_tree_of_vectors_and_their_negations():
    signs = np.random.default_rng(6).choice([-0.25, 0.25], size=(30, 16))
    for x in (np.concatenate([signs, -signs]), np.concatenate([np.eye(40), -np.eye(40)])):
        tree, met = cover_tree.Tree(x), set()
        assert sorted(np.concatenate([p for p in tree.points if p is not None]).tolist()) == list(range(len(x)))
        cover_tree.dual(tree, tree, 1.0, lambda a, b: met.update((min(i, j), max(i, j)) for i in a.tolist() for j in b.tolist()), True)
        near = cover_tree.distances(x, x) <= 1.0
        assert {(i, j) for i, j in np.argwhere(near).tolist() if i < j} <= met


def test_columns_are_in_suffix_order():
    r = random.Random(12)
    for _ in range(40):
        contexts, at, groups = [], [], []
        for g in range(r.randint(1, 4)):
            for _ in range(r.randint(1, 6)):
                a = r.randint(0, 6)
                contexts.append(bytes(r.choice(b"ab") for _ in range(a)) + b"aab" + bytes(r.choice(b"ab") for _ in range(r.randint(0, 5))))
                at.append(a)
                groups.append(g)
        numbers = np.array(groups)
        for offset, order, common in suffix_dedup.columns_in_suffix_order(numbers, contexts, at):
            suffix = {i: contexts[i][at[i] - offset :] for i in range(len(contexts)) if at[i] >= offset}
            assert [(groups[i], suffix[i]) for i in order.tolist()] == sorted((groups[i], x) for i, x in suffix.items())
            for x, y, n in zip(order[:-1].tolist(), order[1:].tolist(), common[1:].tolist(), strict=True):
                same = next((k for k, (p, q) in enumerate(zip(suffix[x], suffix[y], strict=False)) if p != q), min(len(suffix[x]), len(suffix[y])))
                assert n == (same if groups[x] == groups[y] else 0)


def test_longest_previous_factors():
    r = random.Random(4)
    for _ in range(60):
        d = bytes(r.choice(b"ab") for _ in range(r.randint(1, 30)))
        want = [max([0] + [k for j in range(i) for k in range(1, len(d) - i + 1) if d[j : j + k] == d[i : i + k]]) for i in range(len(d))]
        assert suffix_dedup.longest_previous_factors(d) == want


@pytest.mark.parametrize("group", [2000, 2])
@pytest.mark.parametrize("kind", ["string", "date", "decimal(12,0)", "long"])
def test_first_copies_stay_whatever_the_ids_are(spark, monkeypatch, group, kind):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    r = random.Random(7)
    passage = "".join(r.choice("abcdefgh ") for _ in range(419))
    texts = ["".join(r.choice("ijklmnop ") for _ in range(50 * i)) + f"{i}{passage}{i} end" for i in range(8)] + [passage, passage]
    made = [(i, t, 0, "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(made, "n int, text string, low int, content string")
    named = "date_add(date'2020-01-01', 20 - n)" if kind == "date" else f"CAST(30 - n AS {kind})"
    df = df.selectExpr(f"CASE WHEN n < 2 THEN NULL ELSE {named} END AS doc_id", "text", "low", "content", "n")
    # the smallest id is that of row 9, whose text is the passage; all others lose it, or all of it
    left = {x.n: x.text for x in suffix_dedup.keep_first_copies(df.repartition(3)).collect()}
    assert left[9] == passage and left[8] == ""
    assert all(left[i] == texts[i].replace(passage, "") for i in range(8))


@pytest.mark.parametrize("group", [2000, 2])
def test_repeated_strings(documents, empty, nulls, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    raws = {row[0]: (row[1] or "").encode() for row in rows()}
    first, times = {}, {}
    for i in sorted(raws):
        for p in range(len(raws[i]) - 199):
            s = raws[i][p : p + 200]
            times[s] = times.get(s, 0) + 1
            first.setdefault(s, (i, p))
    want, kept = {}, {}
    for i, raw in raws.items():
        every, later = bytearray(len(raw)), bytearray(len(raw))
        for p in range(len(raw) - 199):
            s = raw[p : p + 200]
            if times[s] > 1:
                every[p : p + 200] = b"\1" * 200
            if first[s] != (i, p):
                later[p : p + 200] = b"\1" * 200
        rest = bytes(b for b, m in zip(raw, every, strict=True) if not m)
        spans = sum(1 for j in range(len(raw)) if every[j] and not (j and every[j - 1]))
        want[i] = (len(raw), sum(every), spans, hashlib.sha256(rest).hexdigest())
        kept[i] = bytes(b for b, m in zip(raw, later, strict=True) if not m).decode("utf-8", "ignore")
    found = suffix_dedup.repeated_bytes(documents).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want
    left = suffix_dedup.keep_first_copies(documents)
    assert left.columns == documents.columns and {r.doc_id: r.text or "" for r in left.collect()} == kept
    if group == 2:
        assert suffix_dedup.repeated_bytes(empty).count() == 0 and suffix_dedup.keep_first_copies(empty).count() == 0
        assert suffix_dedup.repeated_bytes(nulls).count() == 8 and suffix_dedup.keep_first_copies(nulls).count() == 8


def test_html_held_out_accuracy():
    model = html_extract.trained()
    wrong = blocks = 0
    for page in labelled_pages(150, 4242):
        nodes = dom.flat(dom.parse(page))
        chosen = html_extract.decode(nodes, model.log_odds(dom.features(nodes)))
        for v, y, c in zip(nodes, html_extract.labels(nodes), chosen, strict=True):
            if v.tag == "#block":
                blocks += 1
                wrong += bool(y) != bool(c)
            if c and v.parent.tag != "#root":
                assert chosen[nodes.index(v.parent)]
    assert wrong < 0.02 * blocks


def test_html_pages(spark):
    page = (
        '<html><head><title>t</title><script>var x="</p>"</script></head><body><nav><ul><li><a href="/a">home</a></li><li><a href="/b">news,</a></li></ul></nav>'
        '<div class="ad">Buy the thing now. It is good.</div><article><h1>A title &amp; more</h1><p><b>The first   paragraph of the text<br><p>Second one, with a <a href="x">link</a>\n here.</p>'
        "<p>Third paragraph is here as well.</p></article><footer>&copy; site &middot; all of it.</footer></body></html>"
    )
    odd = [None, "", "<", "<p", "<!-- never ends", "plain text", "<div>" * 300 + "deep words in here", page]
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in enumerate(odd)], "page_id long, url string, html string, text string")
    found = {r.page_id: r for r in html_extract.extract_pages(df).collect()}
    assert found[7].text == "A title & more\n\nThe first paragraph of the text\n\nSecond one, with a link here.\n\nThird paragraph is here as well."
    assert all(r.n_chars == len(r.text) for r in found.values()) and found[0].text == found[1].text == ""
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_drops_only_what_is_no_text():
    def blocks(page):
        return [v.text for v in dom.flat(dom.parse(page)) if v.tag == "#block"]

    for tag in ("button", "select", "svg", "math", "object"):
        assert blocks(f"<div>Note <{tag}></div><article><p>The article.</p></article>") == ["Note", "The article."]
        assert blocks(f"<div><{tag}><p>The article.</p><p>More of it.</p></div>") == ["The article.", "More of it."]
    assert blocks("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, then</p><p>more</p>") == ["Let x=2, then", "more"]
    assert blocks('<p>See <object data="a">the fallback</object> here</p>') == ["See the fallback here"]
    assert blocks('<p>one<svg><g><path d="M0"/></g></svg>two</p><p>three</p>') == ["one two", "three"]
    assert blocks("<p>a<script>x</script>b</p><iframe>no</iframe><textarea>no</textarea>") == ["a b"]


def test_html_of_broken_tags_takes_linear_time():
    for broken in ("<a b='x\" ", "<b x ", "<a<a", "<b ' > ' ", "<!", "<noscript>", "<a ' ", "<p><i><"):
        begun = time.perf_counter()
        dom.parse(broken * (1_000_000 // len(broken)) + "<p>text</p>")
        assert time.perf_counter() - begun < 10
    blocks = [v.text for v in dom.flat(dom.parse("<noscript><p>One.</p><iframe><p>Two.</p><template><p>Three.</p>")) if v.tag == "#block"]
    assert blocks == ["One.", "Two.", "Three."]


def test_html_rows_are_their_own(spark):
    page = "<body><article><h1>Title here</h1><p>The first paragraph of the text.</p><p>And the second one of it.</p></article></body>"
    df = spark.createDataFrame([(None, None, page), (1, "u", page), (1, "u", page)], "page_id long, url string, html string")
    found = html_extract.extract_pages(df).collect()
    assert len(found) == 3 and {r.text for r in found} == {"Title here\n\nThe first paragraph of the text.\n\nAnd the second one of it."}


def test_chats(spark):
    made = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (4, 0, "user", "other"), (5, 0, "user", "other"), (6, 0, None, None), (6, 0, None, None), (6, 1, "user", ""),
        (None, 0, "system", "alone"), (7, 0, "user", "hi"), (7, 1, "assistant", "no"), (8, 3, "b", "x"), (8, 3, "a", "x"),
    ]
    df = spark.createDataFrame([(*m, 1, "z") for m in made], "conv_id long, turn long, role string, text string, idx int, n string")
    made += [(None, 1, "user", "same"), (9, 0, "system", "alone"), (9, 1, "user", "same")]
    df = spark.createDataFrame([(*m, 1, "z") for m in made], "conv_id long, turn long, role string, text string, idx int, n string")
    got = sorted(tuple(r) for r in chat_format.format_chats(df).select("conv_id", "n_turns", "copies", "text", "n_chars").collect())
    con = duckdb.connect()
    con.register("conversations", pa.table({c: [m[i] for m in made] for i, c in enumerate(["conv_id", "turn", "role", "text"])}))
    want = sorted(con.execute(chat_format.ORACLE_SQL).fetchall())
    assert got == want and [g[0] for g in got] == [2, 4, 6, 7, 8, 9]
    alone = chat_format.format_chats(df.filter("conv_id IS NULL")).collect()
    assert [(r.conv_id, r.n_turns, r.copies) for r in alone] == [(None, 2, 1)]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_pipeline(spark, documents, empty, nulls, tmp_path):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, empty.select(docs.columns), nulls.select(docs.columns)):
        out = table
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, out, "")
            out = spark.createDataFrame(made.collect(), made.schema)
            assert number == 4 or out.columns == docs.columns
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the same in plain Python: rules, classes of near copies, first copies of strings
    texts, sources = {}, {}
    for i, text, _, source, *_ in rows():
        verdict = quality.judge(text)
        if verdict["kept"]:
            texts[i], sources[i] = verdict["clean_text"], source
    codes = {i: codes_of(t) for i, t in texts.items()}
    full = [i for i, c in codes.items() if len(c)]
    classes = join_up(texts, [(a, b) for a in full for b in full if a < b and near_dedup.alike(codes[a], codes[b])])
    raws = {i: texts[i].encode() for i in sorted(texts) if classes[i] == i}
    first, left = {}, {}
    for i, raw in raws.items():
        for p in range(len(raw) - 199):
            first.setdefault(raw[p : p + 200], (i, p))
    for i, raw in raws.items():
        later = bytearray(len(raw))
        for p in range(len(raw) - 199):
            if first[raw[p : p + 200]] != (i, p):
                later[p : p + 200] = b"\1" * 200
        left[i] = bytes(b for b, m in zip(raw, later, strict=True) if not m).decode("utf-8", "ignore")
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in left.items()}
    words = {s: sum(sizes[i] for i in left if sources[i] == s) for s in {sources[i] for i in left}}
    targets = {s: t for _, s, _, t in mixing.source_targets(list(words.items()))}
    tokens = dict(zip(left, Tokenizer.from_file(default_path("word_bpe_49k.json")).encode_batch(list(left.values()), add_special_tokens=False), strict=True))
    ids, taken, places = {i: [*e.ids, 1] for i, e in tokens.items()}, dict.fromkeys(words, 0), {}
    assert {r.doc_id for r in made} <= left.keys()
    for r in made:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        if r.start == 0:
            taken[sources[r.doc_id]] += sizes[r.doc_id]
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i in left:
        pieces = [(r.start, r.length) for r in made if r.doc_id == i]
        times = sum(start == 0 for start, _ in pieces)
        assert times <= 3 and sorted(set(pieces)) == [(a, min(2048, len(ids[i]) - a)) for a in range(0, len(ids[i]) if times else 0, 2048)]
        assert len(pieces) == times * len(set(pieces))
    for s, target in targets.items():
        assert abs(taken[s] - target) <= max(sizes[i] for i in left if sources[i] == s)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
