"""Quality rules, token counts, packing, the id store and mixing against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from findery.llm import mixing, packing, quality, token_count, token_store
from findery.llm.shared import delete_path, fresh_path
from findery.llm.vocab import LibraryEncoder, default_path
from tests.llm.conftest import rows

WORDS, BYTES = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")


def encoded(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def base_columns(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times, mark = Counter(windows), set()
    for i, x in enumerate(windows):
        if times[x] > 1:
            mark.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(mark)


def test_quality_base_columns(documents, empty, nulls):
    found = {r["doc_id"]: r for r in quality.assess(documents).collect()}
    for row in rows():
        r = found[row[0]]
        want = base_columns(row[1])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality.assess(empty).count() == 0 and quality.assess(nulls).count() == 8
    kept = quality.clean_documents(documents)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.kept}
    assert quality.clean_documents(empty).count() == 0


def test_quality_of_null_rows_and_clashing_columns(spark):
    prose = "The quick line of prose has more than ten words in it today.\nhome | news | sport |"
    made = [(None, None, 1, "a"), (None, prose, 2, "b"), (None, prose, 2, "b"), (3, "", 3, None), (4, "short", None, None)]
    df = spark.createDataFrame(made, "doc_id long, text string, n_words int, kept string")
    found = quality.clean_documents(df)
    assert found.columns == df.columns
    want = [(None, prose.split("\n")[0], 2, "b")] * 2
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert [r.kept for r in quality.assess(df).orderBy("n_words").collect()].count(True) == 2


def test_null_texts_are_empty_ones(nulls):
    counted = {(r.doc_id, r.n_bytes): r.n_tokens for r in token_count.count_tokens(nulls).collect()}
    assert counted[None, 0] == 0 and counted[3, 0] == 0
    packed = [r for r in packing.pack(nulls).collect() if r.doc_tokens == 1]
    assert len(packed) == 2 and {(r.start, r.length, r.ids_crc32) for r in packed} == {(0, 1, crc([1]))}
    stored = [r for r in token_store.store_and_read(nulls).collect() if r.n_tokens == 1]
    assert len(stored) == 2 and {r.ids_crc32 for r in stored} == {crc([2])}


@pytest.mark.parametrize(
    ("line", "failed"),
    [
        ("The plain line of prose ends here.", None),
        ("word### word$$$ word%%% word&&& word*** word", "punctuation"),
        ("AND!! THE!! WORDS!! ARE!! ALL!! LOUD!!", "punctuation"),
        ("home | news | sport | weather |", "navigation"),
        ("menu", "navigation"),
        ("same same same same same same", "boilerplate"),
        ("We use cookies on this site.", "boilerplate"),
    ],
)
def test_quality_rules_of_a_line(line, failed):
    assert quality.line_failure(line, line.encode().split(), True) == failed


@pytest.mark.parametrize(
    ("line", "failed"),
    [
        ("She found the old catalog in a drawer of the desk.", None),
        ("The analog input feeds the board.", None),
        ("They chose the design in May.", None),
        ("Put every cookie on the tray.", None),
        ("The teller asked them to sign in with a pen before the meeting began.", None),
        ("Please log in or sign up to read the rest of this fine story.", "boilerplate"),
        ("Click here to go on.", "boilerplate"),
        ("© 2020 The Company.", "boilerplate"),
    ],
)
def test_quality_phrases_are_whole_and_strong(line, failed):
    assert quality.line_failure(line, line.encode().split(), True) == failed


def test_quality_keeps_prose_with_a_phrase():
    prose = "The teller asked all of them to sign in with a pen before the meeting began."
    assert quality.judge(prose)["kept"] and quality.judge(prose)["clean_text"] == prose


def test_quality_rejects_what_loses_too_much():
    body = "\n".join(" ".join(f"word{i}x{j}" for j in range(12)) + "." for i in range(6))
    assert quality.judge(body)["kept"]
    some = quality.judge(body + "\nhome | news | sport |")
    assert some["kept"] and some["navigation_lines"] == 1 and "home" not in some["clean_text"]
    assert not quality.judge(body + "\n" + "\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i} | f{i} |" * 6 for i in range(6)))["kept"]


def test_token_counts(documents, empty, nulls):
    want = {row[0]: (len((row[1] or "").encode()), len(ids)) for row, ids in zip(rows(), encoded(WORDS, [x[1] for x in rows()]), strict=True)}
    for r in token_count.count_tokens(documents).collect():
        assert (r.n_bytes, r.n_tokens) == want[r.doc_id] and r.over_limit == (r.n_tokens > 2048)
    assert token_count.count_tokens(empty).count() == 0 and token_count.count_tokens(nulls).count() == 8


def check_packed(found, ids, length):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == crc(own[r.start : r.start + r.length])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for whole in (*[(sorted(p), len(ids[i])) for i, p in pieces.items()], *[(sorted(s), None) for s in sequences.values()]):
        at = 0
        for start, size in whole[0]:
            assert start == at
            at += size
        assert at == whole[1] if whole[1] is not None else at <= length


def test_packing(documents, empty, nulls):
    ids = {row[0]: [*x, 1] for row, x in zip(rows(), encoded(WORDS, [x[1] for x in rows()]), strict=True)}
    check_packed(packing.pack(documents).collect(), ids, 2048)
    small = packing.pack(documents, length=64, group_pieces=40, keep_ids=True).cache()
    check_packed(small.collect(), ids, 64)
    made = {r.sequence_id: bytes(r.ids) for r in packing.sequences(small).collect()}
    for r in small.collect():
        assert made[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert packing.pack(empty).count() == 0
    assert packing.pack(nulls).count() == 8


def test_equal_rows_spread_over_the_groups(spark):
    df = spark.range(4000).selectExpr("CAST(NULL AS bigint) AS doc_id", "CAST(NULL AS string) AS text")
    groups = Counter(r.sequence_id >> 32 for r in packing.pack(df, group_pieces=200).collect())
    assert len(groups) == 20 and max(groups.values()) < 300


def test_first_fit_is_first_fit():
    r = np.random.default_rng(1)
    sizes = np.sort(r.integers(1, 65, 300))[::-1]
    bins, offsets = packing.first_fit_decreasing(sizes, 64)
    room: list[int] = []
    for size, got, at in zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        place = next((i for i, free in enumerate(room) if free >= size), len(room))
        if place == len(room):
            room.append(64)
        assert (got, at) == (place, 64 - room[place])
        room[place] -= size


def test_token_store(spark, documents, empty, nulls):
    ids = {row[0]: [*x, 2] for row, x in zip(rows(), encoded(BYTES, [x[1] for x in rows()]), strict=True)}
    path = fresh_path(spark, "test-store")
    token_store.write_store(documents, path, part_documents=7)
    at = 0
    want = {}
    for i in sorted(ids):
        want[i] = (at, len(ids[i]), crc(ids[i]))
        at += len(ids[i])
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_digests(spark, path).collect()} == want
    assert {r.doc_id: list(r.ids) for r in token_store.read_ids(spark, path).collect()} == ids
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    altered = [(bytes(r.digest), bytes(r.data)[:-1] + b"\0") for r in chunks.limit(1).collect()]
    delete_path(spark, f"{path}/chunks")
    spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in altered], "digest binary, data binary").write.parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="StoreError"):
        token_store.read_digests(spark, path).collect()
    assert token_store.store_and_read(empty).count() == 0
    again = token_store.store_and_read(nulls).collect()
    assert len(again) == 8 and max(r.start + r.n_tokens for r in again) == sum(r.n_tokens for r in again)


def test_crc_of_joined_strings():
    a, b = b"some bytes", b"and some more" * 50
    assert token_store.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_budget_fit_is_exact_where_it_can_be():
    lengths, counts = np.array([7, 11, 300]), np.array([5, 4, 2])
    sums = {7 * a + 11 * b + 300 * c for a in range(6) for b in range(5) for c in range(3)}
    for budget in range(0, 700, 13):
        take = mixing.fit_budget(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all() and (take * lengths).sum() <= budget
    # where an even share doesn't stand in the way, the rest is filled as far as any choice can fill it
    best = mixing.fit_budget(lengths, counts, 299)
    assert (best * lengths).sum() in sums and 299 - (best * lengths).sum() <= max(299 - s for s in sums if s <= 299) + 40


def test_mix(documents, empty, nulls, spark):
    import re

    found = mixing.mix(documents).collect()
    sizes = {row[0]: len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")) for row in rows()}
    source = {row[0]: row[3] for row in rows()}
    by_source = defaultdict(list)
    for r in found:
        assert r["size"] == sizes[r.doc_id] and 0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0)
        by_source[source[r.doc_id]].append(r)
    total = sum(sizes.values())
    assert abs(sum(v[0].target for v in by_source.values()) - total) < 1e-6
    for own in by_source.values():
        assert own[0].source_size == sum(r["size"] for r in own) and own[0].target <= 3 * own[0].source_size + 1e-6
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own)
    assert sorted(map(tuple, mixing.mix(documents.repartition(5)).collect())) == sorted(map(tuple, found))
    whole = mixing.mixed_documents(documents)
    assert whole.columns == documents.columns
    assert Counter(r.doc_id for r in whole.collect()) == Counter({r.doc_id: r.taken // r["size"] for r in found if r.taken})
    assert mixing.mix(empty).count() == 0 and mixing.mix(nulls).count() == 8
    assert mixing.mixed_documents(empty).count() == 0


def test_equal_rows_are_mixed_one_by_one(spark):
    made = [(1, "a b c d e", "s", "x"), *[(7, "one two three four", "t", "y")] * 5, *[(None, "u v w", "t", str(i)) for i in range(4)], (2, "q " * 40, None, "z")]
    df = spark.createDataFrame(made, "doc_id long, text string, source string, copies string").repartition(3)
    decided = Counter()
    for r in mixing.mix(df).collect():
        decided[r.doc_id] += r.taken
    whole = mixing.mixed_documents(df)
    assert whole.columns == df.columns
    taken, times = Counter(), Counter()
    for r in whole.collect():
        taken[r.doc_id] += len(r.text.split())
        times[tuple(r)] += 1
    assert mixing.mix(df).count() == len(made) and taken == +decided
    # of equal rows each is taken as often as another, or once more
    assert all(times[m] <= 3 * made.count(m) for m in made)
    own = [times[m] for m in made if m[0] is None]
    assert max(own) - min(own) <= 1


def test_targets():
    assert [(s, t) for _, s, _, t in mixing.source_targets([("b", 10), (None, 5), ("a", 1000)])] == [("a", 970.0), ("b", 30.0), (None, 15.0)]
    assert [t for *_, t in mixing.source_targets([("a", 0), ("b", 8)])] == [0.0, 8.0]


@pytest.mark.parametrize("kind", ["smallint", "decimal(10,2)", "date", "string", "double"])
def test_ids_of_other_types(spark, kind):
    texts = ["one two", "three", None, "", "one two"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "n int, text string, root string")
    named = "date_add(date'2020-01-01', n)" if kind == "date" else f"CAST(n AS {kind})"
    df = df.selectExpr(f"CASE WHEN n = 4 THEN NULL ELSE {named} END AS doc_id", "text", "root")
    found = sorted(token_store.store_and_read(df).collect(), key=lambda r: r.start)
    assert [r.doc_id is None for r in found] == [True, False, False, False, False]
    assert [r.n_tokens for r in found] == [len(x) + 1 for x in encoded(BYTES, ["one two", *texts[:4]])]
    assert packing.pack(df).count() == 5 and token_count.count_tokens(df).count() == 5


def test_odd_texts_get_the_library_s_ids():
    r = random.Random(3)
    pool = [*"aBéΣς1.,'_-", "́", "23", "!!", "'s", "don't", " ", "  ", "\n", "\x01", "\x00", "漢字", "🎉", "<|", "|>", "<|endoftext|>", "\t", "\r", "\xa0", "ﬁ", "İ", "x" * 300, " ", "ǅ", "\x1c", "ß.", "naïve&&&"]
    odd = ["".join(r.choice(pool) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for path in (WORDS, BYTES):
        encoder = LibraryEncoder(path)
        encoder.cache.entries = 50
        made = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(odd), 700) for x in encoder.encode_texts(odd[i : i + 700])]
        assert made == encoded(path, odd)
        assert all(len(chunk) <= 256 for chunk in encoder.cache)
