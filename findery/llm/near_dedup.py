"""Near-duplicate documents by order MinHash, verified by banded alignment.

Texts are compared as sequences of lower-case words (runs of letters, digits and low lines). Each window of
``k`` words, labelled with its occurrence number, gets a hash; for each of a
number of permutations the ``L`` smallest labelled windows are taken and hashed in
the order in which they stand in the text. Two documents with an equal sketch are
candidates. A candidate pair links if the edit distance of the word sequences,
computed inside a band, is at most ``1 - SIMILARITY`` of the longer one. A class
is a connected component of links.

An edit breaks at most ``k`` windows, so of texts that link ``(1 - 0.2 k)`` of the
longer one's windows stay wherever the edits stand. Windows of five words leave
nothing where every fifth word differs, so windows are shorter: two words in texts
of up to ``FEW`` words (32 sketches), three in longer ones (48). Texts from
``0.8 FEW`` to ``FEW`` words have both kinds, as a pair may stand on either side.
Texts of up to ``SHORT`` words may differ by one edit; they also meet by the text
without any one of its words, so no link between two of them is lost.

Documents with the same words are one node. In a bucket of equal sketches every
node is first aligned with the bucket's smallest node. Only buckets that still
hold several components are then searched for links between them, all pairs of
components included, in blocks of bounded size after two exact filters (length,
and words in common): so no link that joins two classes is lost within a bucket,
and thousands of near copies cost one alignment each, not one for a pair. The
same filters come before the first alignment. Two nodes that share several of
these buckets are compared in one of them, which a hash of the two picks.

Defined results: null texts and texts without any character but white space are
alone in their class and kept; texts of fewer than five words have no edit to
spare, so they link only if all their words agree; a class takes the smallest
``doc_id`` in it, null only if it has no other; every row with its class's id is
``kept``, so rows that repeat an id in one class share the verdict, and in different
classes each has its own; texts of any length are compared whole; an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.alignment import banded_distance
from findery.llm.graph import components
from findery.llm.shared import discard, written
from findery.llm.vocab import release

#: Windows of a sketch.
L = 2
#: Words of a window and sketches of texts of up to ``FEW`` words, and of longer ones.
FEW = 100
FEW_K, FEW_SKETCHES = 2, 32
MANY_K, MANY_SKETCHES = 3, 48
SIMILARITY = 0.8
#: Words up to which one edit is all that ``SIMILARITY`` allows.
SHORT = 9
#: Members that are aligned with one leader in one task, and nodes of a mixed bucket on one side of a block.
BLOCK = 1024
#: The low bits of a bucket say which sketch it is; texts without a word have their own number.
PLACE = 127
MARK = 127
PLACES = FEW_SKETCHES + MANY_SKETCHES
#: Bins of the filters by words in common: of the first, which travels without the words, and of the second.
FEW_BINS = 256
BINS = 1024
#: Windows up to which all permutations are computed at once.
AT_ONCE = 50_000
#: Contents that a task remembers, so that copies don't carry their sketches and words along.
REMEMBERED = 200_000
_WORD = re.compile(r"\w+")
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_FINISH = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[str]:
    """Lower-case words; a text without letters or digits is split at white space instead."""
    if not text:
        return []
    text = text.lower()
    return _WORD.findall(text) or text.split()


def word_codes(words: list[bytes]) -> np.ndarray:
    """Hashes of words, for windows alone: texts are compared by the words themselves."""
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _FINISH
    return x ^ (x >> np.uint64(27))


def labelled_windows(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every window of ``k`` words and its occurrence number; one window for shorter texts."""
    n = len(codes) - k + 1
    words = codes.astype(np.uint64)
    if n < 1:
        n, k = 1, len(codes)
    h = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        h = _mixed(h * _MULTIPLY + words[i : i + n])
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    occurrence = np.zeros(n, dtype=np.uint64)
    if not fresh.all():
        starts = np.flatnonzero(fresh)
        run = np.repeat(starts, np.diff(np.append(starts, n)))
        occurrence[order] = (np.arange(n) - run).astype(np.uint64)
    return _mixed(h + occurrence * _MULTIPLY)


def sketches(codes: np.ndarray, k: int, count: int, least: int = L) -> np.ndarray:
    """Order-MinHash sketches: hashes of the ``least`` smallest windows of each permutation, in text order."""
    h = labelled_windows(codes, k)
    least = min(least, len(h))
    seeds = _mixed(np.arange(1 + 1000 * k, count + 1 + 1000 * k, dtype=np.uint64) * _MULTIPLY)
    out = np.zeros(count, dtype=np.uint64)
    step = count if len(h) <= AT_ONCE else 1
    for first in range(0, count, step):
        own = seeds[first : first + step]
        v = h * (own | np.uint64(1))[:, None]
        rows = np.arange(len(own))
        taken = []
        for _ in range(least):
            i = v.argmin(axis=1)
            taken.append(i)
            v[rows, i] = np.uint64(0xFFFFFFFFFFFFFFFF)
        places = np.sort(np.stack(taken), axis=0)
        made = own.copy()
        for p in places:
            made = _mixed(made * _MULTIPLY + h[p])
        out[first : first + step] = made
    return out.view(np.int64)


def buckets(codes: np.ndarray) -> np.ndarray:
    """All the buckets that a text falls into."""
    n, found = len(codes), []
    if n <= FEW:
        found.append(short_marks(codes) | MARK)
        found.append(sketches(codes, FEW_K, FEW_SKETCHES) & ~PLACE | np.arange(FEW_SKETCHES))
    if n >= SIMILARITY * FEW:
        found.append(sketches(codes, MANY_K, MANY_SKETCHES) & ~PLACE | np.arange(FEW_SKETCHES, PLACES))
    return np.concatenate(found)


def short_marks(codes: np.ndarray) -> np.ndarray:
    """Hashes of a short text and of it without each one of its words: texts one edit apart share one."""
    n = len(codes)
    if not 4 <= n <= SHORT:
        return np.zeros(0, dtype=np.int64)
    kept = [codes, *(np.delete(codes, i) for i in range(n))]
    made = {int.from_bytes(hashlib.blake2b(c.tobytes(), digest_size=8).digest(), "little", signed=True) for c in kept}
    return np.array(sorted(made), dtype=np.int64)


def allowed_edits(n: int, m: int, similarity: float = SIMILARITY) -> int:
    return int(max(n, m) * (1 - similarity) + 1e-9)


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sequences of word numbers have an edit similarity of at least ``similarity``."""
    return banded_distance(a.tolist(), b.tolist(), allowed_edits(len(a), len(b), similarity)) is not None


def may_be_alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether lengths and words in common leave room for ``alike``; false only if it is."""
    longest, most = max(len(a), len(b)), allowed_edits(len(a), len(b), similarity)
    if abs(len(a) - len(b)) > most:
        return False
    common = np.minimum(np.bincount(a % BINS, minlength=BINS), np.bincount(b % BINS, minlength=BINS)).sum()
    return bool(common >= longest - most)


class _Codes(dict):
    """Numbers words as they come, so that equal numbers are equal words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def of(self, packed: bytes) -> np.ndarray:
        words = unpacked(packed)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def packed(joined: bytes) -> bytes:
    """Words with spaces between, compressed, after their size."""
    return len(joined).to_bytes(8, "little") + pa.compress(joined, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> list[bytes]:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True).split(b" ")


def _prepared(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[bytes] = set()
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                rows = []
                for text in part.column(2).to_pylist():
                    words = words_of(text)
                    if not words:
                        rows.append((None, None, None))
                        continue
                    joined = " ".join(words).encode("utf-8", "surrogatepass")
                    content = hashlib.blake2b(joined, digest_size=16).digest()
                    if content in seen:
                        rows.append((content, None, None))
                        continue
                    seen.add(content)
                    rows.append((content, len(words), packed(joined)))
                if len(seen) > REMEMBERED:
                    seen.clear()
                kinds = [pa.binary(), pa.int32(), pa.binary()]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *columns], ["doc_id", "digest", "content", "size", "words"]
                )

    id_type = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", _digest().alias("digest"), "text").mapInArrow(
        run, f"doc_id {id_type}, digest binary, content binary, size int, words binary"
    )


def _marks(nodes: DataFrame) -> DataFrame:
    """``node, size, bucket`` of every node and each bucket that it falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                made = [buckets(word_codes(unpacked(data))) for data in part.column(2).to_pylist()]
                times = pa.array(np.repeat(np.arange(part.num_rows), [len(m) for m in made]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(times), part.column(1).take(times), pa.array(np.concatenate(made))],
                    ["node", "size", "bucket"],
                )

    return nodes.select("node", "size", "words").mapInArrow(run, "node long, size int, bucket long")


def _digest():
    """Sixteen bytes that stand for a text as it is written, null for null."""
    return F.unhex(F.md5(F.col("text").cast("binary")))


def _verified(stars: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``leader, node`` of ``stars`` whose words align, as ``u, v``.

    The words of a leader travel once for each ``BLOCK`` members, not for each pair.
    """
    hot = stars.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK)
    hot = hot.select(F.col("leader").alias("hot"), F.ceil(F.col("n") / BLOCK).alias("slots"))
    slot = F.coalesce(F.pmod(F.xxhash64("node"), F.col("slots")), F.lit(0)).cast("int")
    dealt = stars.join(hot, F.col("leader") == F.col("hot"), "left").select("leader", slot.alias("slot"), "node")
    heads = dealt.select("leader", "slot").distinct()
    asked = dealt.select("leader", "slot", F.lit(True).alias("member"), F.col("node").alias("want")).unionByName(
        heads.select("leader", "slot", F.lit(False).alias("member"), F.col("leader").alias("want"))
    )
    sent = asked.join(nodes.select(F.col("node").alias("want"), "words").hint("merge"), "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by leader and slot, the leader's own words first."""
        codes, leader, words = _Codes(), None, None
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                found: tuple[list, list] = ([], [])
                for own, member, node, data in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                    if not member:
                        if len(codes) > 1_000_000:
                            codes.clear()
                        leader, words = own, codes.of(data)
                        continue
                    other = codes.of(data)
                    if may_be_alike(words, other, similarity) and alike(words, other, similarity):
                        found[0].append(leader)
                        found[1].append(node)
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], ["u", "v"])

    return (
        sent.repartition("leader", "slot")
        .sortWithinPartitions("leader", "slot", "member")
        .select("leader", "slot", "member", "want", "words")
        .mapInArrow(run, "u long, v long")
    )


def _bins(nodes: DataFrame) -> DataFrame:
    """``node, size, bins, kept``: how many words fall into each of ``FEW_BINS`` bins, null where a byte can't hold one.

    ``kept``, the buckets that are searched, becomes the bytes of its numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = []
            for data in batch.column(2).to_pylist():
                counts = np.bincount(word_codes(unpacked(data)) % FEW_BINS, minlength=FEW_BINS)
                bins.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else None)
            kept = [np.array(k, dtype=np.int64).tobytes() for k in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bins, pa.binary()), pa.array(kept, pa.binary())], ["node", "size", "bins", "kept"]
            )

    return nodes.select("node", "size", "words", "kept").mapInArrow(run, "node long, size int, bins binary, kept binary")


class _Turns:
    """Which pairs of the nodes of one bucket are that bucket's to compare.

    Of the searched buckets that two nodes share, a hash of the two picks one, so
    that each pair has its turn once and no bucket has most of them. A text without
    one of its words has no place among the sketches: such buckets compare all.
    """

    def __init__(self, bucket: int, nodes: np.ndarray, kept: list[bytes]):
        self.place = bucket & PLACE
        held = np.frombuffer(b"".join(kept), dtype=np.int64)
        rows = np.repeat(np.arange(len(kept)), [len(k) // 8 for k in kept])
        sketch = held & PLACE != MARK
        # no sketch has the number -1, which ends in MARK
        self.places = np.full((len(kept), PLACES), -1, dtype=np.int64)
        self.places[rows[sketch], held[sketch] & PLACE] = held[sketch]
        self.salts = _mixed(nodes.astype(np.uint64) * _MULTIPLY)

    def of(self, i: int, rest: np.ndarray) -> np.ndarray:
        if self.place == MARK or not len(rest):
            return rest
        own = np.flatnonzero(self.places[i] != -1)
        same = self.places[np.ix_(rest, own)] == self.places[i, own]
        before = same[:, : np.searchsorted(own, self.place)].sum(axis=1)
        picked = (_mixed(self.salts[rest] + self.salts[i]) >> np.uint64(20)) % same.sum(axis=1).astype(np.uint64)
        return rest[before == picked]


class _Reach:
    """Nodes of one block or of two by length, and for each the ones before it that it may link with.

    Those are of another component (and of the other block, in two), within
    reach by length, have their turn in this bucket, and share enough words by a count of bins.
    """

    def __init__(self, f: pd.DataFrame, sizes: np.ndarray, bins: np.ndarray, similarity: float):
        self.sizes, self.bins, self.roots, self.slots = sizes, bins, f["root"].to_numpy(), f["slot"].to_numpy()
        self.cross = bool(f["cross"].iloc[0])
        self.turns = _Turns(int(f["bucket"].iloc[0]), f["node"].to_numpy(), f["kept"].tolist()) if "kept" in f else None
        self.most = (sizes * (1 - similarity) + 1e-9).astype(np.int64)
        # by length, so that those within reach of a text are a run
        self.lows = np.searchsorted(sizes, sizes - self.most)

    def before(self, i: int) -> np.ndarray:
        rest = np.arange(self.lows[i], i)
        apart = self.roots[rest] != self.roots[i]
        if self.cross:
            apart &= self.slots[rest] != self.slots[i]
        rest = rest[apart]
        if self.turns is not None:
            rest = self.turns.of(i, rest)
        # an edit leaves all but one word in common, so fewer common words mean too many edits
        common = np.minimum(self.bins[rest], self.bins[i]).sum(axis=1, dtype=np.int64)
        return rest[common >= self.sizes[i] - self.most[i]]


def _may_link(similarity: float):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        """The rows of a block or two that may link with one of another component, by lengths and bins."""
        f = f.sort_values("size", kind="stable")
        wide = f["bins"].isna().to_numpy()
        held = b"".join(b"\xff" * FEW_BINS if w else x for x, w in zip(f["bins"], wide, strict=True))
        bins = np.frombuffer(held, dtype=np.uint8).reshape(len(f), FEW_BINS)
        reach = _Reach(f, f["size"].to_numpy(np.int64), bins, similarity)
        stays = wide.copy()
        for i in range(1, len(f)):
            if wide[i]:
                stays[reach.lows[i] : i] = True  # its bins tell nothing
                continue
            found = reach.before(i)
            if len(found):
                stays[i] = True
                stays[found] = True
        if wide.any():
            for i in np.flatnonzero(wide).tolist():
                stays[i : np.searchsorted(reach.lows, i, "right")] = True
        return f.loc[stays].drop(columns=["size", "bins"])

    return run


def _between_components(similarity: float):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        """Links between different components of one block or of two; at most one for each two that meet."""
        codes = _Codes()
        f = f.assign(codes=[codes.of(w) for w in f["words"]])
        f = f.assign(length=f["codes"].map(len)).sort_values("length", kind="stable")
        words, nodes, roots = f["codes"].tolist(), f["node"].tolist(), f["root"].to_numpy()
        bins = np.stack([np.bincount(w % BINS, minlength=BINS) for w in words]).astype(np.int32)
        reach = _Reach(f, f["length"].to_numpy(), bins, similarity)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        links = []
        for i in range(1, len(f)):
            for j in reach.before(i).tolist():
                a, b = root(int(roots[i])), root(int(roots[j]))
                if a != b and alike(words[i], words[j], similarity):
                    parent[max(a, b)] = min(a, b)
                    links.append((nodes[i], nodes[j]))
        return pd.DataFrame(links, columns=["u", "v"])

    return run


def _verdicts(documents: DataFrame, similarity: float) -> DataFrame:
    """``doc_id, digest, blank, least`` of every row: the first id and text of its class, null for blank texts."""
    prepared = written(_prepared(documents), "near-prepared")
    rows = written(prepared.select("doc_id", "digest", "content"), "near-rows")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    # numbered once in a written table: fewer bytes than a digest for each bucket
    nodes = written(
        prepared.filter(F.col("content").isNotNull())
        .groupBy("content")
        .agg(F.min(row).alias("least"), *[F.first(c, ignorenulls=True).alias(c) for c in ("size", "words")])
        .withColumn("node", F.monotonically_increasing_id()),
        "near-nodes",
    )
    discard(prepared)
    marks = written(_marks(nodes), "near-marks")
    # aggregates are written before they are joined back, so that the joins can split a common bucket or class
    leaders = written(
        marks.groupBy("bucket")
        .agg(F.min("node").alias("leader"), F.min_by("size", "node").alias("leader_size"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1"),
        "near-leaders",
    )
    members = written(marks.join(leaders.hint("merge"), "bucket"), "near-members")
    discard(leaders)
    discard(marks)
    longest = F.greatest("size", "leader_size")
    in_reach = F.abs(F.col("size") - F.col("leader_size")) <= F.floor(longest * (1 - similarity) + 1e-9)
    stars = written(
        members.filter(F.col("node") != F.col("leader")).filter(in_reach).select("leader", "node").distinct(), "near-stars"
    )
    links = written(_verified(stars, nodes, similarity), "near-links")
    discard(stars)
    roots = components(links)
    discard(links)
    # buckets of two have had their only pair aligned
    placed = written(
        members.filter("n > 2")
        .select("bucket", F.col("node").alias("own"), "n")
        .join(roots.hint("merge"), F.col("own") == F.col("node"), "left")
        .select("bucket", F.col("own").alias("node"), "n", F.coalesce("root", "own").alias("root")),
        "near-placed",
    )
    discard(members)
    # buckets of equal members are searched once
    mixed = written(
        placed.groupBy("bucket")
        .agg(
            F.first("n").alias("n"),
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.bit_xor(F.xxhash64("node")).alias("x1"),
            F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("x2"),
        )
        .filter("low <> high")
        .groupBy("n", "x1", "x2")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket"),
        "near-mixed",
    )
    if not mixed.isEmpty():
        opened = (
            placed.join(mixed.hint("merge"), "bucket")
            .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
            .withColumn("slot", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(
                "bucket",
                F.least("slot", "other").alias("low"),
                F.greatest("slot", "other").alias("high"),
                "node",
                "root",
                "slot",
            )
            .withColumn("cross", F.col("low") != F.col("high"))
        )
        own = placed.join(mixed.hint("merge"), "bucket").groupBy("node").agg(F.collect_list("bucket").alias("kept"))
        bins = written(_bins(nodes.join(own.hint("merge"), "node")), "near-bins")
        columns = "bucket long, low int, high int, node long, root long, slot int, cross boolean, kept binary"
        within = written(
            opened.join(bins.hint("merge"), "node").groupBy("bucket", "low", "high").applyInPandas(_may_link(similarity), columns),
            "near-within",
        )
        more = written(
            within.join(nodes.select("node", "words").hint("merge"), "node")
            .groupBy("bucket", "low", "high")
            .applyInPandas(_between_components(similarity), "u long, v long"),
            "near-more",
        )
        discard(bins)
        discard(within)
        if not more.isEmpty():
            before = roots
            roots = components(before.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))
            discard(before)
        discard(more)
    for table in (placed, mixed):
        discard(table)
    classes = written(
        nodes.select("content", "least", F.col("node").alias("own"))
        .join(roots.hint("merge"), F.col("own") == F.col("node"), "left")
        .select("content", "least", F.coalesce("root", "own").alias("root")),
        "near-classes",
    )
    discard(nodes)
    discard(roots)
    named = written(classes.groupBy("root").agg(F.min("least").alias("class_least")), "near-named")
    verdict = classes.join(named.hint("merge"), "root").select(F.col("content").alias("of"), F.col("class_least").alias("least"))
    return rows.join(verdict.hint("merge"), F.col("content") == F.col("of"), "left").select(
        "doc_id", "digest", F.col("content").isNull().alias("blank"), "least"
    )


def near_groups(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, kept`` of every row: the smallest ``doc_id`` of its class, and whether it is that one."""
    class_id = F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return (
        _verdicts(documents, similarity)
        .select("doc_id", class_id.alias("class_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
    )


def one_of_each(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class with all its columns as they were, and every blank row.

    That row has the class's smallest ``doc_id`` (null last), of several texts
    under that id the one with the smallest digest, and of rows equal in both any one.
    """
    first = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("digest").eqNullSafe(F.col("least.digest"))
    verdicts = written(
        _verdicts(documents, similarity).select("doc_id", "digest", "blank", (F.col("blank") | first).alias("stays")),
        "near-verdicts",
    )
    stay = verdicts.filter("stays")
    ids = verdicts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids["n"] == ids["d"]:
        named = stay.select(F.col("doc_id").alias("kept_id")).hint("merge")
        return documents.join(named, documents["doc_id"] == F.col("kept_id"), "left_semi")
    # ids are null or repeated: rows are told apart by their texts, too
    named = stay.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"), "blank").distinct()
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").alias("own_id"), _digest().alias("own_digest"))
    found = whole.join(
        named, F.col("own_id").eqNullSafe(F.col("kept_id")) & F.col("own_digest").eqNullSafe(F.col("kept_digest"))
    )
    once = found.filter(~F.col("blank")).dropDuplicates(["own_id", "own_digest"])
    return found.filter("blank").unionByName(once).select("row.*")
