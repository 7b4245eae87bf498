"""Removal of repeated byte strings by suffix order and longest-previous-factor arrays.

A string of ``LENGTH`` bytes is repeated if it also starts anywhere else, in its
document or another. To bring equal strings together without sorting the whole
corpus, every such string has an anchor that its bytes alone determine: the
smallest (leftmost of equals) hash of ``GRAM`` bytes in it. The strings that share
an anchor form one context, a few hundred bytes, and only contexts whose
anchor's hash stands twice or more in the corpus go on. Equal contexts are
counted before the shuffle, and their bytes travel once.

The contexts of an anchor hash meet in one task. Equal strings lie at equal
distances from their anchors, so the suffixes of all contexts are put in suffix
order column by column: those that start at the anchor are sorted, and each
column further left follows from the one before by a stable sort on one byte,
with the common prefixes of neighbours. In that order the previous and the next
smaller position give a suffix's longest previous factor. A factor of ``LENGTH``
says that the string stands earlier; on reversed positions, that it stands later.

An anchor with more than ``GROUP`` different contexts is dealt again by a part of
its strings' offsets and the bytes common to them, until each share is small or
holds one string only; so no passage, however common, fills one task.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing;
rows equal in text are copies, so each loses all strings (``repeated_bytes``) or
all but those of the smallest ``doc_id`` stay untouched (``keep_first_copies``; rows
that share id and text are first copies each, and a null id comes after all
others); ids may be of any type that has an order; an empty table gives an empty
table. Texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.llm.shared import discard, written
from findery.llm.vocab import release

LENGTH = 200
GRAM = 50
#: Different contexts of one anchor hash that are solved together.
GROUP = 2000
#: Bytes of contexts that one suffix order takes, and of text that one pass of anchors takes.
BATCH_BYTES = 4 << 20
SEGMENT = 1 << 19
#: Texts that a task remembers, so that copies don't carry their anchors and bytes along.
REMEMBERED = 200_000
_POSITION = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if not _POWERS:
        size = SEGMENT + LENGTH + 1
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                power = np.full(size, base, dtype=np.uint64)
                power[0] = 1
                _POWERS.append(np.multiply.accumulate(power))
    return _POWERS[0], _POWERS[1]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each ``gram`` bytes, by a rolling polynomial and a finishing mix."""
    n = len(data) - gram + 1
    up, down = _powers()
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
        h = (sums[gram:] - sums[:n]) * down[:n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, position, first and last string start of every anchor; each string belongs to one.

    Long texts are cut into segments that overlap by ``length - 1`` bytes; an
    anchor at a cut is then two contexts of the same hash, each with strings of its own.
    """
    found = []
    for start in range(0, max(1, len(data) - length + 1), SEGMENT - length):
        own = data[start : start + SEGMENT - 1]
        if len(own) < length:
            continue
        h = gram_hashes(own, gram)
        keys = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
        window, least, span = length - gram + 1, keys, 1
        while 2 * span <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < window:
            least = np.minimum(least[: len(least) - (window - span)], least[window - span :])
        at = (least & _POSITION).astype(np.int64)
        edges = np.flatnonzero(np.diff(at)) + 1
        first = np.concatenate(([0], edges))
        last = np.concatenate((edges, [len(at)])) - 1
        places = at[first]
        found.append((h[places], places + start, first + start, last + start))
    if not found:
        return tuple(np.zeros(0, dtype=np.uint64 if i == 0 else np.int64) for i in range(4))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _previous(positions: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix, in suffix order, with the nearest before it that has a smaller position.

    ``common`` is each suffix's common prefix with the one before; 0 where there is no smaller position.
    """
    link = np.arange(len(positions)) - 1
    reach = common.copy()
    open_ = np.flatnonzero((link >= 0) & (reach > 0))
    while len(open_):
        open_ = open_[positions[link[open_]] > positions[open_]]
        over = link[open_]
        reach[open_] = np.minimum(reach[open_], reach[over])
        link[open_] = link[over]
        ended = link[open_] < 0
        reach[open_[ended]] = 0
        open_ = open_[~ended & (reach[open_] > 0)]
    return reach


def previous_factors(positions: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in suffix order: the longer match of previous and next smaller position."""
    if not len(positions):
        return common.copy()
    behind = np.concatenate((common[1:], [0]))[::-1]
    return np.maximum(_previous(positions, np.concatenate(([0], common[1:]))), _previous(positions[::-1], behind)[::-1])


def columns_in_suffix_order(groups: np.ndarray, contexts: list[bytes], anchors_at: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(offset, order, common)`` of the suffixes that start ``offset`` bytes before their context's anchor.

    ``order`` are context numbers, by group and then by suffix; ``common`` is the
    length that a suffix shares with the one before in its group, 0 for a group's first.
    """
    n = len(contexts)
    right = [c[a:] for c, a in zip(contexts, anchors_at, strict=True)]
    at, sizes = np.array(anchors_at, dtype=np.int64), np.array([len(r) for r in right])
    numbers = groups.tolist()
    order = np.array(sorted(range(n), key=lambda i: (numbers[i], right[i])), dtype=np.int64)
    # the bytes from the anchor on, and those before it from the anchor leftwards
    ahead = _matrix(right, int(sizes.max(initial=0)))
    before = _matrix([c[:a][::-1] for c, a in zip(contexts, anchors_at, strict=True)], int(at.max(initial=0)))
    x, y = order[:-1], order[1:]
    differ = ahead[x] != ahead[y]
    alike = np.where(differ.any(axis=1), differ.argmax(axis=1), ahead.shape[1])
    common = np.zeros(n, dtype=np.int64)
    common[1:] = np.where(groups[x] == groups[y], np.minimum(alike, np.minimum(sizes[x], sizes[y])), 0)
    yield 0, order, common
    for offset in range(1, int(at.max(initial=0)) + 1):
        stay = at[order] >= offset
        if not stay.all():
            kept = np.flatnonzero(stay)
            if len(kept) > 1:
                low = np.minimum.reduceat(common[: kept[-1] + 1], kept[:-1] + 1)
                common = np.concatenate(([0], low))
            else:
                common = np.zeros(len(kept), dtype=np.int64)
            order = order[kept]
        keys = groups[order] << 8 | before[order, offset - 1]
        new = np.zeros(len(order), dtype=np.int64)
        if (keys[1:] >= keys[:-1]).all():
            new[1:] = np.where(keys[1:] == keys[:-1], common[1:] + 1, 0)
        else:
            place = np.argsort(keys, kind="stable")
            order, keys = order[place], keys[place]
            same = np.flatnonzero(keys[1:] == keys[:-1])
            # the least common prefix between two suffixes of the column before
            spans = np.stack([place[same] + 1, place[same + 1] + 1], axis=1).ravel()
            if len(spans):
                new[same + 1] = np.minimum.reduceat(np.append(common, 0), spans)[::2] + 1
        common = new
        yield offset, order, common


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(rows), max(1, width)), dtype=np.uint8)
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.frombuffer(b"".join(rows), dtype=np.uint8)
    owner = np.repeat(np.arange(len(rows)), sizes)
    out[owner, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def longest_previous_factors(data: bytes) -> list[int]:
    """The whole longest-previous-factor array of one text, by the same arrays as the columns'."""
    n = len(data)
    order = sorted(range(n), key=lambda i: data[i:])
    common = [0] * n
    for r in range(1, n):
        a, b = data[order[r - 1] :], data[order[r] :]
        common[r] = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out = [0] * n
    for p, length in zip(order, previous_factors(np.array(order, dtype=np.int64), np.array(common, dtype=np.int64)).tolist(), strict=True):
        out[p] = length
    return out


def _runs(mask: np.ndarray, length: int) -> list[int]:
    """Starts and ends of the bytes that the marked string starts cover, as one flat list."""
    starts = np.flatnonzero(mask)
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    begins = starts[np.concatenate(([0], gap + 1))]
    ends = starts[np.concatenate((gap, [len(starts) - 1]))] + length
    return np.stack([begins, ends], axis=1).ravel().tolist()


def _solve(
    groups: list, contexts: list[bytes], anchors_at: list[int], counts: list[int], length: int, later: bool
) -> tuple[list[list[int]], list[list[int]]]:
    """For each context, the spans of its repeated strings, and of those with an equal one in an earlier context.

    Contexts come by group and in the order that earlier means. Without
    ``later``, the first are those of contexts that stand twice or more only.
    """
    n = len(contexts)
    fresh = [i == 0 or groups[i] != groups[i - 1] for i in range(n)]
    numbers = np.cumsum(fresh).astype(np.int64)
    width = max(anchors_at, default=0) + 1
    early, late = np.zeros((n, width), dtype=bool), np.zeros((n, width), dtype=bool)
    for offset, order, common in columns_in_suffix_order(numbers, contexts, anchors_at):
        # only neighbours that share a whole string can have a factor of that length
        near = common >= length
        if not near.any():
            continue
        some = near.copy()
        some[:-1] |= near[1:]
        own, shared = order[some], np.where(near, common, 0)[some]
        early[own, offset] = previous_factors(own, shared) >= length
        if later:
            late[own, offset] = previous_factors(-own, shared) >= length
    marked = early | late
    any_early, any_marked = early.any(axis=1).tolist(), marked.any(axis=1).tolist()
    every, first = [], []
    for i, (context, at) in enumerate(zip(contexts, anchors_at, strict=True)):
        if counts[i] > 1:
            every.append([0, len(context)])
        else:
            every.append(_runs(marked[i, at::-1], length) if any_marked[i] else [])
        first.append(_runs(early[i, at::-1], length) if any_early[i] else [])
    return every, first


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _key(context: bytes, anchor: int) -> bytes:
    return hashlib.blake2b(context + anchor.to_bytes(4, "little"), digest_size=8).digest()


def packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


_PLACES = [("hash", pa.int64()), ("key", pa.int64()), ("anchor", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]


def _with_anchors(length: int, gram: int):
    """``content, doc_id`` of each row, and for the first of equal texts in a task its packed bytes and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[bytes] = set()
        for batch in batches:
            for first in range(0, batch.num_rows, 200):
                part = batch.slice(first, 200)
                rows = []
                for content, text in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if content in seen:
                        rows.append([None] * 6)
                        continue
                    seen.add(content)
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    h, at, low, high = anchors(np.frombuffer(raw, dtype=np.uint8), length, gram)
                    at = (at - low).tolist()
                    low, high = low.tolist(), high.tolist()
                    keys = b"".join(_key(raw[i : j + length], a) for a, i, j in zip(at, low, high, strict=True))
                    rows.append((packed(raw), h.view(np.int64), np.frombuffer(keys, dtype="<i8"), at, low, high))
                if len(seen) > REMEMBERED:
                    seen.clear()
                kinds = [pa.binary(), *[pa.list_(kind) for _, kind in _PLACES]]
                columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *columns], ["content", "doc_id", "raw", *[name for name, _ in _PLACES]]
                )

    return run


def _content() -> Column:
    """The SHA-256 of a text's bytes, of nothing for null."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def _cut_contexts(length: int):
    """The contexts that a text is the first reference of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, places = unpacked(batch.column(0)[i].as_py()), batch.column(1)[i].values
                low, high = places.field("low").to_pylist(), places.field("high").to_pylist()
                contexts = [raw[a : b + length] for a, b in zip(low, high, strict=True)]
                names = ["hash", "key", "anchor", "times", "rank"]
                yield pa.RecordBatch.from_arrays(
                    [*[places.field(name) for name in names], pa.array(contexts, pa.binary())], [*names, "context"]
                )

    return run


def _split(step: int, length: int):
    """Deals the strings of a context by ``offset // step`` of their anchor and the bytes common to that share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            rows: list[int] = []
            for number, row in enumerate(batch.drop_columns(["rank"]).to_pylist()):
                context, anchor = row["context"], row["anchor"]
                strings = len(context) - length + 1
                # offset of the string that starts at s: anchor - s
                for share in range((anchor - strings + 1) // step, anchor // step + 1):
                    least, most = share * step, share * step + step - 1
                    low, high = max(0, anchor - most), min(strings - 1, anchor - least)
                    if low > high:
                        continue
                    core = context[anchor - least : anchor - most + length]
                    piece = context[low : high + length]
                    group = _digest(row["grp"] + share.to_bytes(4, "little") + core)
                    key = _digest(piece + (anchor - low).to_bytes(4, "little"))
                    rows.append(number)
                    for column, value in zip(
                        out, (row["hash"], row["key"], row["shift"] + low, group, key, piece, anchor - low), strict=True
                    ):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32()]
            names = ["hash", "key", "shift", "grp", "part_key", "context", "anchor", "rank"]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("rank").take(pa.array(rows, pa.int64()))], names)

    return run


def _solved(length: int, later: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows ``grp, part_key, context, anchor, times, rank`` come by group and rank; whole groups are solved up to a size."""
        held: list[tuple] = []
        kept: list[pa.RecordBatch] = []  # columns that answers repeat
        size = 0

        def flush() -> pa.RecordBatch:
            groups, contexts, at, counts = zip(*held, strict=True)
            every, first = _solve(groups, contexts, at, counts, length, later)
            columns = [pa.concat_arrays([k.column(i) for k in kept]) for i in range(4)]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(every, pa.list_(pa.int32())), pa.array(first, pa.list_(pa.int32()))],
                ["grp", "part_key", "least", "times", "every", "early"],
            )

        for batch in batches:
            begun = 0
            answers = batch.select(["grp", "part_key", "rank", "times"])
            for number, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("grp", "context", "anchor", "times")), strict=True)):
                if size >= BATCH_BYTES and row[0] != held[-1][0]:
                    kept.append(answers.slice(begun, number - begun))
                    yield flush()
                    held, kept, size, begun = [], [], 0, number
                held.append(row)
                size += len(row[1])
            kept.append(answers.slice(begun))
        if held:
            yield flush()

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for low, high in spans:
        kept.append(raw[at:low])
        at = high
    kept.append(raw[at:])
    return b"".join(kept)


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``content, first_id, copies`` of each text; ``removed, spans, rest_sha, rest`` of one that has spans, else null."""
    for part in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
        rows = []
        for data, pieces in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
            if pieces is None:
                rows.append((None, None, None, None))
                continue
            raw = unpacked(data)
            spans = _union(
                [(p["low"] + a, p["low"] + b) for p in pieces for a, b in zip(p["spans"][::2], p["spans"][1::2], strict=True)]
            )
            rest = _without(raw, spans)
            rows.append((len(raw) - len(rest), len(spans), hashlib.sha256(rest).digest(), rest.decode("utf-8", "ignore")))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.string()]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        names = ["content", "first_id", "copies", "removed", "spans", "rest_sha", "rest"]
        yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), *columns], names)


def _answers(parts: DataFrame, length: int, later: bool) -> DataFrame:
    """``grp, part_key, least, times, every, early`` of ``parts(grp, part_key, context, anchor, times, rank)``."""
    kind = {f.name: f.dataType.simpleString() for f in parts.schema}
    return (
        parts.select("grp", "part_key", "context", "anchor", "times", "rank")
        .repartition("grp")
        .sortWithinPartitions("grp", "rank")
        .mapInArrow(
            _solved(length, later),
            f"grp {kind['grp']}, part_key {kind['part_key']}, least {kind['rank']}, times long, every array<int>, early array<int>",
        )
    )


def _split_answers(work: DataFrame, length: int, gram: int, later: bool, tables: list[DataFrame]) -> DataFrame:
    """``hash, key, first_rank, times, every, early`` of the contexts of anchors that have more than ``GROUP``.

    ``tables`` gets what it wrote.
    """
    rank_type = work.schema["rank"].dataType.simpleString()
    times = work.select("hash", "key", "times")
    parts = work.select(
        "hash",
        "key",
        F.lit(0).alias("shift"),
        F.unhex(F.lpad(F.hex("hash"), 16, "0")).alias("grp"),
        F.unhex(F.lpad(F.hex("key"), 16, "0")).alias("part_key"),
        "context",
        "anchor",
        "rank",
    )
    schema = f"hash long, key long, shift int, grp binary, part_key binary, context binary, anchor int, rank {rank_type}"
    step, done = length - gram + 1, []
    while step > 1:
        large = parts.groupBy("grp").agg(F.count_distinct("part_key").alias("n")).filter(F.col("n") > GROUP).select("grp")
        large = written(large, "suffix-large")
        if large.isEmpty():
            break
        step = -(-step // 2)
        done.append(parts.join(large, "grp", "left_anti"))
        parts = written(parts.join(large, "grp", "left_semi").mapInArrow(_split(step, length), schema), "suffix-parts")
        tables.append(parts)
    for one in done:
        parts = one.unionByName(parts)
    shared = (
        parts.join(times.hint("merge"), ["hash", "key"])
        .groupBy("grp", "part_key")
        .agg(
            F.first("context").alias("context"),
            F.first("anchor").alias("anchor"),
            F.sum("times").alias("times"),
            F.min("rank").alias("rank"),
        )
    )
    answers = written(_answers(shared, length, later), "suffix-part-answers")
    tables.append(answers)
    # contexts may share a part: only the first of them holds its first copy
    moved = [F.transform(c, lambda x: x + F.col("shift")).alias(c) for c in ("every", "early")]
    early = F.when(F.col("rank") == F.col("least"), F.col("early")).otherwise(F.col("every")).alias("early")
    return (
        parts.select("hash", "key", "shift", "grp", "part_key", "rank")
        .join(answers.drop("times").hint("merge"), ["grp", "part_key"])
        .select("hash", "key", F.col("rank").alias("first_rank"), "shift", "every", early)
        .select("hash", "key", "first_rank", *moved)
        .join(times.hint("merge"), ["hash", "key"])
        .select("hash", "key", "first_rank", "times", "every", "early")
    )


def _results(documents: DataFrame, later_only: bool, length: int, gram: int) -> DataFrame:
    """Distinct texts with their first id and copies, and what is left of those that lose bytes."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    lists = ", ".join(f"{name} array<{'long' if kind == pa.int64() else 'int'}>" for name, kind in _PLACES)
    found = documents.select(_content().alias("content"), "doc_id", "text").mapInArrow(
        _with_anchors(length, gram), f"content binary, doc_id {id_type}, raw binary, {lists}"
    )
    fields = [name for name, _ in _PLACES]
    # texts are numbered once in a written table: fewer bytes than a digest for each anchor
    texts = written(
        found.groupBy("content")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.count(F.lit(1)).alias("copies"),
            *[F.first(c, ignorenulls=True).alias(c) for c in ("raw", *fields)],
        )
        .withColumn("tid", F.monotonically_increasing_id()),
        "suffix-texts",
    )
    # the order that "earlier" means: by first id, then by text and place
    first = [F.col("first_id").isNull().alias("no_id"), "first_id", "content"] if later_only else []
    placed = texts.select("tid", *first, F.explode(F.arrays_zip(*fields)).alias("a")).select(
        "tid", *[c if isinstance(c, str) else "no_id" for c in first], "a.*"
    )
    # written, so that the joins deal their sides anew and can split the anchors of a common passage
    repeated = written(
        placed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "suffix-repeated"
    )
    references = written(placed.join(repeated.hint("merge"), "hash", "left_semi"), "suffix-references")
    discard(repeated)
    rank = F.struct(*(["no_id", "first_id", "content"] if later_only else ["tid"]), "low")
    # equal contexts are counted by their keys; their bytes travel once, from the first reference
    place = F.struct(rank.alias("rank"), "tid", "low", "high", "anchor")
    firsts = references.groupBy("hash", "key").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first"))
    chosen = firsts.groupBy(F.col("first.tid").alias("tid")).agg(
        F.collect_list(
            F.struct(
                "hash",
                "key",
                F.col("first.anchor").alias("anchor"),
                F.col("first.low").alias("low"),
                F.col("first.high").alias("high"),
                "times",
                F.col("first.rank").alias("rank"),
            )
        ).alias("places")
    )
    rank_type = references.select(rank.alias("rank")).schema["rank"].dataType.simpleString()
    work = written(
        texts.select("tid", "raw")
        .join(chosen.hint("merge"), "tid")
        .select("raw", "places")
        .mapInArrow(_cut_contexts(length), f"hash long, key long, anchor int, times long, rank {rank_type}, context binary"),
        "suffix-work",
    )
    large = written(
        work.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP).select("hash"), "suffix-hot"
    )
    common, tables = not large.isEmpty(), [references, work, large]
    whole = work.join(large, "hash", "left_anti") if common else work
    answers = _answers(whole.withColumnRenamed("hash", "grp").withColumnRenamed("key", "part_key"), length, not later_only)
    answers = answers.select(
        F.col("grp").alias("hash"), F.col("part_key").alias("key"), F.col("least").alias("first_rank"), "times", "every", "early"
    )
    if common:
        answers = answers.unionByName(_split_answers(work.join(large, "hash", "left_semi"), length, gram, not later_only, tables))
    if later_only:
        # only the first reference of a context can hold first copies
        answers = answers.filter((F.col("times") > 1) | (F.size("early") > 0))
    else:
        answers = answers.filter(F.size("every") > 0)
    hits = references.join(answers.hint("merge"), ["hash", "key"])
    if later_only:
        spans = F.when(rank == F.col("first_rank"), F.col("early")).otherwise(F.col("every"))
    else:
        spans = F.col("every")
    per_text = (
        hits.select("tid", "low", spans.alias("spans"))
        .filter(F.size("spans") > 0)
        .groupBy("tid")
        .agg(F.collect_list(F.struct("low", "spans")).alias("pieces"))
    )
    # all texts in one table, so that the rows' join with it can split a text that very many rows share
    left = written(
        texts.select("tid", "content", "first_id", "copies", "raw")
        .join(per_text.hint("merge"), "tid", "left")
        .select("content", "first_id", "copies", F.when(F.col("pieces").isNotNull(), F.col("raw")).alias("raw"), "pieces")
        .mapInArrow(
            _remaining,
            f"content binary, first_id {id_type}, copies long, removed long, spans long, rest_sha binary, rest string",
        ),
        "suffix-left",
    )
    for table in (*tables, texts):
        discard(table)
    return left


def repeated_bytes(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``: every byte in a string that also starts elsewhere goes."""
    facts = _results(documents, False, length, gram).drop("rest").withColumnRenamed("content", "of")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = documents.select("doc_id", n_bytes, _content().alias("content"))
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return rows.join(facts.hint("merge"), rows["content"] == facts["of"]).select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest()))
        .otherwise(F.lower(F.hex(F.coalesce("rest_sha", "content"))))
        .alias("kept_sha256"),
    )


def keep_first_copies(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents without later copies of repeated strings; the first of each, by ``doc_id`` and place, stays.

    A cut inside a character drops the character's other bytes too. Texts that
    are left empty stay as rows; ``n_chars``, if there, counts what is left.
    """
    changed = _results(documents, True, length, gram).select(F.col("content").alias("of"), "first_id", "copies", "rest")
    changed = changed.filter((F.col("copies") > 1) | F.col("rest").isNotNull())
    # the documents are one column, so that no name of theirs clashes
    whole = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), _content().alias("content"))
    later = ~F.col("row.doc_id").eqNullSafe(F.col("first_id")) & (F.octet_length("row.text") >= length)
    text = (
        F.when(F.col("of").isNull(), F.col("row.text"))
        .when((F.col("copies") > 1) & later, F.lit(""))
        .otherwise(F.coalesce("rest", "row.text"))
    )
    out = whole.join(changed.hint("merge"), F.col("content") == F.col("of"), "left").withColumn("left_text", text)
    columns = [
        F.col("left_text").alias("text")
        if n == "text"
        else F.length("left_text").cast(documents.schema["n_chars"].dataType).alias("n_chars")
        if n == "n_chars"
        else F.col(f"row.`{n}`").alias(n)
        for n in documents.columns
    ]
    return out.select(*columns)
