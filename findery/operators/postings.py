"""Posting lists of whole batches: counted and ordered by term within a task, and summed up by document when they are checked.

No posting is shuffled. All postings of a document come from one task, so a file
of lists is a slice of the documents, in runs that are ordered by term. A row is
``term, ids, tfs, lengths``: a term's postings of one run, in id order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.functions.text import document_terms

#: Tokens or postings that a task holds at once, about, and postings of a batch that it returns.
RUN, ROWS = 1 << 22, 1 << 16
FACTS = ["id", "total", "length", "odd"]


def counted(documents: DataFrame) -> DataFrame:
    """Lists from ``id, text``; ids must be unique and not null. A null text has no tokens."""
    kind = documents.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            own = len(batch.column(1).flatten())
            if held and size + own > RUN:
                yield from _run(held)
                held, size = [], 0
            held.append(batch)
            size += own
        if held:
            yield from _run(held)

    terms = document_terms(documents.select("id", F.coalesce("text", F.lit("")).alias("text"))).select("id", "terms")
    return terms.mapInArrow(count, f"term string, ids array<{kind}>, tfs array<int>, lengths array<int>")


def rows(lists: DataFrame) -> DataFrame:
    """``id, term, tf, length`` of lists; a table that has these columns stays as it is."""
    if "ids" not in lists.columns:
        return lists.select("id", "term", "tf", "length")
    found = lists.select("term", F.inline(F.arrays_zip("ids", "tfs", "lengths")).alias("id", "tf", "length"))
    return found.select("id", "term", F.col("tf").cast("long").alias("tf"), F.col("length").cast("long").alias("length"))


def _run(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of some documents in order of terms."""
    ids = pa.concat_arrays([b.column(0) for b in batches])
    lengths = pa.concat_arrays([pc.list_value_length(b.column(1)) for b in batches]).to_numpy(zero_copy_only=False).astype(np.int64)
    words = pa.concat_arrays([b.column(1).flatten() for b in batches]).dictionary_encode()
    by_term, by_id, n = pc.array_sort_indices(words.dictionary).to_numpy(), pc.array_sort_indices(ids).to_numpy(), len(ids)
    key = _places(by_term)[words.indices.to_numpy()] * n + np.repeat(_places(by_id), lengths)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    tf, key = np.diff(first, append=len(key)), key[first]
    terms, ids, lengths = words.dictionary.take(pa.array(by_term)), ids.take(pa.array(by_id)), lengths[by_id]
    term, doc = np.divmod(key, n) if n else (key, key)
    start = np.flatnonzero(np.diff(term, prepend=-1))  # of each term's list
    cuts = np.append(np.flatnonzero(np.diff(start // ROWS, prepend=-1)), len(start))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        first, last = start[a], start[b] if b < len(start) else len(key)
        held, own = pa.array(np.append(start[a:b], last) - first, pa.int32()), doc[first:last]
        values = ids.take(pa.array(own)), pa.array(tf[first:last], pa.int32()), pa.array(lengths[own], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [terms.take(pa.array(term[start[a:b]])), *(pa.ListArray.from_arrays(held, x) for x in values)], ["term", "ids", "tfs", "lengths"]
        )


def _places(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order))
    return out


def _id_type(lists: DataFrame) -> str:
    return (lists.schema["ids"].dataType.elementType if "ids" in lists.columns else lists.schema["id"].dataType).simpleString()


def write_facts(lists: DataFrame, path: str) -> None:
    """Writes ``id, total, length, odd`` of stored lists or rows: a row for each document and run, see ``facts``."""
    kind = _id_type(lists)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            # a run ends where the order does, so that documents of different runs don't share one
            at = _falls(batch, last) if size >= RUN // 4 else None
            last = batch.slice(batch.num_rows - 1)
            if at is None and size < 4 * RUN:
                held.append(batch)
                size += len(batch.column(1).flatten())
                continue
            cut = at or 0
            if cut:
                held.append(batch.slice(0, cut))
            yield _sums(held)
            held = [batch.slice(cut)]
            size = len(held[0].column(1).flatten())
        if held:
            yield _sums(held)

    if "ids" not in lists.columns:
        lists = lists.select("term", F.array("id").alias("ids"), F.array("tf").alias("tfs"), F.array("length").alias("lengths"))
    lists.select("term", "ids", "tfs", "lengths").mapInArrow(sums, f"id {kind}, total long, length long, odd long").write.parquet(path)


def _falls(batch: pa.RecordBatch, last: pa.RecordBatch | None) -> int | None:
    """Where the first row stands whose term doesn't come after the one before."""
    terms = batch.column(0)
    before = pa.concat_arrays([last.column(0) if last is not None else terms.slice(0, 1), terms.slice(0, len(terms) - 1)])
    found = np.flatnonzero(pc.fill_null(pc.greater_equal(before, terms), True).to_numpy(zero_copy_only=False))
    return int(found[0]) if len(found) else None


def _sums(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    terms = pa.concat_arrays([b.column(0) for b in batches])
    # lists that don't fit each other have no rows to sum up
    sizes = [pa.concat_arrays([pc.list_value_length(b.column(i)) for b in batches]).fill_null(-1).to_numpy() for i in (1, 2, 3)]
    if not all((x == sizes[0]).all() for x in sizes) or (sizes[0] < 1).any():
        some = next((i for b in batches for i in b.column(1).flatten().slice(0, 1)), None)
        kind = batches[0].column(1).type.value_type
        return pa.RecordBatch.from_arrays([pa.array([some and some.as_py()], kind), *(pa.array([x], pa.int64()) for x in (0, 0, 1))], FACTS)
    ids, tf, lengths = (pa.concat_arrays([b.column(i).flatten() for b in batches]) for i in (1, 2, 3))
    at = np.repeat(np.arange(len(terms)), sizes[0])
    empty = pc.fill_null(pc.equal(terms, ""), True).to_numpy(zero_copy_only=False)[at]
    ids, terms = ids.dictionary_encode(), terms.dictionary_encode()
    n, words = len(ids.dictionary) + 1, len(terms.dictionary) + 1  # the last one is null
    own = pc.fill_null(ids.indices, n - 1).to_numpy().astype(np.int64)
    tf, lengths = (pc.fill_null(x, -1).to_numpy().astype(np.int64) for x in (tf, lengths))
    length = np.zeros(n, dtype=np.int64)
    length[own] = lengths
    odd = np.bincount(own, empty | (tf <= 0) | (lengths < 0) | (lengths != length[own]) | (own == n - 1), n)
    key = own * words + pc.fill_null(terms.indices, words - 1).to_numpy().astype(np.int64)[at]
    key.sort()
    odd += np.bincount(key[1:][key[1:] == key[:-1]] // words, minlength=n)
    held = np.flatnonzero(np.bincount(own, minlength=n))
    names = pa.concat_arrays([ids.dictionary, pa.nulls(1, ids.dictionary.type)])
    total = np.bincount(own, tf, n)
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(held)), *(pa.array(x[held].astype(np.int64)) for x in (total, length, odd))], FACTS
    )


def facts(lists: DataFrame, path: str) -> DataFrame:
    """``id, total, low, high, odd`` of lists whose facts were written: counts in all, least and greatest length, faults.

    Faults are an empty term, a count below one, lengths that differ, and a term
    that a document has twice. Postings of documents that stand in more than one
    run, if any, are looked through once more.
    """
    kind = _id_type(lists)
    runs = lists.sparkSession.read.schema(f"id {kind}, total long, length long, odd long").parquet(path)
    found = runs.groupBy("id").agg(
        F.sum("total").alias("total"), F.min("length").alias("low"), F.max("length").alias("high"), F.sum("odd").alias("odd"), F.count(F.lit(1)).alias("runs")
    )
    split = found.filter("runs > 1").select("id")
    if not split.isEmpty():
        twice = rows(lists).join(split, "id", "left_semi").groupBy("id", "term").count().filter("count > 1").groupBy("id").agg(F.count(F.lit(1)).alias("twice"))
        found = found.join(twice, "id", "left").withColumn("odd", F.col("odd") + F.coalesce("twice", F.lit(0)))
    return found.select("id", "total", "low", "high", "odd")
