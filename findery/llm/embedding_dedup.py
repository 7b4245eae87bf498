"""Near copies among embeddings: all pairs above a cosine, by cover trees and dual traversal.

Vectors that are equal in label and components are one point with a number of
copies. Points of one label fall to the nearest of some pivots; a point also
visits the cells whose ball it may reach within the threshold's distance, so
every pair of near points meets in exactly one cell and all other pairs of cells
are pruned by their covering radii. A cell's points build a cover tree (nested
levels of halving radii); a dual traversal prunes pairs of nodes by covering
radii, and the pairs left are decided by their cosine in double precision.

A task emits a count and one link for a point, never its pairs. Cells hold about
``CELL_BYTES`` of vectors and are dealt by blocks beyond that. A block's tree is
built once for ``SPAN`` blocks of visitors, which stream past it. The work between
cells grows with the pairs of cells that the data really bring within reach;
vectors without any structure have no cheaper exact join.

Defined results: a row whose label is null, or whose vector is null, zero, or
holds a null or a non-finite component, links with nothing (0 links, itself its
component, kept); vectors of different lengths don't link; equal vectors link
with each other; repeated ``vec_id`` rows count as vectors of their own; rows
with a null ``vec_id`` link, but never name a component unless alone in it; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findery.llm.cover_tree import Tree, dual
from findery.llm.graph import components
from findery.llm.shared import discard, written

COSINE = 0.93
#: Bytes of a cell's or block's vectors, which one task holds.
CELL_BYTES = 8 << 20
#: Blocks of visitors that stream past a block's tree in one task.
SPAN = 16
#: Pivots of a label at most, and bytes of all pivots; with fewer pivots, cells are dealt by more blocks.
PIVOTS = 512
PIVOT_BYTES = 32 << 20
#: Rows that a label's pivots are chosen from.
PIVOT_SAMPLE = 20_000


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label and key (of equal vectors) of each row; unit vector of valid ones, else null."""
    for batch in batches:
        keys, units = [], []
        for label, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            key = unit = None
            if label is not None and vector and None not in vector:
                v = np.array(vector, dtype=np.float64)
                if np.isfinite(v).all() and v.any():
                    v = v + 0.0  # -0.0 and 0.0 are equal
                    key = hashlib.blake2b(f"{label}:".encode() + v.tobytes(), digest_size=16).digest()
                    v = v / np.abs(v).max()
                    unit = (v / np.sqrt((v * v).sum())).tobytes()
            keys.append(key)
            units.append(unit)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(units, pa.binary())],
            ["vec_id", "label", "key", "unit"],
        )


def _choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Points far from each other: each is the farthest from those before (a cover tree's top level)."""
    chosen = [0]
    away = 2.0 - 2.0 * (sample @ sample[0])
    while len(chosen) < min(count, len(sample)):
        i = int(away.argmax())
        if away[i] <= 1e-12:
            break
        chosen.append(i)
        away = np.minimum(away, 2.0 - 2.0 * (sample @ sample[i]))
    return sample[chosen]


class _Block:
    """A block's vectors with their copies and cover tree."""

    def __init__(self, keys: list[bytes], units: list[bytes], copies: list[int]):
        self.keys = keys
        self.x = np.frombuffer(b"".join(units)).reshape(len(units), -1)
        self.weight = np.array(copies, dtype=np.int64)
        self.tree = Tree(self.x)


def _join(residents: _Block, visitors: _Block | None, cosine: float) -> pa.RecordBatch:
    """``key, links, root``: weighted links of each vector and the vector that stands for those it is linked with here.

    Without visitors the residents are joined with themselves.
    """
    same = visitors is None
    other = residents if same else visitors
    offset = 0 if same else len(residents.x)
    total = offset + len(other.x)
    links, parent = np.zeros(total, dtype=np.int64), np.arange(total)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def visit(rows: np.ndarray, cols: np.ndarray) -> None:
        near = residents.x[rows] @ other.x[cols].T >= cosine
        if same:
            near &= rows[:, None] != cols[None, :]
        if not near.any():
            return
        twice = same and (len(rows) != len(cols) or rows[0] != cols[0])
        links[rows] += near @ other.weight[cols]
        if not same or twice:
            links[offset + cols] += residents.weight[rows] @ near
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            top = root(int(rows[r]))
            for c in np.unique(parent[offset + cols[near[r]]]).tolist():
                low = root(c)
                if low != top:
                    parent[max(low, top)] = min(low, top)
                    top = min(low, top)

    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    dual(residents.tree, other.tree, reach, visit, same)
    keys = residents.keys if same else residents.keys + other.keys
    found = [(i, root(i)) for i in range(total) if links[i] or parent[i] != i]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([keys[i] for i, _ in found], pa.binary()),
            pa.array([int(links[i]) for i, _ in found], pa.int64()),
            pa.array([keys[r] for _, r in found], pa.binary()),
        ],
        ["key", "links", "root"],
    )


def _joined(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by ``home`` and ``span``, residents first, then the visitors by block."""
        task, own, guests, block = None, [], [], None
        residents: _Block | None = None

        def made(rows: list[tuple]) -> _Block:
            return _Block(*map(list, zip(*rows, strict=True)))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal residents
            if guests:
                residents = residents or made(own)
                yield _join(residents, made(guests), cosine)
                guests.clear()
            elif own and task[1] < 0:
                yield _join(made(own), None, cosine)

        for batch in batches:
            for home, span, visit, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (home, span) != task:
                    yield from flush()
                    task, own, guests, residents = (home, span), [], [], None
                if visit < 0:
                    own.append(row)
                else:
                    if guests and visit != block:
                        yield from flush()
                    guests.append(row)
                    block = visit
        yield from flush()

    return run


def _matrix(units: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(units)).reshape(len(units), -1)


def near_copies(embeddings: DataFrame, cosine: float = COSINE, cell: int | None = None) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row; ``cell`` sets the vectors of a cell."""
    spark = embeddings.sparkSession
    id_type = embeddings.schema["vec_id"].dataType.simpleString()
    label_type = embeddings.schema["label"].dataType.simpleString()
    rows = written(
        embeddings.select("vec_id", "label", "embedding").mapInArrow(
            _points, f"vec_id {id_type}, label {label_type}, key binary, unit binary"
        ),
        "vectors",
    )
    shape = F.concat_ws(":", F.col("label").cast("string"), F.octet_length("unit").cast("string"))
    points = written(
        rows.filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(
            F.min("vec_id").alias("least_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("label").alias("label"),
            F.first("unit").alias("unit"),
        )
        .withColumn("shape", shape),
        "points",
    )
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    limit = F.lit(cell) if cell else F.greatest(F.lit(256), F.floor(F.lit(CELL_BYTES) / F.col("width")))
    # the driver sees one row for each label with more than a cell of vectors
    large = [
        (r["shape"], r["width"], r["n"], r["most"])
        for r in points.groupBy("shape", F.octet_length("unit").alias("width"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("most", limit.cast("long"))
        .filter(F.col("n") > F.col("most"))
        .toLocalIterator()
    ]
    wanted = {name: min(PIVOTS, max(2, 2 * -(-n // most))) for name, _, n, most in large}
    scale = min(1.0, PIVOT_BYTES / max(1, sum(wanted[name] * width for name, width, _, _ in large)))
    most_of = {name: most for name, _, _, most in large}
    pivots: dict[str, np.ndarray] = {}
    if large:
        shares = spark.createDataFrame(
            [(name, min(1.0, 1.2 * PIVOT_SAMPLE / n), max(1, int(scale * wanted[name]))) for name, _, n, _ in large],
            "shape string, share double, pivots int",
        )

        def choose(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("key").head(PIVOT_SAMPLE)  # a bounded sample: pivots only steer the cells
            chosen = _choose_pivots(_matrix(f["unit"]), int(f["pivots"].iloc[0]))
            return pd.DataFrame({"shape": f["shape"].iloc[:1], "chosen": [chosen.tobytes()]})

        sampled = points.join(shares, "shape").filter(
            F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < F.col("share") * 1_000_000
        )
        chosen = sampled.select("shape", "key", "unit", "pivots").groupBy("shape").applyInPandas(choose, "shape string, chosen binary")
        width_of = {name: width for name, width, _, _ in large}
        for r in chosen.collect():  # PIVOT_BYTES at most
            pivots[r["shape"]] = np.frombuffer(bytes(r["chosen"])).reshape(-1, width_of[r["shape"]] // 8)

    def gaps_of(name: str, f: pd.DataFrame) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (_matrix(f["unit"]) @ pivots[name].T)))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, g in f.groupby("shape"):
                gaps = gaps_of(name, g)
                yield pd.DataFrame({"shape": name, "own": gaps.argmin(axis=1), "gap": gaps.min(axis=1)})

    radius = {name: np.full(len(p), -1.0) for name, p in pivots.items()}
    blocks = {name: np.zeros(len(p), dtype=np.int64) for name, p in pivots.items()}
    if large:
        sizes = (
            points.join(shares.select("shape"), "shape", "left_semi")
            .select("shape", "unit")
            .mapInPandas(assign, "shape string, own int, gap double")
            .groupBy("shape", "own")
            .agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n"))
        )
        for r in sizes.collect():  # a row for each pivot
            radius[r["shape"]][r["own"]] = r["radius"]
            blocks[r["shape"]][r["own"]] = -(-r["n"] // most_of[r["shape"]])

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows (home, span, visit): -1 residents, else visitors. Blocks of a large cell visit its later blocks."""
        for f in frames:
            for name, g in f.groupby("shape"):
                base = g[["key", "copies", "unit"]]
                if name not in pivots:
                    yield base.assign(home=f"{name}/0", span=-1, visit=-1)
                    continue
                gaps = gaps_of(name, g)
                own = gaps.argmin(axis=1)
                first = np.cumsum(blocks[name]) - blocks[name]
                hashes = np.array([int.from_bytes(k[:6], "little") for k in g["key"]])
                slot = hashes % blocks[name][own]
                block = first[own] + slot
                yield base.assign(home=[f"{name}/{b}" for b in block], span=-1, visit=-1)
                cells = np.arange(len(first))
                within = (own[:, None] < cells) & (gaps <= radius[name] + reach + 1e-7) & (blocks[name] > 0)
                guest, at = np.nonzero(within)
                # all blocks of the cells within reach, and the later blocks of one's own
                who = np.concatenate((guest, np.arange(len(g))))
                begin = np.concatenate((first[at], block + 1))
                count = np.concatenate((blocks[name][at], blocks[name][own] - slot - 1))
                who_all = np.repeat(who, count)
                homes = np.repeat(begin, count) + np.arange(len(who_all)) - np.repeat(np.cumsum(count) - count, count)
                if len(who_all):
                    visit = block[who_all]
                    yield base.iloc[who_all].assign(home=[f"{name}/{b}" for b in homes], span=visit // SPAN, visit=visit)

    dealt = written(
        points.select("shape", "key", "copies", "unit").mapInPandas(
            deal, "key binary, copies long, unit binary, home string, span int, visit int"
        ),
        "dealt",
    )
    residents, visitors = dealt.filter("visit < 0"), dealt.filter("visit >= 0")
    # a task for each span of visitors at a block: the residents are copied to it
    asked = visitors.select("home", F.col("span").alias("asked")).distinct()
    columns = ["home", "span", "visit", "key", "unit", "copies"]
    copied = residents.join(asked, "home").withColumn("span", F.col("asked"))
    work = residents.select(columns).unionByName(copied.select(columns)).unionByName(visitors.select(columns))
    solved = written(
        work.repartition("home", "span")
        .sortWithinPartitions("home", "span", "visit")
        .mapInArrow(_joined(cosine), "key binary, links long, root binary"),
        "solved",
    )
    discard(dealt)
    counts = solved.groupBy("key").agg(F.sum("links").alias("links"))
    comps = components(solved.select(F.col("key").alias("u"), F.col("root").alias("v")))
    named = written(
        points.join(comps, points["key"] == comps["node"], "left")
        .join(counts.withColumnRenamed("key", "count_key"), points["key"] == F.col("count_key"), "left")
        .select(
            "key",
            "least_id",
            F.coalesce("root", "key").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        ),
        "named",
    )
    for table in (points, solved, comps):
        discard(table)
    least = written(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "least-ids")
    verdicts = named.join(least, "root").select("key", "n_links", "component_id")
    return (
        rows.select("vec_id", "key")
        .join(verdicts, "key", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
