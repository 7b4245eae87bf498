"""Helpers that every operator of this subpackage uses: the shared folder and written tables."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from findery.sources.folders import shared_dir

def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/findery/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    Cuts lineage: what follows never recomputes ``df``, and a lost executor
    costs only the tasks it ran.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._findery_path = path
    return out


#: Seconds between two garbage collections of the driver that free shuffle files.
COLLECT_EVERY = 5.0
_collected = 0.0


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``written`` table that nothing reads any more, and shuffles that made such tables.

    Executors keep the files of a shuffle until the driver collects the plan that
    made it as garbage, which a driver with little to do puts off.
    """
    global _collected
    path = getattr(df, "_findery_path", None)
    if path:
        delete_path(df.sparkSession, path)
    if time.monotonic() - _collected > COLLECT_EVERY:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def pieces_of(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose values of a text or binary column have about ``most`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, first = np.cumsum(sizes.astype(np.int64)), 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
