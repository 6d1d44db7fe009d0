"""Helpers the corpus operators share: shared storage, word hashing, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir
from ..ship import ship

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut lineage: write `df` to the shared folder and read it back.

    Spark's output committer makes this safe against retried tasks, and the files outlive the executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run):
    """`run` over Arrow batches, and memory given back when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def forget(spark: SparkSession) -> None:
    """Remove what `materialize` has written in the shared folder; results that were not saved elsewhere go with it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tidemark")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(at):
        fs.delete(at, True)


def bounded_batches(df: DataFrame, most: int = 8 << 20) -> DataFrame:
    """From now on Arrow batches to and from Python hold `most` bytes, not just a number of rows of any length; and the
    executors have this package's code."""
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return df


def release() -> None:
    """Give freed memory back to the system; workers live on from task to task and would keep their largest."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the input's size; it sets numbers of partitions only, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int, least: int = 2, most: int = 1 << 15) -> int:
    """A power of two of partitions, from the estimated size; `least` and `most` bound it."""
    return min(most, 1 << (max(plan_bytes(df) // bytes_each, least, 2) - 1).bit_length())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def hash_words(words: list[bytes]) -> np.ndarray:
    """A fixed 64-bit hash of each byte string."""
    if not words:
        return np.empty(0, np.uint64)
    flat = np.empty(len(words), object)
    flat[:] = words
    return pd.util.hash_array(flat, categorize=False)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def pieces(batch, column: int, most: int = 2 << 20):
    """Slices of an Arrow batch of about `most` bytes of text each, so that what Python holds is bounded by bytes."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size.astype(np.int64)) // most
    cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(size)) if len(size) else []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(int(lo), int(hi - lo))


def _stars(edges: DataFrame) -> bool:
    """Whether every node with an edge down has just one, to a node that has none."""
    down = edges.groupBy("u").agg(F.count("*").alias("n"))
    ends = down.select("u", (F.col("n") > 1).cast("int").alias("bad")).union(edges.select("v", F.lit(2)).distinct())
    return ends.groupBy("u").agg(F.sum("bad").alias("s"), F.count("*").alias("n")).where("s = 1 or n > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list of longs: (node, component), component the smallest node.

    Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond"):
    every round is a few aggregations and equi-joins, so no component is ever gathered in one place.  Nodes without
    an edge do not occur in the result."""
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(now):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are plain exchanges and AQE can split a hub's
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "stars")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
    tops = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
