"""Shared helpers: the shared folder, size-checked joins, batch-wise text access and distributed components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows of a narrow table (a few numbers each) that may be broadcast: about 16 MB.
BROADCAST_ROWS = 500_000
#: Edges (two numbers each) of which ``components`` makes one partition.
EDGES = 200_000
#: Rows of one Arrow batch, so that long texts do not meet in one batch.
BATCH_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches and makes sure that a checkpoint folder is set: the cluster's own, or in tests a local one."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_folder(spark)
    return spark


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (narrow) table has at most limit rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    col = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def slices(lengths: list[int], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths add up to about size, at least one row each."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > size:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def unsigned_to_long(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


def sweep(spark: SparkSession) -> None:
    """Has the driver look for what nothing refers to any more, so that shuffle files and checkpoints of earlier rounds go
    from the executors' disks while a long job runs, not at its end."""
    gc.collect()  # frames in cycles hold theirs
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """Connected components of (u, v) edges of longs as rows (node, component), component being the smallest node.

    Alternating large-star and small-star steps; each round is checkpointed in the shared folder, nothing is
    collected but two figures that tell whether the edges still change. Self loops and repeated edges are fine. Once there
    are at most ``EDGES`` of them, one task takes them all and nothing is shuffled.
    """
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct().checkpoint()
    last = (edges.count(),)
    for _ in range(max_rounds):
        few = last[0] <= EDGES
        together = lambda df: df.coalesce(1) if few else df  # noqa: B023, E731
        both = together(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = together(small.union(least.select("u", F.col("m").alias("v")))).distinct().checkpoint()
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            break
        last = now
        del both, low, large, least, small
        sweep(edges.sparkSession)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written as Parquet in the shared folder and read again."""
    spark = prepare(df.sparkSession)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once all that was made of it has been written itself."""
    spark = df.sparkSession
    for path in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
