"""Streams of ledger rows: first-wins appends, superseding, index upkeep, and work every so many labels.

All are file streams with ``foreachBatch``: each micro-batch is merged by key into a Parquet table of generations in the
shared folder, so a batch that is run again after a failure gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relational import first_of, latest


class Table:
    """A keyed table in generations: generation n is what batches 0 to n made of it. Older ones but the last are left to a
    cleaner, since a failed batch starts from the one before."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        self.last: int | None = None

    def read(self, generation: int | None = None) -> DataFrame | None:
        n = self.last if generation is None else generation
        return None if n is None or n < 0 else self.spark.read.parquet(f"{self.path}/g{n}")

    def write(self, df: DataFrame, generation: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/g{generation}")
        self.last = generation


def merge_stream(stream: DataFrame, table: Table, merge: Callable[[DataFrame | None, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Runs what is available of a stream, merging each micro-batch into the table."""

    def step(batch: DataFrame, n: int) -> None:
        table.write(merge(table.read(n - 1), batch), n)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_wins(keys: list[str], order: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """The first row of a key stays, whatever comes later."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new if old is None else old.unionByName(new)
        return first_of(rows, keys, [F.col(order)])

    return merge


def superseding(keys: list[str], digest: str, order: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """The last row of a key counts, but a row whose digest equals the one in force changes nothing."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        from pyspark.sql import Window

        rows = new if old is None else old.select(*new.columns).unionByName(new)
        changed = rows.withColumn("__before", F.lag(digest).over(Window.partitionBy(*keys).orderBy(order)))
        return latest(changed.where(~F.col(digest).eqNullSafe(F.col("__before"))).drop("__before"), keys, [F.col(order)])

    return merge


def postings_upkeep(key: str, tokens: str) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Postings (term, key, tf) in step with rows inserted, changed or, with null tokens, deleted."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        fresh = new.select(key, F.explode(tokens).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
        return fresh if old is None else old.join(new.select(key).distinct(), key, "left_anti").select("term", key, "tf").unionByName(fresh)

    return merge


def every(interval: int, work: Callable[[DataFrame, int], None], rows_before: Callable[[], int]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: does work whenever the count of rows passes a multiple of interval; rows_before counts those of
    earlier batches from durable state, so a repeated batch decides alike."""

    def step(batch: DataFrame, n: int) -> None:
        before = rows_before()
        if before // interval != (before + batch.count()) // interval:
            work(batch, n)

    return step


def stream(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """A stream over the Parquet files of a path, with the schema that they have now; None: all new files in one batch."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)
