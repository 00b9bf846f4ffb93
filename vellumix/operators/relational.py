"""Relational operators that the corpus queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


#: Rows of a narrow table that may be broadcast: about 16 MB.
BROADCAST_ROWS = 500_000


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if the (narrow) table has at most limit rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def optional_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters; a parameter that is None filters nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of old with the columns that new supplies (not null) replaced, and rows of new that old lacks."""
    others = [c for c in old.columns if c not in keys]
    fresh = new.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in others if c in new.columns))
    out = old.join(fresh, list(keys), "full_outer")
    return out.select(*keys, *(F.coalesce(f"__new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in others))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key, by an aggregate that combines on the map side; order must tell all rows of a key apart."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank; Spark cuts groups to k before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def positions(df: DataFrame, order: Sequence[str], name: str = "pos", buckets: int = 64) -> DataFrame:
    """Global positions from 1 in the given order, without one task that sorts all rows. The order must tell all rows apart.

    Rows are range-partitioned and sorted once, and written with their range's number and their place in it: planned
    twice, the ranges would be sampled anew and might have other bounds. A pass over the written numbers adds the counts
    of the ranges before, of which there are few.
    """
    rows, before = _ranges(df, order, buckets, F.lit(1))
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__i")).drop("__part", "__i", "__before")


def _ranges(df: DataFrame, order: Sequence[str], buckets: int, weight: Column) -> tuple[DataFrame, DataFrame]:
    """df with __part and __i (from 1), its range and its place in it, written once; and (__part, __before), the weight
    of the rows of the ranges before."""
    place = F.monotonically_increasing_id()  # number of the partition, then of the row in it
    rows = cut(df.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn("__place", place))
    rows = rows.withColumn("__part", F.shiftright("__place", 33)).withColumn("__i", F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__place")
    sums = rows.groupBy("__part").agg(F.sum(weight.cast("long")).alias("__s"))
    return rows, sums.select("__part", (F.sum("__s").over(Window.orderBy("__part")) - F.col("__s")).alias("__before"))


def average_rank(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """Ranks of all values, ties sharing their mean rank: from the counts of distinct values, not by sorting all rows.

    The ranks are joined back by value; a value that very many rows share is split by adaptive execution, and is met by
    one row of the other side. For sums over ranks use the counts (``value_ranks``), which join nothing.
    """
    ranked = value_ranks(df.where(F.col(value).isNotNull()), value)
    return df.join(ranked.select(value, F.col("rank").alias(name)), value)


def value_ranks(df: DataFrame, value: str, others: Sequence[str] = ()) -> DataFrame:
    """value, n, rank of the distinct values (with n rows each), and the counts of each value by ``others`` as c in cells:
    an array of (others..., c)."""
    counts = df.groupBy(*others, value).agg(F.count("*").alias("c"))
    cells = counts.groupBy(value).agg(F.sum("c").alias("__n"), F.collect_list(F.struct(*others, "c")).alias("cells"))
    return positions_of_groups(cells, value).select(value, F.col("__n").alias("n"), (F.col("__before") + (F.col("__n") + 1) / 2).alias("rank"), "cells")


def positions_of_groups(counts: DataFrame, value: str, buckets: int = 32, within: Sequence[str] = ()) -> DataFrame:
    """Adds __before, the rows with lower values (of the same ``within``), to (within..., value, __n, ...)."""
    rows, before = _ranges(counts, [*within, value], buckets, F.col("__n"))
    inside = Window.partitionBy("__part").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("__n").over(inside), F.lit(0))).join(F.broadcast(before.withColumnRenamed("__before", "__base")), "__part")
    rows = rows.withColumn("__before", F.col("__base") + F.col("__in")).drop("__part", "__i", "__in", "__base")
    if not within:
        return rows
    rows = cut(rows)
    first = rows.groupBy(*within).agg(F.min("__before").alias("__first"))
    return rows.join(checked_broadcast(first), list(within)).withColumn("__before", F.col("__before") - F.col("__first")).drop("__first")


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lo: str, hi: str, point: str, width: int) -> DataFrame:
    """Rows of left whose point lies within [lo, hi] of a right row of the same keys, by buckets of ``width``: an equi-join."""
    bucketed = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    return left.withColumn("__b", F.floor(F.col(point) / width)).join(bucketed, [*keys, "__b"]).where(F.col(point).between(F.col(lo), F.col(hi))).drop("__b")


def pairs_sharing(df: DataFrame, item: str, member: str) -> DataFrame:
    """(a, b, weight): how many items two members share, a < b."""
    rows = df.select(item, member).distinct()
    a, b = rows.withColumnRenamed(member, "a"), rows.withColumnRenamed(member, "b")
    return a.join(b, item).where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def gaps_and_islands(df: DataFrame, keys: Sequence[str], order: str, flag: str) -> DataFrame:
    """Runs of rows with the flag set: keys, first, last, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__island", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w))
    return marked.where(flag).groupBy(*keys, "__island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("__island")
