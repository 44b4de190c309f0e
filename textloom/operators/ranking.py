"""Ranks and running sums inside groups of any size.

A window over a group runs in one task, and one group may hold a third of all
rows.  Here a group is cut by ranges of the ordering hash; counts (or sums) of
the ranges are small, their running totals give each range its start, and only
the rows of one range are sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from textloom.session import cut


def seeded_hash(seed: int, *columns: str | Column) -> Column:
    """A 64-bit hash of the columns that depends on the seed alone."""
    return F.xxhash64(F.lit(seed), *columns)


def _range_of(order: Column, bits: int) -> Column:
    """Top bits of the hash, as signed longs order them."""
    return F.shiftright(order, 64 - bits)


def _met(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the start of their range; null keys are equal to each other."""
    other = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r2"), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_range") == F.col("_r2")]
    return rows.join(other, reduce(lambda a, b: a & b, same)).drop(*[f"_k{i}" for i in range(len(keys))], "_r2")


def spread_rank(df: DataFrame, keys: list[str], order: str, tie: str, *, out: str = "rank", bits: int = 12) -> DataFrame:
    """Row number (from 1) within ``keys`` by the long column ``order``, then ``tie``.

    The result is that of ``row_number`` over the whole group.
    """
    ranged = df.withColumn("_range", _range_of(F.col(order), bits))
    totals = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_range").orderBy(order, tie)
    return _met(ranged.withColumn("_at", F.row_number().over(inside)), totals, keys).withColumn(out, F.col("_before") + F.col("_at")).drop("_range", "_before", "_at")


def spread_running_sum(df: DataFrame, keys: list[str], order: str, tie: str, value: str, *, out: str = "running", bits: int = 12) -> DataFrame:
    """Sum of ``value`` over the rows before each row (exclusive), within ``keys`` by ``order``, then ``tie``."""
    ranged = df.withColumn("_range", _range_of(F.col(order), bits))
    totals = ranged.groupBy(*keys, "_range").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_range").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_at", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return _met(local, totals, keys).withColumn(out, F.col("_before") + F.col("_at")).drop("_range", "_before", "_at")


def ordered_rank(df: DataFrame, keys: list[str], order: list[str], *, out: str = "rank", value: str | None = None) -> DataFrame:
    """Row number (from 1) within ``keys`` by any order; with ``value`` the sum of it over the rows before each row.

    The rows are cut into ranges of (keys, order) by a sampled range partitioning,
    written once so that the ranges are settled, and numbered as above.  Orders
    must be unique within the keys for a settled result.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_range").agg((F.sum(value) if value else F.count("*")).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    here = F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if value else F.row_number().over(inside)
    return _met(ranged.withColumn("_at", here), totals, keys).withColumn(out, F.col("_before") + F.col("_at")).drop("_range", "_before", "_at")
