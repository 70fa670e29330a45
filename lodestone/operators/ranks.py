"""Ranks, running weights and quantiles of a column, by ranges of its values: no task holds more than a range of the distinct ones."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import materialise


def running(by_value: DataFrame, x: str, w: str) -> DataFrame:
    """by_value (a row for each distinct x, none null) with c: the sum of w over the values up to and with its own.

    The values are dealt into ranges and written, so that ranges stay as they are when a task is repeated; a range's
    running sum starts at the sum of the ranges before it, of which there are as many as shuffle partitions.
    """
    dealt = materialise(by_value.repartitionByRange(x).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.sum(w).alias("_own"))
    starts = sums.select("_range", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_start"))
    inside = F.sum(w).over(Window.partitionBy("_range").orderBy(x))
    return dealt.join(F.broadcast(starts), "_range").withColumn("c", F.col("_start") + inside).drop("_range", "_start")


def weights_by_value(df: DataFrame, x: str, w: str | None = None) -> DataFrame:
    """x (as double, nulls left out), w: the weight, or number of rows, of each distinct value."""
    rows = df.where(F.col(x).isNotNull())
    return rows.groupBy(F.col(x).cast("double").alias("x")).agg((F.sum(w) if w else F.count("*")).alias("w"))


def quantiles(df: DataFrame, x: str, at: list[float]) -> list[float]:
    """Exact quantiles, interpolated between neighbours; none of a column without values."""
    table = running(weights_by_value(df, x), "x", "w")
    n = table.agg(F.max("c")).first()[0]
    if not n:
        return []
    places = [(n - 1) * q for q in at]
    wanted = sorted({k for p in places for k in (floor(p), ceil(p))})
    row = table.agg(*[F.min(F.when(F.col("c") > k, F.col("x"))) for k in wanted]).first()
    value = dict(zip(wanted, row, strict=True))

    def between(p: float) -> float:
        low, high = floor(p), ceil(p)
        return value[low] if value[low] == value[high] else (high - p) * value[low] + (p - low) * value[high]

    return [between(p) for p in places]
