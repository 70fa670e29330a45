"""Encodings: ranks, bins, codes, row weights and bands.

Codes come from a table of the column's distinct values, joined back, never from a window over all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.profile import level_counts
from lodestone.operators.ranks import quantiles, running
from lodestone.storage import MOST_BROADCAST


def coded(df: DataFrame, column: str, out: str, start: int = 0, null_code: int | None = None) -> DataFrame:
    """out: place of the value among the sorted distinct values, from `start`; null_code for null.

    Up to MOST_BROADCAST distinct values are numbered in one task, more of them by ranges; they are joined back by
    Spark's choice of join.
    """
    values = df.select(F.col(column).alias("_value")).dropna().distinct()
    if values.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        place = F.row_number().over(Window.orderBy("_value"))
    else:
        values, place = running(values.withColumn("_one", F.lit(1)), "_value", "_one"), F.col("c")
    numbered = values.select("_value", (place - 1 + start).cast("int").alias("_code"))
    joined = df.join(numbered, df[column] == numbered["_value"], "left")
    return joined.withColumn(out, F.coalesce("_code", F.lit(null_code)) if null_code is not None else F.col("_code")).drop("_value", "_code")


def _bin(x: Column, edges: list[float]) -> Column:
    """Number of the right-closed bin between edges, the lowest edge included; null outside."""
    inner = [F.when(x > e, 1).otherwise(0) for e in edges[1:-1]]
    code = sum(inner, F.lit(0)) if inner else F.lit(0)
    return F.when((x >= edges[0]) & (x <= edges[-1]), code).cast("double")


def quantile_edges(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Exact quantiles at i/bins of each column, without repeats."""
    return {c: sorted(set(quantiles(df, c, [i / bins for i in range(bins + 1)]))) for c in columns}


def quantile_binned(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Columns of more than `bins` values become quantile bins from 0, others ranks from 1; all-null columns stay."""
    counts = level_counts(df, columns, bins)
    many = [c for c in columns if counts[c] > bins]
    edges = quantile_edges(df, many, bins) if many else {}
    for c in columns:
        if c in edges:
            df = df.withColumn(c, _bin(F.col(c).cast("double"), edges[c]))
        elif counts[c]:
            df = coded(df, c, "_bin", start=1).withColumn(c, F.col("_bin").cast("double")).drop("_bin")
    return df


def width_binned(df: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """Bins of equal width from 0; the lowest edge is moved down by a thousandth of the range."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in columns for k, f in (("low", F.min), ("high", F.max))]).first()
    for c in columns:
        low, high = row[f"low_{c}"], row[f"high_{c}"]
        if low is not None:
            step = (high - low) / bins or 1.0 / bins
            edges = [low - 0.001 * (high - low or 1.0), *[low + step * i for i in range(1, bins)], max(high, low + step * bins)]
            df = df.withColumn(c, _bin(F.col(c).cast("double"), edges))
    return df


def row_weights(df: DataFrame, entity: str, out: str = "weight") -> DataFrame:
    """1 / rows of the entity. Counts are joined back, so that a large entity is never one task's window."""
    counts = df.groupBy(entity).agg(F.count("*").alias("_n"))
    return df.join(counts, entity).withColumn(out, 1.0 / F.col("_n")).drop("_n")


def unit_bands(df: DataFrame, columns: list[str], bands: int = 4) -> DataFrame:
    """column, band, low, high: ranges between the distinct quantiles of each column."""
    rows = [(c, i, lo, hi) for c, edges in quantile_edges(df, columns, bands).items() for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    return df.sparkSession.createDataFrame(rows, "column string, band int, low double, high double")


def unit_search(df: DataFrame, levels: dict[str, str] | None = None, bands: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Rows that have the levels (compared as texts) and lie in the bands (both ends included)."""
    for c, v in (levels or {}).items():
        df = df.where(F.col(c).cast("string") == v)
    for c, (low, high) in (bands or {}).items():
        df = df.where(F.col(c).between(low, high))
    return df
