"""One-pass profiles of a table's columns, and aggregates to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEAR_UNIQUE, MAX_LEVELS = 0.9, 20
NUMERIC = (T.NumericType,)
BUCKETS = 32_768  # of a bitmap aggregate


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def long_form(df: DataFrame, entries: dict[str, dict[str, Column]]) -> DataFrame:
    """A one-row aggregate as one row for each column: `column` and the named values."""
    rows = [F.struct(F.lit(c).alias("column"), *[v.alias(k) for k, v in values.items()]) for c, values in entries.items()]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def distinct_profile(df: DataFrame, columns: list[str] | None = None, max_levels: int = MAX_LEVELS) -> DataFrame:
    """column, n_distinct (nulls left out), constant, near_unique and many_levels of each column; exact, in one job."""
    columns = columns or df.columns
    one = df.agg(F.count("*").alias("rows"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(columns)])
    n = {c: F.col(f"n_{i}") for i, c in enumerate(columns)}
    return long_form(one, {c: {"n_distinct": n[c], "is_constant": n[c] <= 1, "near_unique": n[c] >= F.greatest(F.lit(2.0), NEAR_UNIQUE * F.col("rows")), "many_levels": n[c] > max_levels} for c in columns})


def drop_constant(df: DataFrame) -> DataFrame:
    """df without columns of at most one value; the profile is as small as the list of columns."""
    return df.drop(*[r.column for r in distinct_profile(df).where("is_constant").collect()])


def _bits(df: DataFrame, column: str) -> Column:
    """Buckets that the hashes of a column's values fall into: never more than it has distinct values."""
    x = F.col(f"`{column}`")
    x = x + F.lit(0.0) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else x  # -0.0 is 0.0
    return F.bitmap_count(F.bitmap_construct_agg(F.when(x.isNotNull(), F.pmod(F.xxhash64(x), F.lit(BUCKETS)))))


def level_counts(df: DataFrame, columns: list[str], most: int, bits: dict[str, int] | None = None) -> dict[str, int]:
    """The number of distinct values of each column, exact if it is at most `most`; if not, a number above `most`.

    A bitmap of hashed values, of one size whatever the data, proves that a column has many; only the others are counted,
    which have few. `bits` are the bitmaps' counts where they are known.
    """
    if bits is None:
        row = df.agg(*[_bits(df, c).alias(f"b{i}") for i, c in enumerate(columns)]).first()
        bits = dict(zip(columns, row, strict=True))
    few = [c for c in columns if bits[c] <= most]
    row = df.agg(*[F.count_distinct(F.col(f"`{c}`")) for c in few]).first() if few else ()
    return bits | dict(zip(few, row, strict=True))


def inferred_types(df: DataFrame, columns: list[str] | None = None, max_levels: int = MAX_LEVELS, float_as_continuous: bool = True) -> DataFrame:
    """column and kind: categorical (a null, a text that is no number, or few whole levels), discrete (many whole levels) or continuous."""
    columns = columns or df.columns
    numeric, aggregates = set(numeric_columns(df)), []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double") if c in numeric else F.col(f"`{c}`").cast("string").try_cast("double")
        aggregates += [F.bool_and(x.isNotNull()).alias(f"num_{i}"), F.bool_and(x % 1 == 0).alias(f"whole_{i}"), _bits(df, c).alias(f"bits_{i}")]
    one = df.agg(*aggregates).first()
    by_levels = [c for i, c in enumerate(columns) if one[f"num_{i}"] and (one[f"whole_{i}"] or not float_as_continuous)]
    n = level_counts(df, by_levels, max_levels, {c: one[f"bits_{columns.index(c)}"] for c in by_levels})

    def kind(i: int, c: str) -> str:
        if not one[f"num_{i}"]:
            return "categorical"
        return "continuous" if c not in n else "categorical" if n[c] <= max_levels else "discrete"

    return df.sparkSession.createDataFrame([(c, kind(i, c)) for i, c in enumerate(columns)], "column string, kind string")


def numeric_ranges(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in (("low", F.min), ("high", F.max), ("mean", F.avg))])
    return long_form(one, {c: {k: F.col(f"{k}_{i}") for k in ("low", "high", "mean")} for i, c in enumerate(columns)})


def levels(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column as texts, sorted."""
    return df.select(F.col(f"`{column}`").cast("string").alias("level")).dropna().distinct().orderBy("level")


def entity_aggregate(df: DataFrame, entity: str, columns: list[str], categorical: list[str]) -> DataFrame:
    """One row for each entity: the mode (of ties the least) of categorical columns, the mean of others; nulls left out."""
    return df.groupBy(entity).agg(*[(F.mode(c, True) if c in categorical else F.avg(c)).alias(c) for c in columns])


def distribution(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """level and p: shares of the rows, or of the weights (of rows again where no weight is positive)."""
    total = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"), (F.sum(weight) if weight else F.count("*")).alias("w"))
    sums = total.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    p = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(F.col("n") / F.col("all_n"))
    return total.crossJoin(F.broadcast(sums)).select("level", p.alias("p"))


def contrast(a: DataFrame, b: DataFrame) -> DataFrame:
    """level and difference p_a - p_b over the levels of both; a missing level has 0."""
    return a.select("level", F.col("p").alias("pa")).join(b.select("level", F.col("p").alias("pb")), "level", "full_outer").select("level", (F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0))).alias("difference"))


def median_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls of numeric columns replaced by the column's exact median."""
    from lodestone.operators.ranks import quantiles

    medians = {c: quantiles(df, c, [0.5]) for c in columns}
    return df.fillna({c: m[0] for c, m in medians.items() if m})
