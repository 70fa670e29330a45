"""Weighted summaries of samples: moments, intervals, effective size, densities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranks import running, weights_by_value

GRID = 64


def moments(df: DataFrame, x: str, w: str) -> DataFrame:
    """mean, sd (of the population) and ess = 1 / sum of squared normalised weights; squares are of distances from the mean."""
    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("_x"), F.col(w).alias("_w"))
    one = rows.agg(F.sum("_w").alias("s"), F.sum(F.col("_w") * F.col("_w")).alias("s2"), F.sum(F.col("_w") * F.col("_x")).alias("sx"))
    off = F.col("_x") - F.col("sx") / F.col("s")
    two = rows.crossJoin(F.broadcast(one)).agg(*[F.max(c).alias(c) for c in ("s", "s2", "sx")], F.sum(F.col("_w") * off * off).alias("sq"))
    return two.select((F.col("sx") / F.col("s")).alias("mean"), F.sqrt(F.greatest(F.col("sq") / F.col("s"), F.lit(0.0))).alias("sd"), (F.col("s") * F.col("s") / F.col("s2")).alias("ess"))


def interval(df: DataFrame, x: str, w: str, at: tuple[float, float] = (0.025, 0.975)) -> DataFrame:
    """low and high: the values where the cumulative weight of the distinct values, interpolated, reaches the two shares."""
    steps = running(weights_by_value(df, x, w), "x", "w")
    both = steps.crossJoin(F.broadcast(steps.agg(F.max("c").alias("_all"))))
    found = []
    for k, q in enumerate(at):
        reached = F.col("c") / F.col("_all") >= q
        found += [F.min(F.when(reached, F.col(c))).alias(f"{c}{k}") for c in ("x", "c")] + [F.max(F.when(~reached, F.col(c))).alias(f"p{c}{k}") for c in ("x", "c")]
    row = both.agg(F.max("_all").alias("_all"), *found)

    def value(k: int, q: float):
        x, c, px, pc = (F.col(f"{name}{k}") for name in ("x", "c", "px", "pc"))
        return F.when(pc.isNull(), x).otherwise(px + (x - px) * (F.lit(q) * F.col("_all") - pc) / (c - pc))

    return row.select(value(0, at[0]).alias("low"), value(1, at[1]).alias("high"))


def density(df: DataFrame, x: str, w: str, points: int = GRID) -> DataFrame:
    """at and density on an even grid over the range, by a weighted Gaussian kernel of Scott's width; a single value has a spike."""
    one = df.where(F.col(x).isNotNull()).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(w).alias("s")).first()
    spark = df.sparkSession
    if one.s is None or one.hi - one.lo <= 1e-9 * max(1.0, abs(one.lo), abs(one.hi)):
        return spark.createDataFrame([] if one.s is None else [(float(one.lo), 1.0)], "at double, density double")
    m = moments(df, x, w).first()
    h = m.sd * (m.ess / max(m.ess - 1, 1e-9)) ** 0.5 * m.ess**-0.2
    step = (one.hi - one.lo) / (points - 1)
    grid = F.explode(F.array(*[F.lit(one.lo + step * i) for i in range(points)]))
    z = (F.col("at") - F.col("_x")) / h
    return df.where(F.col(x).isNotNull()).select(F.col(x).alias("_x"), F.col(w).alias("_w"), grid.alias("at")).groupBy("at").agg((F.sum(F.col("_w") * F.exp(-0.5 * z * z)) / (one.s * h * (2 * 3.141592653589793) ** 0.5)).alias("density"))
