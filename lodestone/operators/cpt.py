"""Conditional probability tables and scores of discrete networks; the counts are Spark aggregates, tables stay tables."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.storage import broadcast_if_small, materialise

FLOOR, ESS = 1e-12, 5.0


def text(column: str) -> Column:
    return F.col(column).cast("string").alias(column)


def joint_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns as texts and `_rows`: how often each configuration occurs, nulls among them. Written once, so that all tables of a network come from one pass over the rows."""
    return materialise(df.select(*[text(c) for c in columns]).groupBy(*columns).agg(F.count("*").alias("_rows")), "joint")


def counts(df: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """n of each configuration of parents and child, as texts; rows with a null there don't count. df may be rows, or `joint_counts`."""
    n = F.sum("_rows") if "_rows" in df.columns else F.count("*")
    rows = df.select(*[text(c) for c in [*parents, child]], *[c for c in df.columns if c == "_rows"])
    return rows.dropna().groupBy(*parents, child).agg(n.alias("n"))


def cpt(df: DataFrame, child: str, parents: list[str], ess: float = 0.0, of: DataFrame | None = None) -> DataFrame:
    """parents, child and p. ess 0: shares of the counts seen. ess > 0: every combination of levels, each with the
    pseudo-count ess / (levels of child * configurations of parents).

    The domains are crossed, as the table itself is their product; `of` gives counts that are there already.
    """
    seen = of if of is not None else counts(df, child, parents)
    by_parents = Window.partitionBy(*parents)
    if not ess:
        return seen.withColumn("p", F.col("n") / F.sum("n").over(by_parents)).drop("n")
    domains = [seen.select(c).distinct() for c in [*parents, child]]
    full = reduce(lambda a, b: a.crossJoin(b), domains).join(seen, [*parents, child], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cells = full.withColumn("cells", F.count("*").over(Window.partitionBy()))
    alpha = F.lit(ess) / F.col("cells")
    return cells.withColumn("p", (F.col("n") + alpha) / F.sum(F.col("n") + alpha).over(by_parents)).drop("n", "cells")


def log_likelihood(df: DataFrame, network: dict[str, list[str]], ess: float = 0.0) -> DataFrame:
    """log_likelihood, parameters, rows and bic = log_likelihood - parameters / 2 * ln(max(2, rows)).

    From counts alone: each configuration's count times the logarithm of its probability, so no row is joined with a table.
    """
    df = joint_counts(df, list(network))
    parts = []
    for child, parents in network.items():
        seen = counts(df, child, parents)
        table = cpt(df, child, parents, ess, seen)
        fit = seen.join(table, [*parents, child]).agg(F.sum(F.col("n") * F.log(F.greatest("p", F.lit(FLOOR)))).alias("ll"))
        levels = seen.agg((F.count_distinct(child) - 1).alias("r"), *[F.count_distinct(p).alias(f"q_{i}") for i, p in enumerate(parents)])
        free = reduce(lambda a, b: a * b, [F.col("r"), *[F.col(f"q_{i}") for i in range(len(parents))]])
        parts.append(fit.crossJoin(levels.select(free.alias("k"))))
    total = reduce(DataFrame.unionByName, parts).agg(F.sum("ll").alias("log_likelihood"), F.sum("k").alias("parameters"))
    rows = df.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"))
    return total.crossJoin(rows).withColumn("bic", F.col("log_likelihood") - 0.5 * F.col("parameters") * F.log(F.greatest("rows", F.lit(2)).cast("double")))


def row_log_likelihood(rows: DataFrame, tables: dict[str, DataFrame], network: dict[str, list[str]]) -> DataFrame:
    """rows with log_likelihood: the sum of the logarithms of each node's probability given its parents in the row.

    Values that a table does not hold count as FLOOR; a row with a null has null. Tables join by their parents and node,
    broadcast where they are small.
    """
    out = rows.withColumn("log_likelihood", F.lit(0.0))
    for node, parents in network.items():
        keys = [*parents, node]
        table = broadcast_if_small(tables[node].select(*[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("p").alias("_p")))
        out = out.join(table, reduce(lambda a, b: a & b, [F.col(k).cast("string") == F.col(f"_k{i}") for i, k in enumerate(keys)]), "left")
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        fit = F.when(known, F.log(F.greatest(F.coalesce("_p", F.lit(FLOOR)), F.lit(FLOOR))))
        out = out.withColumn("log_likelihood", F.col("log_likelihood") + fit).drop("_p", *[f"_k{i}" for i in range(len(keys))])
    return out


def bic_score(df: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """score: sum of n ln(n / n of the parents) less ln(rows) / 2 * (child levels - 1) * product of parent levels."""
    seen = counts(df, child, parents)
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*parents))
    body = seen.withColumn("share", share).agg(F.sum(F.col("n") * F.log("share")).alias("fit"), F.sum("n").alias("rows"), F.count_distinct(child).alias("r"), *[F.count_distinct(p).alias(f"q_{i}") for i, p in enumerate(parents)])
    q = reduce(lambda a, b: a * b, [F.col(f"q_{i}") for i in range(len(parents))], F.lit(1))
    return body.select((F.col("fit") - 0.5 * F.log("rows") * q * (F.col("r") - 1)).alias("score"))


class BicScores:
    """Local scores of a table of few-level columns, for searches over graphs.

    Rows are counted once, over all columns together; the searches' scores come from that table of configurations, which
    the driver keeps if it has at most `most` rows, and else from one Spark aggregate for each score.
    """

    def __init__(self, df: DataFrame, columns: list[str], most: int = 200_000):
        import numpy as np

        self.columns, self.cache = list(columns), {}
        joint = df.select(*[text(c) for c in columns]).dropna().groupBy(*columns).agg(F.count("*").alias("n"))
        self.joint = materialise(joint, "joint")
        self.local = None
        if self.joint.count() <= most:
            table = self.joint.toPandas()
            self.local = {c: np.unique(table[c], return_inverse=True)[1] for c in columns}
            self.n = table["n"].to_numpy()
            self.levels = {c: int(self.local[c].max()) + 1 if len(table) else 0 for c in columns}
        else:
            row = self.joint.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
            self.levels = {c: row[c] for c in columns}
        self.rows = self.joint.agg(F.sum("n")).first()[0] or 0

    def __call__(self, child: str, parents: frozenset[str]) -> float:
        key = (child, frozenset(parents))
        if key not in self.cache:
            q = 1
            for p in key[1]:
                q *= self.levels[p]
            self.cache[key] = self._fit(child, sorted(key[1])) - 0.5 * log(max(self.rows, 1)) * q * (self.levels[child] - 1)
        return self.cache[key]

    def _fit(self, child: str, parents: list[str]) -> float:
        import numpy as np

        if self.local is None:
            seen = self.joint.groupBy(*parents, child).agg(F.sum("n").alias("n"))
            share = F.col("n") / F.sum("n").over(Window.partitionBy(*parents))
            return seen.withColumn("share", share).agg(F.sum(F.col("n") * F.log("share"))).first()[0] or 0.0
        code = np.zeros(len(self.n), np.int64)
        for p in parents:
            code = np.unique(code * self.levels[p] + self.local[p], return_inverse=True)[1]
        both = np.unique(code * self.levels[child] + self.local[child], return_inverse=True)[1]
        n, first = np.bincount(both, self.n), np.zeros(int(both.max()) + 1 if len(both) else 0, np.int64)
        first[both] = code
        return float((n * np.log(n / np.bincount(code, self.n)[first])).sum())


def cross_validated(df: DataFrame, child: str, parents: list[str], fold: Column, folds: int = 5) -> DataFrame:
    """accuracy, baseline (always the training mode) and macro_f1 over folds: each row is predicted by counts without its own fold.

    macro_f1 is the mean of 2 * right / (rows of the level + predictions of it) over all levels that occur or are predicted.

    Counts by fold are subtracted from the totals; no table is fitted again and rows are read once.
    """
    by_fold = df.select(*[text(c) for c in [*parents, child]], (fold % folds).alias("fold")).dropna().groupBy("fold", *parents, child).agg(F.count("*").alias("n"))
    total = by_fold.groupBy(*parents, child).agg(F.sum("n").alias("total"))
    every = df.sparkSession.range(folds).select(F.col("id").cast("int").alias("fold"))
    left = total.crossJoin(every).join(by_fold.withColumn("fold", F.col("fold").cast("int")), ["fold", *parents, child], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rest", F.col("total") - F.col("n"))
    best = left.where("rest > 0").groupBy("fold", *parents).agg(F.min_by(child, F.struct(-F.col("rest"), F.col(child))).alias("predicted"))
    modes = left.groupBy("fold", child).agg(F.sum("rest").alias("rest")).groupBy("fold").agg(F.min_by(child, F.struct(-F.col("rest"), F.col(child))).alias("usual"))
    judged = left.where("n > 0").join(best, ["fold", *parents], "left").join(modes, "fold")
    confusion = judged.groupBy(F.col(child).alias("actual"), F.coalesce("predicted", "usual").alias("predicted"), "usual").agg(F.sum("n").alias("n"))
    right = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    roles = F.array(F.struct(F.col("actual").alias("level"), (2 * right).alias("right"), "n"), F.struct(F.col("predicted").alias("level"), F.lit(0).cast("long").alias("right"), "n"))
    f1 = confusion.select(F.explode(roles).alias("r")).select("r.*").groupBy("level").agg((F.sum("right") / F.sum("n")).alias("f1")).agg(F.avg("f1").alias("macro_f1"))
    shares = confusion.agg((F.sum(right) / F.sum("n")).alias("accuracy"), (F.sum(F.when(F.col("usual") == F.col("actual"), F.col("n")).otherwise(0)) / F.sum("n")).alias("baseline"))
    return shares.crossJoin(f1)
