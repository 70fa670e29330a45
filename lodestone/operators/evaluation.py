"""How well a graph and a model fit: cross-validation, tests of the independences a graph claims, checks of mechanisms."""

from __future__ import annotations

from functools import reduce
from math import exp, lgamma, log

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.cpt import counts, cross_validated
from lodestone.operators.discovery import correlations, fisher_z, gram
from lodestone.operators.inference import descendants


def chi2_tail(x: float, k: int) -> float:
    """P(chi-square of k degrees of freedom > x), by the incomplete gamma function's series or continued fraction."""
    if x <= 0 or k <= 0:
        return 1.0
    a, x = k / 2, x / 2
    lead = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * lead)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return lead * h


def g_test(df: DataFrame, x: str, y: str, given: list[str]) -> tuple[float, int, float]:
    """Statistic, degrees of freedom and p-value of x and y being independent within each configuration of `given`; from one table of counts. What is given is independent of all."""
    if {x, y} & set(given):
        return 0.0, 0, 1.0
    n = counts(df, y, [*given, x]).withColumnRenamed("n", "nxy")
    of = lambda *c: F.sum("nxy").over(Window.partitionBy(*c))
    t = n.withColumns({"nx": of(*given, x), "ny": of(*given, y), "nz": of(*given)})
    row = t.agg(F.sum(2 * F.col("nxy") * F.log(F.col("nxy") * F.col("nz") / (F.col("nx") * F.col("ny")))).alias("g"), F.count_distinct(x).alias("a"), F.count_distinct(y).alias("b"), *[F.count_distinct(z).alias(f"z{i}") for i, z in enumerate(given)]).first()
    free = (row.a - 1) * (row.b - 1) * reduce(lambda p, i: p * row[f"z{i}"], range(len(given)), 1)
    g = max(row.g or 0.0, 0.0)
    return g, free, chi2_tail(g, free)


def claimed_independences(network: dict[str, list[str]]) -> list[tuple[str, str, list[str]]]:
    """Each node apart from each non-descendant that is no parent, given its parents; each pair once."""
    out, seen = [], set()
    for n, ps in sorted(network.items()):
        for other in sorted(set(network) - descendants(network, n) - {n} - set(ps)):
            if frozenset((n, other)) not in seen:
                seen.add(frozenset((n, other)))
                out.append((n, other, list(ps)))
    return out


def falsification(df: DataFrame, network: dict[str, list[str]], alpha: float = 0.05, numeric: bool = False) -> DataFrame:
    """x, y, given, p and violated of what the graph claims. numeric: Fisher's z on one correlation matrix; else a G test for each claim."""
    claims = claimed_independences(network)
    columns = sorted(network)
    if numeric:
        n, _, g = gram(df, columns)
        r = correlations(g)
        ps = [fisher_z(r, n, columns.index(x), columns.index(y), tuple(columns.index(z) for z in given)) for x, y, given in claims]
    else:
        ps = [g_test(df, x, y, given)[2] for x, y, given in claims]
    rows = [(x, y, ",".join(given), float(p), bool(p < alpha)) for (x, y, given), p in zip(claims, ps, strict=True)]
    return df.sparkSession.createDataFrame(rows, "x string, y string, given string, p double, violated boolean")


def node_report(df: DataFrame, network: dict[str, list[str]], fold: Column, folds: int = 5) -> DataFrame:
    """node, accuracy, baseline, macro_f1, lift and beats_baseline of each node's table on held-out folds."""
    parts = [cross_validated(df, n, ps, fold, folds).select(F.lit(n).alias("node"), "accuracy", "baseline", "macro_f1") for n, ps in sorted(network.items())]
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumns({"lift": F.col("accuracy") - F.col("baseline"), "beats_baseline": F.col("accuracy") > F.col("baseline")})


def linear_fit(df: DataFrame, child: str, parents: list[str], fold: Column, folds: int = 5) -> tuple[float, float]:
    """R² of linear regression on held-out folds, and the share of variance of the mean alone (0): moments by fold in one pass,
    each fold's model from the totals less its own."""
    names = ["one", *parents, child]
    means = df.dropna(subset=[*parents, child]).agg(*[F.avg(F.col(n).cast("double")).alias(n) for n in names[1:]]).first()
    x = {n: F.lit(1.0) if n == "one" else F.col(n).cast("double") - F.lit(means[n] or 0.0) for n in names}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    rows = df.dropna(subset=[*parents, child]).groupBy((fold % folds).alias("f")).agg(*[F.sum(x[a] * x[b]).alias(f"{a}|{b}") for a, b in pairs]).collect()
    d = len(names)
    m = {r.f: np.array([[r[f"{names[min(i, j)]}|{names[max(i, j)]}"] for j in range(d)] for i in range(d)]) for r in rows}
    total, wrong, spread = sum(m.values()), 0.0, 0.0
    for own in m.values():
        rest = total - own
        beta = np.linalg.lstsq(rest[:-1, :-1], rest[:-1, -1], rcond=None)[0]
        wrong += own[-1, -1] - 2 * beta @ own[:-1, -1] + beta @ own[:-1, :-1] @ beta
        mean = rest[0, -1] / rest[0, 0]
        spread += own[-1, -1] - 2 * mean * own[0, -1] + mean**2 * own[0, 0]
    return (1 - wrong / spread if spread > 0 else 0.0), 0.0
