"""Local scores of tables that mix numeric and few-level columns, for searches over graphs (conditional Gaussian BIC)."""

from __future__ import annotations

from math import log, pi

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.cpt import text
from lodestone.storage import materialise

#: Least variance of a group in any direction, as a share of the column's own: groups of one row or of equal rows have none.
LEAST_VARIANCE = 1e-9


class MixedScores:
    """Log-likelihood less ln(rows) / 2 for each free parameter; the rows without nulls count.

    One pass reduces the rows to a count and the moments of the numeric columns for each configuration of the discrete
    ones. A numeric child is a regression on its numeric parents in each configuration of its discrete ones; a discrete
    child has its shares in them, times how much likelier its numeric parents are where its own level is known. The table
    of configurations stays on the driver if it has at most `most` rows; else each score is one Spark aggregate of it.
    Without numeric columns the scores are those of `BicScores`.
    """

    def __init__(self, df: DataFrame, numeric: list[str], discrete: list[str], most: int = 200_000):
        self.numeric, self.discrete, self.seen, self.groups = list(numeric), list(discrete), {}, {}
        rows = df.select(*[text(c) for c in discrete], *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric]).dropna()
        one = rows.agg(F.count("*").alias("rows"), *[f(f"`{c}`").alias(f"{k}_{i}") for i, c in enumerate(numeric) for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
        self.rows = one["rows"]
        self.sd = np.array([one[f"sd_{i}"] or 1.0 for i in range(len(numeric))])
        x = [(F.col(f"`{c}`") - F.lit(one[f"mean_{i}"] or 0.0)) / float(self.sd[i]) for i, c in enumerate(numeric)]
        self.pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
        sums = [F.sum(v).alias(f"_s{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"_q{k}") for k, (i, j) in enumerate(self.pairs)]
        self.columns = ["_n", *[f"_s{i}" for i in range(len(x))], *[f"_q{k}" for k in range(len(self.pairs))]]
        self.table = materialise(rows.groupBy(*discrete).agg(F.count("*").cast("double").alias("_n"), *sums), "moments")
        self.local = self.table.toPandas() if self.table.count() <= most else None
        levels = self.table.agg(F.lit(1), *[F.count_distinct(c).alias(c) for c in discrete]).first()
        self.levels = {c: levels[c] for c in discrete}

    def _moments(self, keys: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each configuration of the keys: rows, sums and sums of products of the standardised numeric columns."""
        if keys not in self.groups:
            if self.local is None:
                seen = self.table.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in self.columns]).toPandas()
            else:
                seen = self.local.groupby(list(keys))[self.columns].sum() if keys else self.local[self.columns].sum().to_frame().T
            m = seen[self.columns].to_numpy(float)
            m, d = m[m[:, 0] > 0], len(self.numeric)
            q = np.zeros((len(m), d, d))
            for k, (i, j) in enumerate(self.pairs):
                q[:, i, j] = q[:, j, i] = m[:, 1 + d + k]
            self.groups[keys] = m[:, 0], m[:, 1 : 1 + d], q
        return self.groups[keys]

    def _density(self, at: list[int], keys: tuple[str, ...]) -> float:
        """Log-likelihood of some standardised columns with a normal distribution for each configuration of the keys."""
        if not at:
            return 0.0
        n, s, q = self._moments(keys)
        mean = s[:, at] / n[:, None]
        cov = q[:, at][:, :, at] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        spread = np.maximum(np.linalg.eigvalsh(cov), LEAST_VARIANCE)
        return float(-0.5 * (n * (np.log(spread).sum(1) + len(at) * (log(2 * pi) + 1))).sum())

    def _shares(self, keys: tuple[str, ...]) -> float:
        n = self._moments(keys)[0]
        return float((n * np.log(n)).sum())

    def __call__(self, child: str, of: frozenset) -> float:
        if (child, of) not in self.seen:
            x = [i for i, c in enumerate(self.numeric) if c in of]
            z = tuple(c for c in self.discrete if c in of)
            configurations = float(np.prod([self.levels[c] for c in z]))
            if child in self.levels:
                both = tuple(c for c in self.discrete if c in of or c == child)
                fit = self._shares(both) - self._shares(z) + self._density(x, both) - self._density(x, z)
                free = configurations * (self.levels[child] - 1) * (1 + len(x) * (len(x) + 3) / 2)
            else:
                y = self.numeric.index(child)
                fit = self._density([*x, y], z) - self._density(x, z) - self.rows * log(self.sd[y])
                free = configurations * (len(x) + 2)
            self.seen[child, of] = fit - 0.5 * free * log(max(self.rows, 1))
        return self.seen[child, of]
