"""Linear mechanisms with additive noise, fitted from one matrix of moments, and what rows become under interventions.

An intervention is a number, or a function of the node's own value as a Column (a soft intervention).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import normal
from lodestone.operators.discovery import gram
from lodestone.operators.inference import descendants, topological

Intervention = float | Callable[[Column], Column]


@dataclass(frozen=True)
class Linear:
    """value = intercept + sum of weight * parent + noise of standard deviation sd; `explained` is R², 0 of a root."""

    weights: dict[str, float]
    intercept: float
    sd: float
    explained: float

    def mean(self, value: Callable[[str], Column]) -> Column:
        return sum((value(p) * w for p, w in self.weights.items()), F.lit(self.intercept))


def fit_linear(df: DataFrame, network: dict[str, list[str]]) -> dict[str, Linear]:
    """The least-squares mechanism of each node given its parents, over the rows without nulls; parents that add nothing to others have the smallest weights that fit."""
    names = topological(network)
    n, mean, g = gram(df, names)
    at, out = {c: i for i, c in enumerate(names)}, {}
    for node in names:
        y, x = at[node], [at[p] for p in network[node]]
        w = np.linalg.lstsq(g[np.ix_(x, x)], g[x, y], rcond=None)[0] if x else np.zeros(0)
        left = max(float(g[y, y] - w @ g[x, y]), 0.0)
        out[node] = Linear(dict(zip(network[node], map(float, w), strict=True)), float(mean[y] - w @ mean[x]), (left / max(n, 1)) ** 0.5, 1 - left / float(g[y, y]) if x and g[y, y] > 0 else 0.0)
    return out


def mechanism_table(df: DataFrame, model: dict[str, Linear]) -> DataFrame:
    """node, parent (null of the intercept), weight, sd, explained."""
    rows = [(n, p, w, m.sd, m.explained) for n, m in sorted(model.items()) for p, w in [(None, m.intercept), *sorted(m.weights.items())]]
    return df.sparkSession.createDataFrame(rows, "node string, parent string, weight double, sd double, explained double")


def applied(do: Intervention, value: Column) -> Column:
    return do(value) if callable(do) else F.lit(float(do))


def act(rows: DataFrame, model: dict[str, Linear], do: dict[str, Intervention], noise: str = "kept", seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """rows with new_<node> for each node, after the interventions.

    Nodes that are not below one keep their values. Those below are, by `noise`, moved by what their parents moved
    (`kept`: the counterfactual of the row), their mean given the new parents (`none`), or that and a fresh normal draw,
    which seed, node and the columns `key` decide (`drawn`). A null anywhere above makes the new value null.
    """
    if noise not in ("kept", "none", "drawn"):
        raise ValueError(f"noise: {noise!r}")
    if noise == "drawn" and not key:
        raise ValueError("drawn noise needs the columns that tell rows apart")
    network = {n: list(m.weights) for n, m in model.items()}
    if unknown := set(do) - set(network):
        raise KeyError(f"unknown: {sorted(unknown)}")
    below = set().union(*[descendants(network, d) for d in do])
    for node in topological(network):
        old, m = F.col(node).cast("double"), model[node]
        value = old
        if node in below:
            mean = m.mean(lambda p: F.col(f"new_{p}"))
            fresh = m.sd * normal(seed, F.lit(node), *[F.col(k) for k in key or []])
            value = {"kept": old + mean - m.mean(lambda p: F.col(p).cast("double")), "none": mean, "drawn": mean + fresh}[noise]
        rows = rows.withColumn(f"new_{node}", applied(do[node], value) if node in do else value)
    return rows


def numeric_effect(rows: DataFrame, model: dict[str, Linear], targets: list[str], do: dict[str, Intervention], reference: dict[str, Intervention] | None = None) -> DataFrame:
    """target, mean under do and difference (from the mean under reference; from the rows as they are without one), over the rows given: all, those of an entity, or those that meet conditions."""
    done = act(rows, model, do, "none").agg(*[F.avg(f"new_{t}").alias(t) for t in targets])
    other = act(rows, model, reference, "none").agg(*[F.avg(f"new_{t}").alias(f"_{t}") for t in targets]) if reference else rows.agg(*[F.avg(F.col(t).cast("double")).alias(f"_{t}") for t in targets])
    entries = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("mean"), (F.col(t) - F.col(f"_{t}")).alias("difference")) for t in targets])
    return done.crossJoin(other).select(F.explode(entries).alias("r")).select("r.*")
