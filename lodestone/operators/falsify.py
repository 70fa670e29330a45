"""Whether rows refute a graph: its claims of independence, against those of the same graph with its nodes exchanged.

All tests come from one table: a correlation matrix, counts of the distinct rows, or products of random features, which is
one pass over the rows whatever the number of claims and of exchanged graphs. A pair given the same nodes is tested once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice, permutations
from math import factorial
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.cpt import joint_counts
from lodestone.operators.discovery import correlations, fisher_z, gram
from lodestone.operators.evaluation import chi2_tail, claimed_independences, g_test
from lodestone.storage import materialise

#: Distinct rows up to which the driver keeps the table of counts; beyond, each test is a Spark aggregate of that table.
MOST_CONFIGURATIONS = 200_000
#: Random cosine features of a column, besides itself: of one that is tested, and of one that is given, which must carry all that it explains.
FEATURES, GIVEN_FEATURES = 5, 25

Test = Callable[[str, str, tuple[str, ...]], float]


def linear_tests(df: DataFrame, columns: list[str]) -> Test:
    """p-values of partial correlations."""
    n, _, g = gram(df, columns)
    r, at = correlations(g), {c: i for i, c in enumerate(columns)}
    return lambda x, y, given: fisher_z(r, n, at[x], at[y], tuple(at[z] for z in given))


def count_tests(df: DataFrame, columns: list[str]) -> Test:
    """p-values of G tests within each configuration of what is given; from one table of the distinct rows' counts."""
    joint = materialise(joint_counts(df, columns), "joint")
    if joint.count() > MOST_CONFIGURATIONS:
        return lambda x, y, given: g_test(joint, x, y, list(given))[2]
    rows = joint.toPandas().dropna()
    codes = {c: np.unique(rows[c].astype(str).to_numpy(), return_inverse=True)[1] for c in columns}
    n = rows["_rows"].to_numpy(float)

    def sums(*names: str) -> tuple[np.ndarray, np.ndarray]:
        """Each row's group by these columns, and the groups' counts."""
        key = np.zeros(len(n), np.int64)
        for c in names:
            key = np.unique(key * (codes[c].max(initial=0) + 1) + codes[c], return_inverse=True)[1]
        return key, np.bincount(key, n)

    def test(x: str, y: str, given: tuple[str, ...]) -> float:
        if not len(n) or {x, y} & set(given):
            return 1.0
        (of, nxy), (_, nx), (_, ny), (_, nz) = (sums(*given, *s) for s in ((x, y), (x,), (y,), ()))
        first = np.unique(of, return_index=True)[1]
        gx, gy, gz = (c[k[first]] for k, c in (sums(*given, x), sums(*given, y), sums(*given)))
        g = 2 * float((nxy * np.log(nxy * gz / (gx * gy))).sum())
        free = int((codes[x].max() * codes[y].max()) * np.prod([codes[z].max() + 1 for z in given]))
        return chi2_tail(max(g, 0.0), free)

    return test


def feature_tests(df: DataFrame, columns: list[str], features: int = FEATURES, given_features: int = GIVEN_FEATURES, seed: int = 0) -> Test:
    """p-values of independence of any smooth kind: the columns' random cosine features, freed of what those given explain linearly, must be uncorrelated.

    n times the sum of squared canonical correlations (Pillai's trace) is taken as chi-square. Columns are scaled to unit
    deviation first. The products of all features are summed in each task by blocks of rows; a matrix for each task, as
    large as the square of the number of features, reaches the driver.
    """
    rng = np.random.default_rng(seed)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).dropna()
    one = rows.agg(*[f(c) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    mean, sd = np.array([x or 0.0 for x in one[::2]]), np.array([x or 1.0 for x in one[1::2]])
    d, k, own = len(columns), given_features + 1, features + 1
    slope, shift = rng.normal(size=(d, given_features)), rng.uniform(0, 2 * np.pi, (d, given_features))
    size = 1 + d * k

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = (np.column_stack([np.asarray(c) for c in batch.columns]) - mean) / sd
            parts = np.concatenate([x[:, :, None], np.cos(x[:, :, None] * slope + shift)], axis=2).reshape(len(x), -1)
            full = np.column_stack([np.ones(len(x)), parts])
            total += full.T @ full
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["sums"])

    found = [np.array(r.sums) for r in rows.mapInArrow(products, "sums array<double>").collect()]
    total = np.sum(found, axis=0).reshape(size, size) if found else np.zeros((size, size))
    n = total[0, 0]
    c = total[1:, 1:] / max(n, 1) - np.outer(total[0, 1:], total[0, 1:]) / max(n, 1) ** 2
    at = {x: np.arange(i * k, (i + 1) * k) for i, x in enumerate(columns)}

    def whitened(m: np.ndarray) -> tuple[np.ndarray, int]:
        """A root of the inverse on the part that varies, and that part's dimension."""
        value, vector = np.linalg.eigh((m + m.T) / 2)
        keep = value > 1e-6 * max(value.max(), 1e-12)
        return vector[:, keep] / np.sqrt(value[keep]), int(keep.sum())

    def test(x: str, y: str, given: tuple[str, ...]) -> float:
        a, b, z = at[x][:own], at[y][:own], np.concatenate([at[g] for g in given]).astype(int) if given else np.zeros(0, int)
        ab = np.concatenate([a, b])
        left = c[np.ix_(ab, ab)]
        if len(z):
            left = left - c[np.ix_(ab, z)] @ np.linalg.pinv(c[np.ix_(z, z)], rcond=1e-8) @ c[np.ix_(z, ab)]
        wa, p = whitened(left[:own, :own])
        wb, q = whitened(left[own:, own:])
        return chi2_tail(n * float(((wa.T @ left[:own, own:] @ wb) ** 2).sum()), p * q)

    return test


TESTS = {"linear": linear_tests, "counts": count_tests, "features": feature_tests}


@dataclass
class Verdict:
    """violations of the graph's `claims`; how many exchanged graphs were judged, and the share that violates no more; whether rows refute the graph."""

    violations: int
    claims: int
    judged: int
    p: float
    falsified: bool


def exchanged(network: dict[str, list[str]], most: int, seed: int = 0) -> Iterator[dict[str, list[str]]]:
    """The network under all exchanges of its nodes, if there are at most `most`, else under so many drawn ones."""
    names = sorted(network)
    every = factorial(len(names)) <= most
    rng = Random(seed)
    orders = permutations(names) if every else (rng.sample(names, len(names)) for _ in range(most))
    for order in islice(orders, most):
        to = dict(zip(names, order, strict=True))
        yield {to[x]: [to[p] for p in ps] for x, ps in network.items()}


def falsify(df: DataFrame, network: dict[str, list[str]], kind: str = "linear", alpha: float = 0.05, level: float = 0.05, most: int = 1000, seed: int = 0) -> Verdict:
    """Test what the graph claims, and what exchanged graphs claim.

    kind: linear (numbers), counts (categories) or features (numbers that depend in any smooth way). A claim whose p-value
    is below `level` is violated. The graph is refuted unless the share of exchanged graphs that violate no more of theirs
    is at most alpha: then a graph of its shape with its nodes placed at random does as well. A graph that claims nothing
    cannot be refuted or upheld: p is 1.
    """
    if kind not in TESTS:
        raise ValueError(f"kind: {kind!r}; there are {', '.join(TESTS)}")
    columns = sorted(network)
    test, known = TESTS[kind](df.select(*columns), columns), {}

    def violations(of: dict[str, list[str]]) -> int:
        n = 0
        for x, y, given in claimed_independences(of):
            key = (*sorted((x, y)), *sorted(given))
            if key not in known:
                known[key] = test(key[0], key[1], tuple(key[2:])) < level
            n += known[key]
        return n

    own = violations(network)
    others = [violations(g) for g in exchanged(network, most, seed)]
    p = sum(v <= own for v in others) / len(others)
    return Verdict(own, len(claimed_independences(network)), len(others), p, p > alpha)
