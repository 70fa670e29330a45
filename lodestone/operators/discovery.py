"""Causal discovery. Spark reduces the rows to moments or counts once; the searches run on matrices of the variables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations
from math import erf, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.graphs import adjacent, blocked, dag_to_cpdag, find_cycle, is_clique, meek, neighbours, parents, pdag_to_dag, reaches
from lodestone.storage import materialise

Score = Callable[[str, frozenset], float]


def moment_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, s: sums of products of each pair of columns (`one` is the constant), in one pass over complete rows."""
    x = {"one": F.lit(1.0)} | {c: F.col(f"`{c}`").cast("double") for c in columns}
    names = list(x)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = df.dropna(subset=columns).agg(*[F.coalesce(F.sum(x[a] * x[b]), F.lit(0.0)).alias(f"s{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{i}").alias("s")) for i, (a, b) in enumerate(pairs)])).alias("r")).select("r.*")


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Complete rows, means, and the centred matrix of sums of products: columns are moved by their means first, so that large offsets don't cancel digits."""
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).dropna()
    shift = np.array([m or 0.0 for m in rows.agg(*[F.avg(f"`{c}`") for c in columns]).first()])
    moved = rows.select(*[(F.col(f"`{c}`") - float(m)).alias(c) for c, m in zip(columns, shift, strict=True)])
    s = {(r.a, r.b): r.s for r in moment_table(moved, columns).collect()}
    n = s["one", "one"]
    mean = np.array([s["one", c] for c in columns]) / max(n, 1.0)
    full = np.array([[s.get((a, b), s.get((b, a))) for b in columns] for a in columns])
    return int(n), mean + shift, full - n * np.outer(mean, mean)


def correlations(g: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.maximum(np.diag(g), 1e-300))
    return g / np.outer(d, d)


def fisher_z(r: np.ndarray, n: int, i: int, j: int, given: tuple[int, ...]) -> float:
    """Two-sided p-value of no partial correlation."""
    at = [i, j, *given]
    p = np.linalg.pinv(r[np.ix_(at, at)])
    rho = np.clip(-p[0, 1] / sqrt(p[0, 0] * p[1, 1]), -0.9999999, 0.9999999)
    z = sqrt(max(n - len(given) - 3, 1)) * abs(0.5 * log((1 + rho) / (1 - rho)))
    return 2 * (1 - 0.5 * (1 + erf(z / sqrt(2))))


def pc(df: DataFrame, columns: list[str], alpha: float = 0.05, allowed: np.ndarray | None = None) -> np.ndarray:
    """Stable PC with Fisher's z on one correlation matrix: skeleton, colliders, Meek's rules."""
    n_rows, _, g = gram(df, columns)
    r, n = correlations(g), len(columns)
    a = ~np.eye(n, dtype=bool) if allowed is None else (allowed | allowed.T)
    apart: dict[frozenset, set[int]] = {}
    size = 0
    while any(len(adjacent(a, i)) - 1 >= size for i in range(n)):
        near = {i: adjacent(a, i) for i in range(n)}
        for i in range(n):
            for j in sorted(near[i]):
                if a[i, j] and (found := next((set(s) for s in combinations(sorted(near[i] - {j}), size) if fisher_z(r, n_rows, i, j, s) > alpha), None)) is not None:
                    a[i, j] = a[j, i] = False
                    apart[frozenset((i, j))] = found
        size += 1
    out = a.copy()
    for j in range(n):
        for i, k in combinations(sorted(adjacent(a, j)), 2):
            if not a[i, k] and j not in apart.get(frozenset((i, k)), {j}):
                out[j, i] = out[j, k] = False
    if allowed is not None:
        only = allowed & ~allowed.T & (out | out.T)
        out = (out | only) & ~only.T
    return meek(out, allowed)


def _clique_additions(a: np.ndarray, base: set[int], items: set[int]):
    """The subsets of items that form a clique together with base: grown one by one, as no superset of another set does."""
    if not is_clique(a, base):
        return
    open_sets: list[tuple[set[int], list[int]]] = [(set(), sorted(items))]
    while open_sets:
        made, rest = open_sets.pop()
        yield made
        for i, k in enumerate(rest):
            if is_clique(a, base | made | {k}):
                open_sets.append((made | {k}, rest[i + 1 :]))


class GaussScores:
    """Local scores of numeric columns for searches over graphs: Gaussian log-likelihood less ln(rows) / 2 for each free parameter, from one matrix of moments."""

    def __init__(self, df: DataFrame, columns: list[str]):
        self.rows, _, g = gram(df, columns)
        self.cov, self.at, self.seen = g / max(self.rows, 1), {c: i for i, c in enumerate(columns)}, {}

    def __call__(self, child: str, of: frozenset) -> float:
        if (child, of) not in self.seen:
            y, x = self.at[child], sorted(self.at[p] for p in of)
            left = self.cov[y, y] - (self.cov[y, x] @ np.linalg.pinv(self.cov[np.ix_(x, x)]) @ self.cov[x, y] if x else 0.0)
            self.seen[child, of] = -0.5 * self.rows * log(max(left, 1e-12)) - 0.5 * (len(x) + 1) * log(max(self.rows, 2))
        return self.seen[child, of]


def ges(score: Score, columns: list[str], allowed: np.ndarray | None = None, backward: bool = True) -> np.ndarray:
    """Greedy equivalence search: the best valid insertion while it gains, then (backward) the best valid deletion."""
    n = len(columns)
    ok = np.ones((n, n), bool) if allowed is None else allowed | allowed.T
    a = np.zeros((n, n), bool)

    def s(y: int, of: set[int]) -> float:
        return score(columns[y], frozenset(columns[i] for i in of))

    def renewed(c: np.ndarray, old: np.ndarray) -> np.ndarray:
        dag = pdag_to_dag(c)
        return old if dag is None else dag_to_cpdag(dag)

    while True:
        best = (1e-9, None)
        for x in range(n):
            for y in range(n):
                if x == y or a[x, y] or a[y, x] or not ok[x, y]:
                    continue
                shared, pa = neighbours(a, y) & adjacent(a, x), parents(a, y)
                for t in _clique_additions(a, shared, {k for k in neighbours(a, y) - adjacent(a, x) - {x} if ok[k, y]}):
                    top = shared | t
                    if blocked(a, y, x, top):
                        gain = s(y, pa | top | {x}) - s(y, pa | top)
                        if gain > best[0]:
                            best = (gain, (x, y, t))
        if best[1] is None:
            break
        x, y, t = best[1]
        c = a.copy()
        c[x, y] = True
        for k in t:
            c[y, k] = False
        new = renewed(c, a)
        if (new == a).all():
            break
        a = new
    while backward:
        best = (1e-9, None)
        for x in range(n):
            for y in range(n):
                if not a[x, y]:
                    continue
                shared, pa = neighbours(a, y) & adjacent(a, x), parents(a, y)
                for keep in _clique_additions(a, set(), shared):
                    gain = s(y, (keep | pa) - {x}) - s(y, keep | pa | {x})
                    if gain > best[0]:
                        best = (gain, (x, y, shared - keep))
        if best[1] is None:
            break
        x, y, h = best[1]
        c = a.copy()
        c[x, y] = c[y, x] = False
        for k in h:
            c[k, y] = False
            if a[k, x] and a[x, k]:
                c[k, x] = False
        new = renewed(c, a)
        if (new == a).all():
            break
        a = new
    if allowed is not None:
        a &= allowed | ~a.T | ~allowed.T  # an undirected edge with one allowed direction has it
    return meek(a, allowed)


def hill_climb(score: Score, columns: list[str], allowed: np.ndarray | None = None, most_parents: int | None = None, start: np.ndarray | None = None) -> np.ndarray:
    """Add, drop or turn the edge that gains most until none gains; from no edges, or from an acyclic graph. most_parents bounds the parents of a node, if given."""
    n = len(columns)
    most_parents = n if most_parents is None else most_parents
    ok = ~np.eye(n, dtype=bool) if allowed is None else allowed.copy()
    a = np.zeros((n, n), bool) if start is None else start.astype(bool)

    def s(y: int, of: set[int]) -> float:
        return score(columns[y], frozenset(columns[i] for i in of))

    pa = {i: set(np.flatnonzero(a[:, i])) for i in range(n)}
    while True:
        best = (1e-9, None)
        for x in range(n):
            for y in range(n):
                if x == y:
                    continue
                if a[x, y]:
                    drop = s(y, pa[y] - {x}) - s(y, pa[y])
                    best = max(best, (drop, ("drop", x, y)), key=lambda b: b[0])
                    if ok[y, x] and len(pa[x]) < most_parents:
                        a[x, y] = False
                        if not reaches(a, x, y):
                            best = max(best, (drop + s(x, pa[x] | {y}) - s(x, pa[x]), ("turn", x, y)), key=lambda b: b[0])
                        a[x, y] = True
                elif ok[x, y] and not a[y, x] and len(pa[y]) < most_parents and not reaches(a, y, x):
                    best = max(best, (s(y, pa[y] | {x}) - s(y, pa[y]), ("add", x, y)), key=lambda b: b[0])
        if best[1] is None:
            return a
        what, x, y = best[1]
        a[x, y] = what == "add"
        pa[y] = pa[y] | {x} if what == "add" else pa[y] - {x}
        if what == "turn":
            a[y, x] = True
            pa[x] = pa[x] | {y}


def with_prior(score: Score, prior: dict[tuple[str, str], float], weight: float = 1.0, eps: float = 1e-6) -> Score:
    """score plus weight * sum of logit(prior of parent and child), clipped."""

    def both(child: str, of: frozenset) -> float:
        p = np.clip([prior.get((q, child), 0.5) for q in sorted(of)], eps, 1 - eps)
        return score(child, of) + weight * float(np.log(p / (1 - p)).sum())

    return both


def oriented(a: np.ndarray, prior: np.ndarray, greedy: bool = False) -> np.ndarray:
    """Undirected edges directed by the larger prior (ties from the lower index; greedy: in the order of the difference, never closing a cycle)."""
    out = a & ~a.T
    lines = [(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if a[i, j] and a[j, i]]
    if greedy:
        lines.sort(key=lambda e: -abs(prior[e] - prior[e[::-1]]))
    for i, j in lines:
        x, y = (i, j) if prior[i, j] >= prior[j, i] else (j, i)
        if greedy and reaches(out, y, x):
            x, y = y, x
        out[x, y] = True
    return out


def oriented_in_class(a: np.ndarray, prior: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """Undirected edges directed by the larger prior, the clearest first, without leaving the equivalence class: a direction
    that closes a cycle or makes a new collider of parents apart is not taken, and Meek's rules direct what follows from each."""
    out = meek(a.copy(), allowed)

    def may(x: int, y: int) -> bool:
        directed = out & ~out.T
        apart = any(not (out[k, x] or out[x, k]) for k in np.flatnonzero(directed[:, y]) if k != x)
        return (allowed is None or bool(allowed[x, y])) and not apart and not reaches(directed, y, x)

    stuck: set[tuple[int, int]] = set()
    while lines := [(i, j) for i in range(len(out)) for j in range(i + 1, len(out)) if out[i, j] and out[j, i] and (i, j) not in stuck]:
        i, j = max(lines, key=lambda e: (abs(prior[e] - prior[e[::-1]]), -e[0], -e[1]))
        ways = [(i, j), (j, i)] if prior[i, j] >= prior[j, i] else [(j, i), (i, j)]
        way = next((w for w in ways if may(*w)), None)
        if way is None:
            stuck.add((i, j))
            continue
        out[way[::-1]] = False
        out = meek(out, allowed)
    return out


def dagified(a: np.ndarray, allowed: np.ndarray | None = None, weights: np.ndarray | None = None) -> np.ndarray:
    """A copy without cycles: the weakest edge of each cycle found is turned if that is allowed and closes no other cycle, else it is dropped. Each step leaves fewer cycles."""
    out = a.astype(bool)
    strength = np.abs(a if weights is None else weights).astype(float)
    while cycle := find_cycle(out):
        x, y = min(zip(cycle, cycle[1:] + cycle[:1], strict=True), key=lambda e: (strength[e], e))
        out[x, y] = False
        if (allowed is None or allowed[y, x]) and not out[y, x] and not reaches(out, x, y):
            out[y, x] = True
    return out


#: How each method that uses priors works: the prior in its score (m: of adjacency, b: of direction), and what directs its edges.
PRIOR_METHODS = {
    "GES-M": ("m", "meek"), "GES-B": ("b", "meek"), "GES-M-B": ("m", "direct"), "GES-M-B-HL": ("m", "climb"), "GES-M-B-Greedy": ("m", "greedy"), "GES-M-B-MEC": ("m", "class"),
    "GES-HL": (None, "climb only"), "GES-M-HL": ("m", "climb only"), "GES-B-HL": ("b", "climb only"),
}


def with_priors(method: str, score: Score, columns: list[str], priors: dict[str, dict[tuple[str, str], float]], allowed: np.ndarray | None = None, weight: float = 1.0, **parameters) -> np.ndarray:
    """One of PRIOR_METHODS; priors are {m: {(parent, child): p}, b: the same}, as `ledger.prior_matrices` makes them, 0.5 where there is none."""
    which, then = PRIOR_METHODS[method]
    scored = with_prior(score, priors[which], weight) if which else score
    if then == "climb only":
        return hill_climb(scored, columns, allowed, **parameters)
    found = ges(scored, columns, allowed, **parameters)
    if then == "meek":
        return found
    by_direction = with_prior(score, priors["b"], weight)
    if then == "climb":
        dag = pdag_to_dag(found)
        start = dagified(found & ~found.T) if dag is None else dag
        return hill_climb(by_direction, columns, allowed, start=start if allowed is None else start & allowed)
    b = np.array([[priors["b"].get((p, c), 0.5) for c in columns] for p in columns])
    return oriented_in_class(found, b, allowed) if then == "class" else oriented(found, b, greedy=then == "greedy")


def _acyclicity(w: np.ndarray) -> tuple[float, np.ndarray]:
    """h = tr((I + w*w/d)^d) - d and its gradient."""
    d = len(w)
    m = np.eye(d) + w * w / d
    power = np.linalg.matrix_power(m, d - 1)
    return float((power @ m).trace() - d), power.T * w * 2


#: Distinct rows up to which the driver keeps a table of counts; beyond, every gradient is a pass over the table in Spark.
MOST_CONFIGURATIONS = 200_000

Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def squared_loss(c: np.ndarray) -> Loss:
    """Half the squared error of a linear graph, from the Gram matrix alone."""

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        r = np.eye(len(w)) - w
        return 0.5 * float((r.T @ c @ r).trace()), -c @ r

    return loss


def _count_loss(x: np.ndarray, n: np.ndarray, w: np.ndarray, kind: str) -> np.ndarray:
    """Sum over rows x that stand n times: the negative log-likelihood, then its gradient by row of w."""
    with np.errstate(over="ignore"):
        m = x @ w
        total, mean = (np.logaddexp(0, m), 1 / (1 + np.exp(-m))) if kind == "logistic" else (np.exp(m), np.exp(m))
    return np.concatenate([[float((n[:, None] * (total - x * m)).sum())], (x.T @ (n[:, None] * (mean - x))).ravel()])


def count_loss(df: DataFrame, columns: list[str], kind: str) -> Loss:
    """The mean negative log-likelihood of each column as 0/1 (`logistic`) or count (`poisson`) given weighted others, and its gradient.

    Equal rows are counted first. Up to MOST_CONFIGURATIONS distinct ones stay on the driver; more stay a table, and each
    evaluation is one pass over it, of which a sum for each pair of columns and task comes back. ValueError if a column
    holds anything but 0 and 1, or but whole numbers from 0 on.
    """
    if kind not in ("logistic", "poisson"):
        raise ValueError(f"loss: {kind!r}")
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).dropna()
    joint = materialise(rows.groupBy(*columns).agg(F.count("*").cast("double").alias("_n")), "joint")
    distinct, n = joint.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0.0))).first()
    wrong = reduce(Column.__or__, [~F.col(c).isin(0.0, 1.0) if kind == "logistic" else (F.col(c) < 0) | (F.col(c) != F.floor(c)) for c in columns])
    if not joint.where(wrong).isEmpty():
        raise ValueError(f"{kind} loss: a column holds other values")
    d = len(columns)
    if distinct <= MOST_CONFIGURATIONS:
        table = joint.toPandas().to_numpy(float)
        evaluate = lambda w: _count_loss(table[:, :d], table[:, d], w, kind)
    else:

        def evaluate(w: np.ndarray) -> np.ndarray:
            def part(batches):
                total = np.zeros(d * d + 1)
                for batch in batches:
                    at = np.column_stack([np.asarray(c) for c in batch.columns])
                    total += _count_loss(at[:, :d], at[:, d], w, kind)
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["sums"])

            return np.sum([r.sums for r in joint.mapInArrow(part, "sums array<double>").collect()], axis=0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        found = evaluate(w) / max(n, 1)
        return float(found[0]), found[1:].reshape(d, d)

    return loss


def notears(df: DataFrame, columns: list[str], allowed: np.ndarray | None = None, lam: float = 0.05, threshold: float = 0.3, rho_max: float = 1e16, tolerance: float = 1e-8, scale: bool = True, loss: str = "l2") -> np.ndarray:
    """Weights of a graph by NOTEARS with l1: augmented Lagrangian, proximal steps.

    loss: l2, a linear graph from the Gram matrix alone (of scaled columns if `scale`); logistic, of 0/1 columns, and
    poisson, of counts, without intercepts.
    """
    d = len(columns)
    if loss == "l2":
        n, _, g = gram(df, columns)
        fit = squared_loss(correlations(g) if scale else g / max(n, 1))
    else:
        fit = count_loss(df, columns, loss)
    mask = ~np.eye(d, dtype=bool) if allowed is None else allowed & ~np.eye(d, dtype=bool)
    w, rho, alpha, h = np.zeros((d, d)), 1.0, 0.0, np.inf
    while rho < rho_max:
        while rho < rho_max:
            new = _penalised(w, fit, mask, lam, rho, alpha)
            h_new, _ = _acyclicity(new)
            if h_new > 0.25 * h:
                rho *= 10
            else:
                break
        w, h = new, h_new
        alpha += rho * h
        if h <= tolerance:
            break
    return np.where(np.abs(w) > threshold, w, 0.0)


def _penalised(w: np.ndarray, fit: Loss, mask: np.ndarray, lam: float, rho: float, alpha: float, steps: int = 400) -> np.ndarray:
    """Proximal gradient with backtracking and momentum for the penalised loss."""

    def smooth(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, grad = fit(w)
        h, gh = _acyclicity(w)
        return value + alpha * h + 0.5 * rho * h * h, grad + (alpha + rho * h) * gh

    at, step, y, t = w.copy(), 1.0, w.copy(), 1.0
    for _ in range(steps):
        f, grad = smooth(y)
        while True:
            z = y - step * grad
            new = np.where(mask, np.sign(z) * np.maximum(np.abs(z) - step * lam, 0), 0.0)
            diff = new - y
            if smooth(new)[0] <= f + float((grad * diff).sum()) + 0.5 / step * float((diff * diff).sum()) + 1e-12 or step < 1e-14:
                break
            step *= 0.5
        if np.abs(new - at).max() < 1e-7:
            return new
        t_new = (1 + sqrt(1 + 4 * t * t)) / 2
        y, at, t = new + (t - 1) / t_new * (new - at), new, t_new
        step *= 1.2
    return at


def dagma(df: DataFrame, columns: list[str], allowed: np.ndarray | None = None, lam: float = 0.03, threshold: float = 0.3, rounds: int = 4, steps: int = 3000, rate: float = 0.01, scale: bool = True) -> np.ndarray:
    """Weights of a linear graph by the log-determinant characterisation, from the Gram matrix alone, with Adam."""
    n, _, g = gram(df, columns)
    d, c = len(columns), correlations(g) if scale else g / max(n, 1)
    mask = ~np.eye(d, dtype=bool) if allowed is None else allowed & ~np.eye(d, dtype=bool)
    w, mu, eye = np.zeros((d, d)), 1.0, np.eye(d)
    for s in (1.0, 0.9, 0.8, 0.7)[:rounds]:
        m, v, lr = np.zeros_like(w), np.zeros_like(w), rate
        for k in range(1, steps + 1):
            inner = s * eye - w * w
            inverse = np.linalg.inv(inner) + 1e-16
            while (inverse < 0).any() and lr > 1e-8:  # outside the domain: step back
                w, lr = w * 0.5, lr * 0.5
                inverse = np.linalg.inv(s * eye - w * w) + 1e-16
            grad = np.where(mask, mu * (-c @ (eye - w) + lam * np.sign(w)) + 2 * w * inverse.T, 0.0)
            m, v = 0.99 * m + 0.01 * grad, 0.999 * v + 0.001 * grad * grad
            w = w - lr * (m / (1 - 0.99**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        mu *= 0.1
    out = np.where(np.abs(w) > threshold, w, 0.0)
    while cycle := find_cycle(out != 0):
        edges = list(zip(cycle, cycle[1:] + cycle[:1], strict=True))
        out[min(edges, key=lambda e: abs(out[e]))] = 0.0
    return out


def lingam(df: DataFrame, columns: list[str], allowed: np.ndarray | None = None, threshold: float = 0.3) -> np.ndarray:
    """Direct LiNGAM with the pairwise likelihood measure. Each choice of a root is one Spark pass for the entropies of the
    standardised variables and of all pairs' residuals; the regressions come from the Gram matrix."""
    n, mean, g = gram(df, columns)
    d = len(columns)
    rows = df.dropna(subset=columns)
    mix = np.eye(d)  # each current variable as a combination of the centred columns
    order, left = [], list(range(d))
    ok = np.ones((d, d), bool) if allowed is None else allowed

    def entropies(combos: np.ndarray) -> np.ndarray:
        """Of the combinations, standardised, by the maximum-entropy approximation."""
        sd = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", combos, g, combos) / n, 1e-300))
        aggregates = []
        for i, (v, s) in enumerate(zip(combos, sd, strict=True)):
            u = sum((F.lit(float(x / s)) * (F.col(f"`{c}`").cast("double") - F.lit(float(m))) for x, c, m in zip(v, columns, mean, strict=True) if abs(x) > 1e-12), F.lit(0.0))
            aggregates += [F.avg(F.abs(u) + F.log1p(F.exp(-2 * F.abs(u))) - F.lit(log(2))).alias(f"c{i}"), F.avg(u * F.exp(-u * u / 2)).alias(f"e{i}")]
        r = rows.agg(*aggregates).first()
        k1, k2, gamma = 79.047, 7.4129, 0.37457  # fixed values of the approximation
        return np.array([(1 + log(2 * np.pi)) / 2 - k1 * (r[f"c{i}"] - gamma) ** 2 - k2 * r[f"e{i}"] ** 2 for i in range(len(combos))])

    while left:
        if len(left) == 1:
            order.append(left.pop())
            break
        cov = mix @ g @ mix.T / n
        pairs = [(i, j) for i in left for j in left if i != j]
        residuals = [mix[i] - cov[i, j] / max(cov[j, j], 1e-300) * mix[j] for i, j in pairs]
        h = entropies(np.array([*(mix[i] for i in left), *residuals]))
        own, rest = dict(zip(left, h, strict=False)), dict(zip(pairs, h[len(left) :], strict=True))
        roots = [i for i in left if not any(ok[j, i] and not ok[i, j] for j in left if j != i)] or left
        # the difference of mutual information between the two directions; negative parts speak against i as a root
        cost = {i: sum(min(0.0, (own[j] + rest[i, j]) - (own[i] + rest[j, i])) ** 2 for j in left if j != i) for i in roots}
        root = min(roots, key=lambda i: (cost[i], i))
        order.append(root)
        left.remove(root)
        for i in left:
            mix[i] = mix[i] - cov[i, root] / max(cov[root, root], 1e-300) * mix[root]
    w = np.zeros((d, d))
    for k, j in enumerate(order):
        before = [i for i in order[:k] if ok[i, j]]
        if before:
            w[before, j] = np.linalg.lstsq(g[np.ix_(before, before)], g[before, j], rcond=None)[0]
    return np.where(np.abs(w) > threshold, w, 0.0)


def edges(spark, a: np.ndarray, columns: list[str], method: str, run: int = 0) -> DataFrame:
    """run, method, src, dst, weight of the matrix's edges."""
    rows = [(run, method, columns[i], columns[j], float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)]
    return spark.createDataFrame(rows, "run int, method string, src string, dst string, weight double")
