"""Models of tables with categories, ordered levels and numbers: a mechanism for each node, what rows become, and what samples say.

Every mechanism is fitted by Spark over all rows and evaluated as columns:

* a category without numeric parents: a table of probabilities; with some: softmax regression (`Choice`);
* a number: least squares on its parents, categories as 0/1 columns, with additive noise (`Line`);
* an ordered level: boosted trees on its parents and whole steps of noise (`Steps`), decoded to its level again;
* a number without parents: its own distribution;
* a number whose mean the caller gives as an expression: that, with additive noise (`Given`).

Noise is kept as quantiles, to draw from, and as densities on a grid, to weight evidence by.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import gumbel, natural_key, uniform
from lodestone.operators.counterfactual import TINY, abducted, likeliest
from lodestone.operators.discovery import gram
from lodestone.operators.inference import LOW_ESS, descendants, topological
from lodestone.storage import materialise

CATEGORY, ORDERED, NUMBER = "category", "ordered", "number"
#: Steps of the noise's quantiles, and points of its density.
QUANTILES, POINTS = 512, 1024

Of = Callable[[str], Column]


@dataclass(frozen=True)
class Input:
    """A column of a mechanism's design: a number, or 1 where a category has the level."""

    node: str
    level: str | None = None

    def column(self, of: Of) -> Column:
        return of(self.node) if self.level is None else F.when(of(self.node).isNotNull(), (of(self.node) == self.level).cast("double"))


@dataclass(frozen=True)
class Noise:
    """quantiles of a distribution at even steps, and its density at `low` + i * `step`."""

    quantiles: tuple[float, ...]
    low: float
    step: float
    density: tuple[float, ...]
    whole: bool = False

    def draw(self, u: Column) -> Column:
        at = u * (len(self.quantiles) - 1)
        values = F.array(*map(F.lit, self.quantiles))
        below, above = F.element_at(values, F.floor(at).cast("int") + 1), F.element_at(values, F.ceil(at).cast("int") + 1)
        value = below + (above - below) * (at - F.floor(at))
        return F.round(value) if self.whole else value

    def weight(self, x: Column) -> Column:
        """The density at x, between two points of the grid interpolated, 0 beyond it. Whole steps have probabilities, not densities."""
        values = F.array(*map(F.lit, self.density))
        at = (x - self.low) / self.step
        if self.whole:
            return F.when((at >= 0) & (at < len(self.density)), F.element_at(values, F.round(at).cast("int") + 1)).otherwise(0.0)
        inside = (at >= 0) & (at <= len(self.density) - 1)
        i = F.least(F.floor(at), F.lit(len(self.density) - 2)).cast("int")
        a, b = F.try_element_at(values, i + 1), F.try_element_at(values, i + 2)
        return F.when(inside, a + (b - a) * (at - i)).otherwise(0.0)


def whole_noise(df: DataFrame, x: str, n: str) -> Noise:
    """The noise of whole steps x that stand n times each: exact quantiles and probabilities. Only a count for each step reaches the driver."""
    counts = {int(r[0]): r[1] for r in df.where(F.col(x).isNotNull()).groupBy(x).agg(F.sum(n)).collect()}
    if not counts:
        raise ValueError(f"{x}: no rows to fit")
    steps = np.arange(min(counts), max(counts) + 1)
    each = np.array([counts.get(int(i), 0) for i in steps])
    ranks = np.maximum(np.ceil(np.arange(QUANTILES + 1) / QUANTILES * each.sum()), 1)
    quantiles = steps[np.searchsorted(each.cumsum(), ranks)]
    return Noise(tuple(map(float, quantiles)), float(steps[0]), 1.0, tuple(map(float, each / each.sum())), True)


def noise_of(df: DataFrame, x: str) -> Noise:
    """The noise that a column without parents' part is: quantiles, and a Gaussian kernel density of Scott's width.

    Rows are counted in fine bins in Spark; the kernel is laid over the counts, at most some thousand of them, on the driver.
    """
    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"))
    n, low, high, sd = rows.agg(F.count("*"), F.min("x"), F.max("x"), F.stddev_pop("x")).first()
    if not n:
        raise ValueError(f"{x}: no rows to fit")
    quantiles = tuple(rows.approxQuantile("x", [i / QUANTILES for i in range(QUANTILES + 1)], 0.1 / QUANTILES))
    if not sd:
        width = 1e-6 * max(1.0, abs(low))  # a spike
        return Noise(quantiles, low - width, width, (0.0, 1 / width, 0.0))
    h = sd * n**-0.2
    start, step = low - 4 * h, (high - low + 8 * h) / (POINTS - 1)
    counts = np.zeros(POINTS)
    for r in rows.groupBy(F.round((F.col("x") - start) / step).cast("int").alias("i")).agg(F.count("*").alias("n")).collect():
        counts[r.i] = r.n
    reach = min(POINTS, int(np.ceil(5 * h / step)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * step / h) ** 2)
    smooth = np.convolve(counts, kernel / (kernel.sum() * step), "full")[reach:-reach] / n if reach else counts / (n * step)
    return Noise(quantiles, start, step, tuple(map(float, smooth)))


@dataclass
class Choice:
    """Log-probabilities of levels: intercepts and weights of the inputs, through a softmax."""

    levels: list[str]
    inputs: list[Input] = field(default_factory=list)
    intercepts: list[float] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)

    def logs(self, of: Of) -> list[Column]:
        raw = [sum((i.column(of) * w for i, w in zip(self.inputs, ws, strict=True)), F.lit(b)) for b, ws in zip(self.intercepts, self.weights, strict=True)]
        if len(raw) == 1:
            return [raw[0] * 0]
        top = F.greatest(*raw)
        total = top + F.log(sum((F.exp(r - top) for r in raw), F.lit(0.0)))
        return [F.when(total.isNotNull(), F.greatest(r - total, F.log(F.lit(TINY)))) for r in raw]  # greatest() alone would pass over nulls


@dataclass
class Table:
    """Log-probabilities of levels for each configuration of categorical parents; unseen ones have the levels' overall shares."""

    levels: list[str]
    parents: list[str]
    rows: list[tuple[tuple[str, ...], list[float]]]
    overall: list[float]

    def logs(self, of: Of) -> list[Column]:
        if not self.parents:
            return [F.lit(x) for x in self.overall]
        key = F.concat_ws("\x1f", *[F.concat(F.lit("="), of(p)) for p in self.parents])
        found = F.create_map(*[x for k, ps in self.rows for x in (F.lit("\x1f".join(f"={v}" for v in k)), F.array(*map(F.lit, ps)))])
        here = F.coalesce(F.try_element_at(found, key), F.array(*map(F.lit, self.overall)))
        known = sum((of(p).isNull().cast("int") for p in self.parents), F.lit(0)) == 0
        return [F.when(known, here[i]) for i in range(len(self.levels))]


@dataclass
class Line:
    """Mean: intercept and weights of the inputs; the rest is noise."""

    inputs: list[Input]
    intercept: float
    weights: list[float]
    noise: Noise
    explained: float = 0.0

    def with_mean(self, df: DataFrame, of: Of, out: str) -> DataFrame:
        return df.withColumn(out, sum((i.column(of) * w for i, w in zip(self.inputs, self.weights, strict=True)), F.lit(self.intercept)))


@dataclass
class Steps:
    """Mean: boosted trees over the inputs, rounded; noise in whole steps; values are places in `levels`."""

    levels: list[str]
    inputs: list[Input]
    trees: object
    noise: Noise
    explained: float = 0.0

    def with_mean(self, df: DataFrame, of: Of, out: str) -> DataFrame:
        if self.trees is None:
            return df.withColumn(out, F.lit(0.0))
        names = [f"_in{i}" for i in range(len(self.inputs))]
        whole = sum((i.column(of).isNull().cast("int") for i in self.inputs), F.lit(0)) == 0
        wide = df.withColumn("_known", whole).withColumns({n: F.coalesce(i.column(of), F.lit(0.0)) for n, i in zip(names, self.inputs, strict=True)})
        done = self.trees.transform(VectorAssembler(inputCols=names, outputCol="_features").transform(wide))
        return done.withColumn(out, F.when(F.col("_known"), F.round("_prediction"))).drop(*names, "_features", "_prediction", "_known")

    def within(self, code: Column) -> Column:
        return F.greatest(F.least(code, F.lit(float(len(self.levels) - 1))), F.lit(0.0))


@dataclass
class Given:
    """Mean: an SQL expression that the caller gives, parents in braces (`{x} * {y}`); the rest is noise, whose own mean is `shift`.

    Where the expression gives null, so does what follows from it, and the row tells nothing of the noise.
    """

    text: str
    parents: list[str]
    noise: Noise | None = None
    shift: float = 0.0
    explained: float = 0.0

    def with_mean(self, df: DataFrame, of: Of, out: str) -> DataFrame:
        names = {p: f"_in{i}" for i, p in enumerate(self.parents)}
        text = re.sub(r"\{([^{}]*)\}", lambda found: names[found[1]], self.text)
        return df.withColumns({n: of(p) for p, n in names.items()}).withColumn(out, F.expr(text).cast("double")).drop(*names.values())


Mechanism = Choice | Table | Line | Steps | Given


@dataclass
class MixedModel:
    """A network, its nodes' kinds and levels, and their mechanisms.

    Tables that go in have categories and ordered levels as texts; inside, ordered levels are places from 0 on.
    """

    network: dict[str, list[str]]
    kinds: dict[str, str]
    levels: dict[str, list[str]]
    mechanisms: dict[str, Mechanism]

    def encoded(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: _code(F.col(n), k, self.levels.get(n)) for n, k in self.kinds.items() if n in df.columns})

    def encode(self, node: str, value: str | float) -> str | float:
        """A value as it is inside: a level's place, or itself. KeyError for a level that the table never had."""
        if self.kinds[node] == NUMBER:
            return float(value)
        if str(value) not in self.levels[node]:
            raise KeyError(f"{node}: no level {value!r}")
        return float(self.levels[node].index(str(value))) if self.kinds[node] == ORDERED else str(value)

    def decoded(self, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """columns (name: node) with places as levels again."""
        return df.withColumns({c: F.try_element_at(F.array(*map(F.lit, self.levels[n])), F.round(F.col(c)).cast("int") + 1) for c, n in columns.items() if self.kinds[n] == ORDERED})


def _code(x: Column, kind: str, levels: list[str] | None) -> Column:
    if kind == NUMBER:
        return x.cast("double")
    if kind == CATEGORY:
        return x.cast("string")
    place = F.array_position(F.array(*map(F.lit, levels or [""])), x.cast("string")) - 1
    return F.when(place >= 0, place.cast("double"))


def _inputs(parents: list[str], kinds: dict[str, str], levels: dict[str, list[str]]) -> list[Input]:
    """Numbers and places as they are; a category's levels but the first."""
    return [i for p in parents for i in ([Input(p, x) for x in levels[p][1:]] if kinds[p] == CATEGORY else [Input(p)])]


def _design(df: DataFrame, inputs: list[Input], y: str) -> tuple[DataFrame, list[str]]:
    names = [f"_in{i}" for i in range(len(inputs))]
    return df.select(*[i.column(F.col).alias(n) for n, i in zip(names, inputs, strict=True)], F.col(y).alias("_y")).dropna(), names


def _counted(rows: DataFrame) -> DataFrame:
    """rows with `_n`: the distinct ones and how often each stands, where they are few beside all, so that a pass is over them alone; else each row once."""
    n, distinct = rows.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*rows.columns))).first()
    if 4 * distinct > n:
        return rows.withColumn("_n", F.lit(1.0))
    return materialise(rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("_n")), "counted")


def fit(df: DataFrame, network: dict[str, list[str]], kinds: dict[str, str], ess: float = 0.0, penalty: float = 0.0, given: dict[str, str] | None = None) -> MixedModel:
    """Mechanisms of all nodes over the rows where they and their parents are known.

    ess: pseudo-counts of a table, spread evenly; penalty: of squared weights, for softmax regressions. Levels are those of
    the column, ordered ones in natural order. Only levels, tables of counts, weights and bins reach the driver.
    given: means of numbers as SQL expressions of their parents (`Given`), of which only the noise is fitted; a node that is
    no number, or an expression that names another node than a parent, is a ValueError.
    """
    for node, text in (given or {}).items():
        if kinds.get(node) != NUMBER or not set(re.findall(r"\{([^{}]*)\}", text)) <= set(network[node]):
            raise ValueError(f"{node}: {text!r} is no mean of a number by its parents {network.get(node)}")
    levels = {n: [r[0] for r in df.select(F.col(n).cast("string").alias(n)).where(F.col(n).isNotNull()).distinct().orderBy(natural_key(F.col(n)), n).collect()] for n, k in kinds.items() if k != NUMBER}
    blank = MixedModel(network, kinds, levels, {})
    rows = materialise(blank.encoded(df.select(*kinds)), "encoded")
    for node in topological(network):
        parents, kind = network[node], kinds[node]
        if node in (given or {}):
            blank.mechanisms[node] = _given(rows, node, Given(given[node], parents))
            continue
        if kind == CATEGORY and all(kinds[p] == CATEGORY for p in parents):
            blank.mechanisms[node] = _table(rows, node, parents, levels, ess)
            continue
        inputs = _inputs(parents, kinds, levels)
        design, names = _design(rows, inputs, node)
        if kind == CATEGORY:
            blank.mechanisms[node] = _choice(design, names, inputs, levels[node], penalty)
        elif kind == NUMBER:
            blank.mechanisms[node] = _line(design, names, inputs)
        else:
            blank.mechanisms[node] = _steps(design, names, inputs, levels[node])
    return blank


def _table(rows: DataFrame, node: str, parents: list[str], levels: dict[str, list[str]], ess: float) -> Table:
    own = levels[node]
    counts = rows.dropna(subset=[node, *parents]).groupBy(*parents, node).agg(F.count("*").alias("_n")).collect()
    by: dict[tuple[str, ...], dict[str, int]] = {}
    total = dict.fromkeys(own, 0)
    for r in counts:
        by.setdefault(tuple(r[p] for p in parents), {})[r[node]] = r["_n"]
        total[r[node]] += r["_n"]
    cells = max(1, int(np.prod([len(levels[p]) for p in parents])))

    def logs(n: dict[str, int], extra: float) -> list[float]:
        all_n = sum(n.values()) + extra
        return [float(np.log(max((n.get(x, 0) + extra / len(own)) / all_n, TINY))) if all_n else float(np.log(1 / len(own))) for x in own]

    return Table(own, parents, [(k, logs(n, ess / cells)) for k, n in sorted(by.items())], logs(total, ess))


def _choice(design: DataFrame, names: list[str], inputs: list[Input], levels: list[str], penalty: float) -> Choice:
    if len(levels) < 2:
        return Choice(levels, inputs, [0.0] * len(levels), [[0.0] * len(inputs)] * len(levels))
    place = F.array_position(F.array(*map(F.lit, levels)), F.col("_y")).cast("double") - 1
    intercepts, weights = softmax_weights(_counted(design.select(*names, place.alias("_y"))), names, len(levels), penalty)
    return Choice(levels, inputs, intercepts.tolist(), weights.tolist())


def softmax_weights(table: DataFrame, names: list[str], levels: int, penalty: float, most: int = 200, tolerance: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """Intercepts and weights (a row for each level) of the likeliest softmax regression of `_y`, the levels' places, on names; rows stand `_n` times.

    Newton's method on standardised inputs, whose squared weights the penalty is of: the loss is convex and a step needs
    one pass, of which a gradient and a Hessian come back from each task, so some ten passes do. Steps are halved until
    the loss falls, and end when one would lower it by less than the tolerance. Intercepts sum to 0, without penalty the
    weights of an input too; constant inputs weigh 0.
    """
    d, k = len(names), levels
    w = F.col("_n")
    n, *sums = table.agg(F.coalesce(F.sum(w), F.lit(0.0)), *[F.coalesce(F.sum(w * F.col(x)), F.lit(0.0)) for x in names]).first()
    mean = np.array(sums) / max(n, 1)
    squares = table.agg(*[F.coalesce(F.sum(w * (F.col(x) - float(m)) ** 2), F.lit(0.0)) for x, m in zip(names, mean, strict=True)]).first()
    sd = np.sqrt(np.array(squares, float) / max(n - 1, 1))
    scale = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0)
    shrink = np.tile([0.0] + [penalty] * d, k)
    size = k * (d + 1)
    columns = [*names, "_y", "_n"]

    def evaluate(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches):
            loss, grad, hess = 0.0, np.zeros((k, d + 1)), np.zeros((k, d + 1, k, d + 1))
            for batch in batches:
                at = np.column_stack([np.asarray(c) for c in batch.columns])
                z = np.column_stack([np.ones(len(at)), (at[:, :d] - mean) * scale])
                y, times, rows = at[:, d].astype(int), at[:, d + 1], np.arange(len(at))
                score = z @ b.T
                score -= score.max(axis=1, keepdims=True)
                p = np.exp(score)
                total = p.sum(axis=1)
                p /= total[:, None]
                loss += float(times @ (np.log(total) - score[rows, y]))
                for i in range(k):
                    for j in range(i, k):
                        block = z.T @ ((times * p[:, i] * ((i == j) - p[:, j]))[:, None] * z)
                        hess[i, :, j] += block
                        if i != j:
                            hess[j, :, i] += block
                p[rows, y] -= 1
                grad += (times[:, None] * p).T @ z
            yield pa.RecordBatch.from_arrays([pa.array([[loss, *grad.ravel(), *hess.ravel()]])], names=["sums"])

        found = np.sum([r.sums for r in table.select(*columns).mapInArrow(part, "sums array<double>").collect()], axis=0) / max(n, 1)
        flat = b.ravel()
        return found[0] + 0.5 * float(shrink @ (flat * flat)), found[1 : size + 1] + shrink * flat, found[size + 1 :].reshape(size, size) + np.diag(shrink)

    b = np.zeros((k, d + 1))
    loss, grad, hess = evaluate(b)
    for _ in range(most):
        step = -np.linalg.lstsq(hess, grad, rcond=None)[0]
        falls = -float(grad @ step)
        if falls <= tolerance:
            break
        t = 1.0
        while True:
            moved = b + t * step.reshape(k, d + 1)
            new = evaluate(moved)
            if new[0] <= loss - 1e-4 * t * falls or t < 1e-6:
                break
            t /= 2
        if new[0] > loss:  # nothing but rounding is left
            break
        b, (loss, grad, hess) = moved, new
    weights = b[:, 1:] * scale
    intercepts = b[:, 0] - weights @ mean
    return intercepts - intercepts.mean(), weights if penalty else weights - weights.mean(axis=0)


def _line(design: DataFrame, names: list[str], inputs: list[Input]) -> Line:
    _, mean, g = gram(design, [*names, "_y"])
    d = len(names)
    w = np.linalg.lstsq(g[:d, :d], g[:d, d], rcond=None)[0] if d else np.zeros(0)
    intercept = float(mean[d] - w @ mean[:d])
    left = F.col("_y") - sum((F.col(n) * float(x) for n, x in zip(names, w, strict=True)), F.lit(intercept))
    explained = float(w @ g[:d, d] / g[d, d]) if d and g[d, d] > 0 else 0.0
    return Line(inputs, intercept, [float(x) for x in w], noise_of(design.select(left.alias("x")), "x"), explained)


def _given(rows: DataFrame, node: str, m: Given) -> Given:
    left = m.with_mean(rows, F.col, "_mean").select((F.col(node) - F.col("_mean")).alias("x"), F.col(node).alias("y")).dropna()
    e = left.agg(F.avg("x").alias("shift"), F.var_pop("x").alias("e"), F.var_pop("y").alias("v")).first()
    return Given(m.text, m.parents, noise_of(left, "x"), e.shift or 0.0, 1 - e.e / e.v if e.v else 0.0)


def _steps(design: DataFrame, names: list[str], inputs: list[Input], levels: list[str]) -> Steps:
    counted = _counted(design)
    if not inputs:
        return Steps(levels, inputs, None, whole_noise(counted, "_y", "_n"))
    table = materialise(VectorAssembler(inputCols=names, outputCol="_features").transform(counted).select("_features", "_y", "_n"), "design")
    trees = GBTRegressor(featuresCol="_features", labelCol="_y", weightCol="_n", predictionCol="_prediction", maxIter=20, maxDepth=4, maxBins=256, stepSize=0.3, seed=1).fit(table)
    done = trees.transform(table)
    mean = table.agg(F.sum(F.col("_n") * F.col("_y")) / F.sum("_n")).first()[0]
    e = done.agg(*[F.sum(F.col("_n") * (F.col("_y") - x) ** 2).alias(name) for name, x in (("e", F.col("_prediction")), ("v", F.lit(mean)))]).first()
    return Steps(levels, inputs, trees, whole_noise(done.select((F.col("_y") - F.round("_prediction")).alias("x"), "_n"), "x", "_n"), 1 - e.e / e.v if e.v else 0.0)


def probabilities(df: DataFrame, model: MixedModel, node: str) -> DataFrame:
    """df with p_<level> for each level of a category, given its parents in the row."""
    m = model.mechanisms[node]
    if not isinstance(m, Choice | Table):
        raise TypeError(f"{node} is no category")
    rows = model.encoded(df)
    return rows.withColumns({f"p_{x}": F.exp(log_p) for x, log_p in zip(m.levels, m.logs(F.col), strict=True)})


def abducted_levels(df: DataFrame, model: MixedModel, node: str, keys: list[str], seed: int = 0) -> DataFrame:
    """df with `again`: the node's level from its parents and the noise that its observed level tells of; always the observed one."""
    m = model.mechanisms[node]
    places = range(len(m.levels))
    out = model.encoded(df).withColumns({f"_s{i}": x for i, x in enumerate(m.logs(F.col))})  # columns, so that each is computed once
    noise = abducted(node, F.col(node), m.levels, [F.col(f"_s{i}") for i in places], seed, [F.col(k) for k in keys])
    out = out.withColumns({f"_m{i}": F.col(f"_s{i}") + g for i, g in enumerate(noise)})
    return out.withColumn("again", likeliest(m.levels, [F.col(f"_m{i}") for i in places])).drop(*[f"_{k}{i}" for k in "sm" for i in places])


def counterfactual(rows: DataFrame, model: MixedModel, do: dict[str, str | float], draws: int = 1, seed: int = 0, targets: list[str] | None = None) -> DataFrame:
    """rows with draw and cf_<node> for each node: its value had the nodes in do been set.

    rows need `id` and all nodes. A number keeps its residual, an ordered level its steps of noise (within its levels), a
    category's noise is drawn given what was observed. Nodes that are not below an intervention keep their values; a null
    above makes a null. Rows are dealt to as many tasks as shuffles have before they are multiplied.
    """
    below = set().union(*[descendants(model.network, d) for d in do]) - set(do)
    wanted, todo = set(), list(model.network if targets is None else targets)
    while todo:
        if (n := todo.pop()) not in wanted:
            wanted.add(n)
            todo += model.network[n] if n in below else []
    spark = rows.sparkSession
    out = model.encoded(rows).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    out = out.crossJoin(F.broadcast(spark.range(draws).select(F.col("id").alias("draw"))))
    keys = [F.col("id"), F.col("draw")]
    moved: Of = lambda p: F.col(f"cf_{p}")
    for node in (n for n in topological(model.network) if n in wanted):
        m = model.mechanisms[node]
        if node in do:
            out = out.withColumn(f"cf_{node}", F.lit(model.encode(node, do[node])))
        elif node not in below:
            out = out.withColumn(f"cf_{node}", F.col(node))
        elif isinstance(m, Choice | Table):
            seen = m.logs(F.col)
            out = out.withColumns({f"_s{i}": x for i, x in enumerate(seen)} | {f"_m{i}": x for i, x in enumerate(m.logs(moved))})
            places = range(len(m.levels))
            noise = abducted(node, F.col(node), m.levels, [F.col(f"_s{i}") for i in places], seed, keys)
            out = out.withColumns({f"_g{i}": g for i, g in enumerate(noise)})
            out = out.withColumn(f"cf_{node}", likeliest(m.levels, [F.col(f"_m{i}") + F.col(f"_g{i}") for i in places])).drop(*[f"_{k}{i}" for k in "smg" for i in places])
        else:
            out = m.with_mean(m.with_mean(out, F.col, "_was"), moved, "_is")
            value = F.col(node) - F.col("_was") + F.col("_is")
            out = out.withColumn(f"cf_{node}", m.within(value) if isinstance(m, Steps) else value).drop("_was", "_is")
    return model.decoded(out, {n: n for n in model.network} | {f"cf_{n}": n for n in wanted})


def sample(spark: SparkSession, model: MixedModel, n: int, seed: int = 0, do: dict | None = None, evidence: dict | None = None) -> DataFrame:
    """id, the nodes (inside values) and weight: n draws in topological order.

    What is set or given keeps its value; what is given weights a draw: a level by its probability, a number by the density
    of the noise that it would need. A draw depends on seed, node and id only.
    """
    do = {k: model.encode(k, v) for k, v in (do or {}).items()}
    evidence = {k: model.encode(k, v) for k, v in (evidence or {}).items()}
    out = spark.range(n).withColumn("weight", F.lit(1.0))
    for node in topological(model.network):
        m, u = model.mechanisms[node], uniform(seed, F.lit(node), F.col("id"))
        if node in do:
            out = out.withColumn(node, F.lit(do[node]))
        elif isinstance(m, Choice | Table):
            logs = m.logs(F.col)
            if node in evidence:
                p = F.exp(logs[m.levels.index(evidence[node])])
                out = out.withColumn("weight", F.col("weight") * p).withColumn(node, F.lit(evidence[node]))
            else:
                scores = [x + gumbel(uniform(seed, F.lit(node), F.lit(level), F.col("id"))) for level, x in zip(m.levels, logs, strict=True)]
                out = out.withColumns({f"_s{i}": s for i, s in enumerate(scores)})
                out = out.withColumn(node, likeliest(m.levels, [F.col(f"_s{i}") for i in range(len(scores))])).drop(*[f"_s{i}" for i in range(len(scores))])
        else:
            out = m.with_mean(out, F.col, "_mean")
            if node in evidence:
                out = out.withColumn("weight", F.col("weight") * m.noise.weight(F.lit(evidence[node]) - F.col("_mean"))).withColumn(node, F.lit(evidence[node]))
            else:
                value = F.col("_mean") + m.noise.draw(u)
                out = out.withColumn(node, m.within(value) if isinstance(m, Steps) else value)
            out = out.drop("_mean")
    return out


@dataclass
class Summary:
    """What weighted rows say of a target: mean and sd of a number, probabilities of levels; effective rows; how it was found."""

    target: str
    backend: str
    mean: float | None = None
    sd: float | None = None
    probabilities: dict[str, float] = field(default_factory=dict)
    ess: float | None = None

    @property
    def low_confidence(self) -> bool:
        return self.ess is not None and self.ess < LOW_ESS


def summaries(drawn: DataFrame, model: MixedModel, targets: list[str], backend: str) -> dict[str, Summary]:
    """All targets from the same weighted draws; ValueError if none has weight."""
    total = drawn.agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("s2")).first()
    if not total.s:
        raise ValueError("the evidence has no weight in any draw")
    ess, out = total.s**2 / total.s2, {}
    for t in targets:
        if model.kinds[t] == NUMBER:
            mean = drawn.agg(F.sum(F.col("weight") * F.col(t)) / total.s).first()[0]
            off = F.col(t) - F.lit(mean)
            out[t] = Summary(t, backend, mean, max(drawn.agg(F.sum(F.col("weight") * off * off) / total.s).first()[0], 0.0) ** 0.5, ess=ess)
        else:
            rows = model.decoded(drawn.groupBy(t).agg((F.sum("weight") / total.s).alias("p")), {t: t}).collect()
            out[t] = Summary(t, backend, probabilities={r[t]: r.p for r in rows}, ess=ess)
    return out
