"""Conditional questions by the cheapest way that answers them: a mechanism, exact elimination, weighted draws, or matching of draws or rows.

Mixed models take numeric evidence too: a draw is weighted by the density of the noise that the evidence needs, and rows
are matched to it by a Gaussian kernel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import inference
from lodestone.operators.mixed_model import CATEGORY, NUMBER, Choice, Given, Line, MixedModel, Summary, Table, sample, summaries

#: Cells that the largest table of an elimination may have.
MOST_CELLS = 1_000_000
#: Kernel widths beyond which a row has no weight.
REACH = 6.0
BACKENDS = ("mechanism", "elimination", "likelihood-weighting", "rejection")


def elimination_cells(network: dict[str, list[str]], sizes: dict[str, int], wanted: set[str], given: set[str]) -> int:
    """Cells of the largest table on the way from all tables that matter to that of `wanted`, by the order that elimination takes."""
    needed, todo = set(), [*wanted, *given]
    while todo:
        if (n := todo.pop()) not in needed:
            needed.add(n)
            todo += network[n]
    scopes = [{n, *network[n]} - given for n in sorted(needed)]
    rest, most = set().union(*scopes) - wanted, 1
    cells = lambda scope: 1 if not scope else cells(scope - {min(scope)}) * sizes[min(scope)]
    most = max([cells(s) for s in scopes], default=1)
    while rest:
        joined = {v: set().union(*[s for s in scopes if v in s]) for v in rest}
        v = min(sorted(rest), key=lambda v: len(joined[v]))
        most = max(most, cells(joined[v]))
        scopes = [s for s in scopes if v not in s] + [joined[v] - {v}]
        rest.discard(v)
    return most


def _tables(spark: SparkSession, model: MixedModel) -> dict[str, DataFrame]:
    out = {}
    for n, m in model.mechanisms.items():
        if isinstance(m, Table):
            rows = [(*k, x, p) for k, logs in m.rows for x, p in zip(m.levels, logs, strict=True)]
            schema = ", ".join([*[f"`{p}` string" for p in m.parents], f"`{n}` string", "p double"])
            out[n] = spark.createDataFrame(rows, schema).withColumn("p", F.exp("p"))
    return out


def _mechanism(spark: SparkSession, model: MixedModel, target: str, evidence: dict) -> Summary:
    m = model.mechanisms[target]
    one = model.encoded(spark.range(1).select(*[F.lit(evidence[p]).alias(p) for p in model.network[target]]))
    if isinstance(m, Choice | Table):
        row = one.select(*[F.exp(x).alias(f"_{i}") for i, x in enumerate(m.logs(F.col))]).first()
        return Summary(target, "mechanism", probabilities=dict(zip(m.levels, row, strict=True)))
    mean = m.with_mean(one, F.col, "_mean").first()["_mean"]
    if isinstance(m, Line | Given):  # the noise of least squares has mean 0
        grid = [(m.noise.low + i * m.noise.step, d * m.noise.step) for i, d in enumerate(m.noise.density)]
        first = sum(x * p for x, p in grid)
        return Summary(target, "mechanism", mean + (m.shift if isinstance(m, Given) else 0.0), max(sum((x - first) ** 2 * p for x, p in grid), 0.0) ** 0.5)
    p: dict[str, float] = {}
    for i, share in enumerate(m.noise.density):
        level = m.levels[int(min(max(mean + m.noise.low + i, 0), len(m.levels) - 1))]
        p[level] = p.get(level, 0.0) + share
    return Summary(target, "mechanism", probabilities=p)


def condition(spark: SparkSession, model: MixedModel, targets: str | list[str], evidence: dict, backend: str = "auto", n: int = 20_000, seed: int = 0, most_cells: int = MOST_CELLS) -> dict[str, Summary]:
    """Each target given the evidence.

    auto: those whose own mechanism answers (all parents given, nothing given below) by it; the rest, where all that
    matters has tables and no table on the way has more than `most_cells` cells, by elimination; else all from one set of
    weighted draws, so that they agree. `rejection` matches draws that ignore the evidence: levels exactly, numbers by a
    kernel. ValueError if the evidence has no weight, if a target is given, or if the backend cannot answer.
    """
    targets = [targets] if isinstance(targets, str) else list(dict.fromkeys(targets))
    if backend not in ("auto", *BACKENDS):
        raise ValueError(f"unknown backend {backend!r}")
    if both := set(targets) & set(evidence):
        raise ValueError(f"asked for and given: {sorted(both)}")
    if unknown := {*targets, *evidence} - set(model.network):
        raise KeyError(f"unknown: {sorted(unknown)}")
    inside = {k: model.encode(k, v) for k, v in evidence.items()}
    out: dict[str, Summary] = {}
    if backend in ("auto", "mechanism"):
        out = {t: _mechanism(spark, model, t, evidence) for t in targets if inference.mechanism_applies(model.network, t, evidence)}
    left = [t for t in targets if t not in out]
    if left and backend in ("auto", "elimination"):
        above, todo = set(), [*left, *evidence]
        while todo:
            if (x := todo.pop()) not in above:
                above.add(x)
                todo += model.network[x]
        sizes = {x: len(levels) for x, levels in model.levels.items()}
        exact = all(isinstance(model.mechanisms[x], Table) for x in above)
        fits = exact and max(elimination_cells(model.network, sizes, {t}, set(evidence)) for t in left) <= most_cells
        if fits or (exact and backend == "elimination"):
            tables = _tables(spark, model)
            for t in left:
                out[t] = Summary(t, "elimination", probabilities={r[t]: r.p for r in inference.condition(tables, model.network, t, inside).collect()})
            left = []
    if left and backend in ("auto", "likelihood-weighting"):
        out |= summaries(sample(spark, model, n, seed, evidence=evidence), model, left, "likelihood-weighting")
        left = []
    if left and backend == "rejection":
        out |= summaries(matched(sample(spark, model, n, seed), model, inside), model, left, "rejection")
        left = []
    if left:
        raise ValueError(f"{backend} cannot answer for {left}")
    return {t: out[t] for t in targets}


def matched(drawn: DataFrame, model: MixedModel, inside: dict) -> DataFrame:
    """The draws that agree with the evidence's levels, weighted by a Gaussian kernel of its numbers; others are filtered before."""
    numbers = [k for k in inside if model.kinds[k] == NUMBER]
    for k, v in inside.items():
        if k not in numbers:
            drawn = drawn.where(F.col(k) == v)
    n, *sds = drawn.agg(F.count("*"), *[F.stddev_pop(k) for k in numbers]).first()
    weight = F.lit(1.0)
    for k, sd in zip(numbers, sds, strict=True):
        width = (sd or 1e-12) * max(n, 1) ** (-1 / (4 + len(numbers)))
        z = (F.col(k) - inside[k]) / width
        drawn = drawn.where(F.col(k).between(inside[k] - REACH * width, inside[k] + REACH * width))
        weight = weight * F.exp(-0.5 * z * z)
    return drawn.withColumn("weight", weight)


def kernel_means(rows: DataFrame, questions: DataFrame, target: str, numbers: dict[str, float], levels: tuple[str, ...] = (), reach: float = REACH) -> DataFrame:
    """question, mean and ess: for each question the mean of target over the rows near it.

    questions: `question` and a value for each column in numbers (with its kernel's width) and levels (equal in both).
    Rows and questions meet by the first number's cell of width 2 * reach * width, each question in the two cells that it
    can reach, and by the levels, so that no row meets a question out of its reach there; nulls meet nothing. A question
    that no row is near has no row.
    """
    first, width = next(iter(numbers.items()))
    size = 2 * reach * width
    cell = lambda x: F.floor(x / size).cast("long")
    asked = questions.select("question", *[F.col(c).alias(f"_q_{c}") for c in (*numbers, *levels)])
    here = F.col(f"_q_{first}").cast("double")
    asked = asked.withColumn("_cell", F.explode(F.sequence(cell(here - reach * width), cell(here + reach * width))))
    near = rows.where(F.col(target).isNotNull()).withColumn("_cell", cell(F.col(first).cast("double")))
    joined = near.join(asked, (near["_cell"] == asked["_cell"]) & F.expr(" AND ".join(["true", *[f"`{c}` = `_q_{c}`" for c in levels]])))
    weight = F.lit(1.0)
    for c, w in numbers.items():
        z = (F.col(c) - F.col(f"_q_{c}")) / w
        joined = joined.where(F.abs(z) <= reach)
        weight = weight * F.exp(-0.5 * z * z)
    got = joined.select("question", weight.alias("_w"), F.col(target).cast("double").alias("_y")).groupBy("question").agg(F.sum("_w").alias("s"), F.sum(F.col("_w") * F.col("_w")).alias("s2"), F.sum(F.col("_w") * F.col("_y")).alias("sy"))
    return got.where("s > 0").select("question", (F.col("sy") / F.col("s")).alias("mean"), (F.col("s") * F.col("s") / F.col("s2")).alias("ess"))
