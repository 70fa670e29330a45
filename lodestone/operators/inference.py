"""Queries on discrete networks: exact by joins of tables, or by sampling with deterministic random numbers.

A network is {node: parents}; its tables are {node: DataFrame(parents, node, p)}.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import normal, uniform
from lodestone.storage import broadcast_if_small

LOW_ESS = 100.0


def topological(network: dict[str, list[str]]) -> list[str]:
    """Parents before children, of equals by name; ValueError on a cycle."""
    left, out = {n: set(p) for n, p in network.items()}, []
    while left:
        ready = sorted(n for n, p in left.items() if not p & left.keys())
        if not ready:
            raise ValueError(f"cycle among {sorted(left)}")
        out += ready
        for n in ready:
            del left[n]
    return out


def descendants(network: dict[str, list[str]], node: str) -> set[str]:
    found, todo = set(), [node]
    while todo:
        at = todo.pop()
        new = {n for n, p in network.items() if at in p} - found
        found |= new
        todo += new
    return found


def fit(df: DataFrame, network: dict[str, list[str]], ess: float = 0.0) -> dict[str, DataFrame]:
    """The tables of all nodes, from one pass over the rows."""
    from lodestone.operators.cpt import cpt, joint_counts

    joint = joint_counts(df, list(network))
    return {n: cpt(joint, n, p, ess) for n, p in network.items()}


def _product(a: DataFrame, b: DataFrame) -> DataFrame:
    shared = [c for c in a.columns if c in b.columns and c != "p"]
    right = b.withColumnRenamed("p", "_q")
    joined = a.join(right, shared) if shared else a.crossJoin(right)
    return joined.withColumn("p", F.col("p") * F.col("_q")).drop("_q")


def eliminate(factors: list[DataFrame], keep: list[str], evidence: dict[str, str] | None = None) -> DataFrame:
    """keep and p (normalised): the factors' product, reduced to the evidence, summed over all else.

    Variables go one at a time, the one whose joined factor has the fewest columns first; each step joins only the
    factors that hold it and sums it out, so no joint table over all variables is made.
    """
    factors = [reduce(lambda f, e: f.where(F.col(e[0]) == e[1]).drop(e[0]) if e[0] in f.columns and e[0] not in keep else f.where(F.col(e[0]) == e[1]) if e[0] in f.columns else f, (evidence or {}).items(), f) for f in factors]
    rest = {c for f in factors for c in f.columns} - {"p", *keep}
    while rest:
        width = {v: len({c for f in factors if v in f.columns for c in f.columns}) for v in rest}
        v = min(sorted(rest), key=width.__getitem__)
        joined = reduce(_product, [f for f in factors if v in f.columns])
        factors = [f for f in factors if v not in f.columns] + [joined.groupBy(*[c for c in joined.columns if c not in (v, "p")]).agg(F.sum("p").alias("p"))]
        rest.discard(v)
    out = reduce(_product, factors)
    total = out.agg(F.sum("p").alias("_all"))
    return out.groupBy(*keep).agg(F.sum("p").alias("p")).crossJoin(F.broadcast(total)).select(*keep, (F.col("p") / F.col("_all")).alias("p"))


def mechanism_applies(network: dict[str, list[str]], target: str, evidence: dict) -> bool:
    """The target's own table answers: it has parents, all are given, and nothing given lies below it."""
    return bool(network[target]) and set(network[target]) <= set(evidence) and not descendants(network, target) & set(evidence)


def condition(tables: dict[str, DataFrame], network: dict[str, list[str]], target: str, evidence: dict[str, str]) -> DataFrame:
    """target and p given the evidence: from the target's own table where that suffices, else by elimination of what matters."""
    if target in evidence:
        raise ValueError(f"{target} is both target and evidence")
    if unknown := ({target, *evidence} - set(network)):
        raise KeyError(f"unknown: {sorted(unknown)}")
    if mechanism_applies(network, target, evidence):
        own = tables[target]
        for p in network[target]:
            own = own.where(F.col(p) == evidence[p])
        return own.select(target, "p")
    needed, todo = set(), [target, *evidence]
    while todo:  # ancestors of target and evidence; the other tables sum to one
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += network[n]
    return eliminate([tables[n] for n in sorted(needed)], [target], evidence)


def intervene(tables: dict[str, DataFrame], network: dict[str, list[str]], target: str, do: dict[str, str], evidence: dict[str, str] | None = None) -> DataFrame:
    """target and p after do: the tables of what is set are dropped and its value put into the others."""
    if target in do or (evidence and set(evidence) & set(do)):
        raise ValueError("a node is set and asked for or given at once")
    cut = {n: [] if n in do else p for n, p in network.items()}
    spark = next(iter(tables.values())).sparkSession
    fixed = {n: spark.range(1).select(F.lit(v).alias(n), F.lit(1.0).alias("p")) for n, v in do.items()}
    needed, todo = set(), [target, *(evidence or {})]
    while todo:
        n = todo.pop()
        if n not in needed:
            needed.add(n)
            todo += cut[n]
    return eliminate([fixed.get(n, tables[n]) for n in sorted(needed)], [target], evidence)


def intervene_rows(rows: DataFrame, tables: dict[str, DataFrame], network: dict[str, list[str]], target: str, do: dict[str, str]) -> DataFrame:
    """target and p after do for given rows, such as those of an entity or a sub-population: what is not below the
    interventions stays as it was observed in these rows, in the shares that they have; ValueError if there are none."""
    if target in do:
        raise ValueError("a node is set and asked for at once")
    below = set().union(*[descendants(network, d) for d in do])
    kept = sorted(set(network) - below - set(do))
    spark = rows.sparkSession
    seen = rows.select(*[F.col(n).cast("string").alias(n) for n in kept]).dropna().groupBy(*kept).agg(F.count("*").cast("double").alias("p"))
    if not kept or seen.isEmpty():
        raise ValueError("no rows to intervene on")
    fixed = [spark.range(1).select(F.lit(v).alias(n), F.lit(1.0).alias("p")) for n, v in do.items()]
    return eliminate([seen, *fixed, *[tables[n] for n in sorted(below - set(do))]], [target])


def answers_for(tables: dict[str, DataFrame], network: dict[str, list[str]], targets: list[str] | None, evidence: dict[str, str] | None = None, do: dict[str, str] | None = None) -> DataFrame:
    """node, level, p for each target (by default all nodes that are neither set nor given): one row of answers for a whole board."""
    given = {*(evidence or {}), *(do or {})}
    wanted = list(dict.fromkeys(targets)) if targets is not None else [n for n in topological(network) if n not in given]
    if not wanted:
        raise ValueError("no targets")
    one = lambda t: intervene(tables, network, t, do, evidence) if do else condition(tables, network, t, evidence or {})
    return reduce(DataFrame.unionByName, [one(t).select(F.lit(t).alias("node"), F.col(t).alias("level"), "p") for t in wanted])


def effect(tables: dict[str, DataFrame], network: dict[str, list[str]], target: str, do: dict[str, str], reference: dict[str, str]) -> DataFrame:
    """target and difference of its probabilities under do and under reference, over the levels of both."""
    a, b = (intervene(tables, network, target, x).select(F.col(target), F.col("p").alias(name)) for x, name in ((do, "pa"), (reference, "pb")))
    return a.join(b, target, "full_outer").select(target, (F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0))).alias("difference"))


def backdoor_effect(df: DataFrame, treatment: str, outcome: str, adjust: list[str], treated: str, control: str) -> DataFrame:
    """effect: sum over strata of p(stratum) * (mean outcome if treated - mean if control), over strata that have both."""
    arm = F.col(treatment).cast("string")
    strata = df.groupBy(*adjust).agg(F.count("*").alias("n"), F.avg(F.when(arm == treated, F.col(outcome))).alias("m1"), F.avg(F.when(arm == control, F.col(outcome))).alias("m0"))
    both = strata.where("m1 IS NOT NULL AND m0 IS NOT NULL")
    return both.agg((F.sum(F.col("n") * (F.col("m1") - F.col("m0"))) / F.sum("n")).alias("effect"))


def _rows(table: DataFrame, parents: list[str], node: str) -> DataFrame:
    """parents, and the table's row for them as arrays `_levels` and `_ps`, ordered by level."""
    return table.groupBy(*parents).agg(F.array_sort(F.collect_list(F.struct(F.col(node).alias("level"), "p"))).alias("_row")).select(*parents, F.col("_row.level").alias("_levels"), F.col("_row.p").alias("_ps"))


def _choose(u: Column) -> Column:
    """The level at which the running sum `_sums` passes u."""
    below = F.size(F.filter("_sums", lambda c: c < u))
    return F.element_at("_levels", F.least(below + 1, F.size("_levels")))


def _summed(rows: DataFrame) -> DataFrame:
    """rows with `_sums`, the running sums of `_ps`: made once for each row of a table, not for each draw."""
    sums = F.aggregate("_ps", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + x)))
    return rows.withColumn("_sums", sums)


def sample(spark: SparkSession, tables: dict[str, DataFrame], network: dict[str, list[str]], n: int, seed: int = 0, do: dict[str, str] | None = None, evidence: dict[str, str] | None = None) -> DataFrame:
    """id, a column for each node and weight: n draws in topological order; what is set or given keeps its value, and what
    is given weights the draw by its probability (likelihood weighting). A draw depends on seed, node and id only."""
    out = spark.range(n).withColumn("weight", F.lit(1.0))
    for node in topological(network):
        if node in (do or {}):
            out = out.withColumn(node, F.lit(do[node]))
            continue
        rows = broadcast_if_small(_summed(_rows(tables[node], network[node], node)))
        out = out.join(rows, network[node], "left") if network[node] else out.crossJoin(rows)
        if node in (evidence or {}):
            out = out.withColumn(node, F.lit(evidence[node])).withColumn("weight", F.col("weight") * F.coalesce(F.try_element_at(F.map_from_arrays("_levels", "_ps"), F.lit(evidence[node])), F.lit(0.0)))
        else:
            out = out.withColumn(node, _choose(uniform(seed, F.lit(node), F.col("id"))))
        out = out.drop("_levels", "_ps", "_sums")
    return out


def weighted_answer(drawn: DataFrame, target: str) -> DataFrame:
    """target, p and the draws' effective size, with low_confidence below LOW_ESS; ValueError if no draw has weight."""
    one = drawn.agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("s2")).first()
    if not one.s:
        raise ValueError("the evidence has probability 0 in all draws")
    ess = one.s**2 / one.s2
    return drawn.groupBy(target).agg((F.sum("weight") / one.s).alias("p")).withColumns({"ess": F.lit(ess), "low_confidence": F.lit(ess < LOW_ESS)})


def linear_gaussian_sample(spark: SparkSession, weights: dict[str, dict[str, float]], intercepts: dict[str, float], sds: dict[str, float], n: int, seed: int = 0, do: dict[str, float] | None = None) -> DataFrame:
    """n draws of a linear model with normal noise; what is set keeps its value."""
    out = spark.range(n)
    for node in topological({x: list(w) for x, w in weights.items()}):
        mean = sum((F.col(p) * w for p, w in weights[node].items()), F.lit(intercepts[node]))
        out = out.withColumn(node, F.lit(float(do[node])) if node in (do or {}) else mean + sds[node] * normal(seed, F.lit(node), F.col("id")))
    return out
