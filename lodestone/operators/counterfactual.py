"""Counterfactuals of observed rows: abduct the noise, act, predict.

Categorical nodes use the Gumbel-max coupling, which is one of many that the data allow; numeric ones additive noise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import gumbel, uniform
from lodestone.operators.inference import descendants, topological
from lodestone.operators.mechanisms import Intervention, applied
from lodestone.storage import broadcast_if_small, materialise

TINY = 1e-300


def _log_sum(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def abducted(node: str, observed: Column, levels: list[str], logs: list[Column], seed: int, keys: list[Column]) -> list[Column]:
    """Gumbel noise of each level, given that the node was `observed` where its levels had these log-probabilities.

    The observed level's score is the largest of all, one standard Gumbel draw; the others' lie below it. A level of
    probability 0 keeps a free draw. Draws are hashes of seed, node, level and keys.
    """
    top = gumbel(uniform(seed, F.lit(node), F.lit("top"), *keys))

    def noise(level: str, log_p: Column) -> Column:
        free = gumbel(uniform(seed, F.lit(node), F.lit(level), *keys))
        return F.when(observed == level, top - log_p).otherwise(-_log_sum(-free - log_p, -top) - log_p)

    return [noise(level, log_p) for level, log_p in zip(levels, logs, strict=True)]


def likeliest(levels: list[str], scores: list[Column]) -> Column:
    """The level of the largest score, of equals the first; null where scores are null."""
    if len(levels) == 1:
        return F.when(scores[0].isNotNull(), levels[0])
    best = F.greatest(*scores)
    out = F.lit(None).cast("string")
    for level, score in reversed(list(zip(levels, scores, strict=True))):
        out = F.when(score == best, F.lit(level)).otherwise(out)
    return F.when(best.isNotNull(), out)


def numbered(rows: DataFrame, columns: list[str], chunk: int = 1000) -> DataFrame:
    """The columns of rows with `id`, which tells equal rows apart and depends on nothing else: not on order or partitions.

    Equal rows are counted and dealt out again in chunks, so that a row that a third of the table repeats is no task's own.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    begins = counts.withColumn("_from", F.explode(F.expr(f"sequence(0L, _n - 1, {chunk}L)")))
    dealt = begins.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns, "_from")
    each = dealt.withColumn("_k", F.explode(F.expr(f"sequence(_from, least(_from + {chunk}L, _n) - 1)")))
    return each.select(*columns, F.xxhash64(*columns, "_k").alias("id"))


def counterfactual(rows: DataFrame, tables: dict[str, DataFrame], network: dict[str, list[str]], do: dict[str, str], draws: int = 200, seed: int = 0, targets: list[str] | None = None) -> DataFrame:
    """rows with draw and, for each node, cf_<node>: its value had the nodes in do been set, in `draws` worlds each.

    rows need a column for each node and an `id`. Nodes that are neither set nor below a set one keep their values.
    Without interventions every world equals the observed row. With targets, only they and the nodes between them and the
    interventions get a column. Rows are dealt to as many tasks as shuffles have before they are multiplied. A node keeps
    its observed value where its parents have values that its table does not hold.
    """
    below = set().union(*[descendants(network, d) for d in do]) - set(do)
    wanted, todo = set(), list(network if targets is None else targets)
    while todo:  # targets and what lies above them, up to what is set or stays
        if (n := todo.pop()) not in wanted:
            wanted.add(n)
            todo += network[n] if n in below else []
    spark = rows.sparkSession
    out = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    order = [n for n in topological(network) if n in wanted]
    drawn = [n for n in order if n in below and n not in do]
    for node in (n for n in order if n not in drawn):
        out = out.withColumn(f"cf_{node}", F.lit(do[node]) if node in do else F.col(node))
    levels: dict[str, list[str]] = {}
    logs: dict[str, DataFrame] = {}

    def looked_up(out: DataFrame, node: str, name: str, of: str) -> DataFrame:
        """out with the log-probabilities of the node's levels, given its parents as `of` has them."""
        parents = network[node]
        table = logs[node].select(*[F.col(x).alias(f"{of}{x}") for x in parents], *[F.col(f"_{i}").alias(f"_{name}{i}_{node}") for i in range(len(levels[node]))])
        return out.join(broadcast_if_small(table), [f"{of}{x}" for x in parents], "left")

    def rivals(out: DataFrame, node: str) -> DataFrame:
        """out with what each level gains, and whether it may win: only those that gain more than the observed one can, as its score was the largest.

        With an unknown level or probability all may.
        """
        places = range(len(levels[node]))
        out = out.withColumns({f"_gain{i}_{node}": F.col(f"_new{i}_{node}") - F.col(f"_seen{i}_{node}") for i in places})
        own = F.coalesce(*[F.when(F.col(node) == x, F.col(f"_gain{i}_{node}")) for i, x in enumerate(levels[node])])
        out = out.withColumn(f"_own_{node}", own)
        out = out.withColumns({f"_may{i}_{node}": F.coalesce(F.col(f"_gain{i}_{node}") > F.col(f"_own_{node}"), F.lit(True)) for i in places})
        return out.withColumn(f"_open_{node}", reduce(Column.__or__, [F.col(f"_may{i}_{node}") for i in places]))

    for node in drawn:  # what doesn't differ between worlds is found before they are made
        levels[node] = [r[0] for r in tables[node].select(F.col(node).cast("string")).distinct().orderBy(node).collect()]
        p = [F.coalesce(F.max(F.when(F.col(node) == x, F.col("p"))), F.lit(0.0)) for x in levels[node]]
        logs[node] = materialise(tables[node].groupBy(*network[node]).agg(*[F.log(F.greatest(v, F.lit(TINY))).alias(f"_{i}") for i, v in enumerate(p)]), "levels")
        out = looked_up(out, node, "seen", "")
        if not set(network[node]) & set(drawn):
            out = rivals(looked_up(out, node, "new", "cf_"), node)
    out = out.crossJoin(F.broadcast(spark.range(draws).select(F.col("id").alias("draw"))))
    keys = [F.col("id"), F.col("draw")]
    for node in drawn:
        if set(network[node]) & set(drawn):
            out = rivals(looked_up(out, node, "new", "cf_"), node)
        places = range(len(levels[node]))
        # columns of their own, so that each draw is made once: the observed level's score is `top`, the others' lie below it (see abducted)
        out = out.withColumn(f"_top_{node}", F.when(F.col(f"_open_{node}"), gumbel(uniform(seed, F.lit(node), F.lit("top"), *keys))))
        out = out.withColumns({f"_free{i}_{node}": F.when(F.col(f"_may{i}_{node}"), -gumbel(uniform(seed, F.lit(node), F.lit(x), *keys)) - F.col(f"_seen{i}_{node}")) for i, x in enumerate(levels[node])})
        top = F.col(f"_top_{node}")
        kept = [F.when(F.col(node) == x, top).otherwise(-_log_sum(F.col(f"_free{i}_{node}"), -top)) for i, x in enumerate(levels[node])]
        out = out.withColumns({f"_score{i}_{node}": F.col(f"_new{i}_{node}") + (k - F.col(f"_seen{i}_{node}")) for i, k in enumerate(kept)})
        best = likeliest(levels[node], [F.col(f"_score{i}_{node}") for i in places])
        out = out.withColumn(f"cf_{node}", F.coalesce(best, F.col(node)))
    return out.drop(*[f"_{k}{i}_{n}" for n in drawn for k in ("seen", "new", "gain", "may", "free", "score") for i in range(len(levels[n]))], *[f"_{k}_{n}" for n in drawn for k in ("own", "open", "top")])


def answer(worlds: DataFrame, target: str) -> DataFrame:
    """level and p of the target over all rows and draws."""
    n = worlds.groupBy(F.col(f"cf_{target}").alias("level")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_all")))).select("level", (F.col("n") / F.col("_all")).alias("p"))


def agreement(worlds: DataFrame, target: str, truth: str) -> DataFrame:
    """rate at which the counterfactual target equals the column of the true one."""
    return worlds.agg(F.avg((F.col(f"cf_{target}") == F.col(truth)).cast("double")).alias("rate"))


def linear_counterfactual(rows: DataFrame, weights: dict[str, dict[str, float]], do: dict[str, Intervention]) -> DataFrame:
    """rows with cf_<node> for a linear model with additive noise: each residual is kept, so a node moves by what its parents do. A soft intervention is a function of the value that the node would have had."""
    out = rows
    for node in topological({x: list(w) for x, w in weights.items()}):
        moved = F.col(node) + sum(((F.col(f"cf_{p}") - F.col(p)) * w for p, w in weights[node].items()), F.lit(0.0))
        out = out.withColumn(f"cf_{node}", applied(do[node], moved) if node in do else moved)
    return out
