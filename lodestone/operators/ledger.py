"""Edges found by several runs: ledger, selection, metrics, alignment with variables, prior matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ledger(edges: DataFrame) -> DataFrame:
    """src, dst, freq, methods, adjacency_freq and conflict of each oriented edge of the runs (run, method, src, dst)."""
    one = edges.groupBy("src", "dst").agg(F.count_distinct("run").alias("freq"), F.sort_array(F.collect_set("method")).alias("methods"))
    back = one.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("freq").alias("back"))
    return one.join(back, ["src", "dst"], "left").select("src", "dst", "freq", "methods", (F.col("freq") + F.coalesce("back", F.lit(0))).alias("adjacency_freq"), F.col("back").isNotNull().alias("conflict"))


def selected(found: DataFrame, allowed: set[tuple[str, str]] | None = None, min_freq: int = 1, top_k: int | None = None) -> list[tuple[str, str]]:
    """A greedy acyclic choice by frequency, adjacency frequency and name; cycle-closing edges are passed over and top_k counts what is kept. The ledger has a row for each pair of variables at most."""
    kept: list[tuple[str, str]] = []
    below: dict[str, set[str]] = {}

    def reach(a: str) -> set[str]:
        out, todo = set(), [a]
        while todo:
            for b in below.get(todo.pop(), ()):
                if b not in out:
                    out.add(b)
                    todo.append(b)
        return out

    for r in found.where(F.col("freq") >= min_freq).orderBy(F.desc("freq"), F.desc("adjacency_freq"), "src", "dst").collect():
        if top_k is not None and len(kept) >= top_k:
            break
        edge = (r.src, r.dst)
        if (allowed is None or edge in allowed) and r.src != r.dst and r.src not in reach(r.dst):
            kept.append(edge)
            below.setdefault(r.src, set()).add(r.dst)
    return kept


def metrics(found: DataFrame, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, shd (unequal cells, so a reversed edge counts twice), precision, recall and f1 of directed edges, and the last three of the skeleton."""

    def scored(a: DataFrame, b: DataFrame, prefix: str) -> DataFrame:
        joined = a.select("src", "dst", F.lit(1).alias("a")).distinct().join(b.select("src", "dst", F.lit(1).alias("b")).distinct(), ["src", "dst"], "full_outer")
        n = joined.agg(*[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(k) for k, c in (("tp", F.col("a").isNotNull() & F.col("b").isNotNull()), ("fp", F.col("b").isNull()), ("fn", F.col("a").isNull()))])
        precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
        recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
        f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
        more = [] if prefix else ["tp", "fp", "fn", (F.col("fp") + F.col("fn")).alias("shd")]
        return n.select(*more, precision.alias(f"{prefix}precision"), recall.alias(f"{prefix}recall"), f1.alias(f"{prefix}f1"))

    def skeleton(e: DataFrame) -> DataFrame:
        return e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))

    return scored(found, truth, "").crossJoin(scored(skeleton(found), skeleton(truth), "skeleton_"))


def validity(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Share of the edges that are allowed; 1 without edges."""
    marked = edges.join(allowed.select("src", "dst", F.lit(1.0).alias("ok")), ["src", "dst"], "left")
    return marked.agg(F.coalesce(F.avg(F.coalesce("ok", F.lit(0.0))), F.lit(1.0)).alias("validity"))


def alignment(graph_nodes: DataFrame, source_nodes: DataFrame) -> DataFrame:
    """domain, prop, range and side: matched, missing_in_source or extra_in_source; nulls equal nulls, repeats count once."""
    keys = ["domain", "prop", "range"]
    a, b = graph_nodes.select(*keys).distinct().withColumn("g", F.lit(1)), source_nodes.select(*keys).distinct().withColumn("s", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(*keys).agg(F.max("g").alias("g"), F.max("s").alias("s"))
    return both.select(*keys, F.when(F.col("g").isNull(), "extra_in_source").when(F.col("s").isNull(), "missing_in_source").otherwise("matched").alias("side"))


def realigned(priors: DataFrame, names: DataFrame) -> DataFrame:
    """i, j and value of every ordered pair of names; 0.5 where the priors have none."""
    pairs = names.select(F.col("name").alias("i")).crossJoin(names.select(F.col("name").alias("j"))).where("i <> j")
    return pairs.join(priors.select("i", "j", "value"), ["i", "j"], "left").select("i", "j", F.coalesce("value", F.lit(0.5)).alias("value"))


def prior_matrices(pairs: DataFrame) -> DataFrame:
    """i, j, m, b from a = P(associated), c = P(causal | associated), d = P(i causes j | causal) of unordered pairs.

    m = a * c, the same both ways, 0.5 where either is missing; b = m * d one way and m * (1 - d) the other, m itself
    where d is missing, 0.5 where m is.
    """
    m = F.coalesce(F.col("a") * F.col("c"), F.lit(0.5))
    known = F.col("a").isNotNull() & F.col("c").isNotNull()

    def b(d):
        return F.when(~known, 0.5).otherwise(F.coalesce(m * d, m))

    there = pairs.select("i", "j", m.alias("m"), b(F.col("d")).alias("b"))
    return there.union(pairs.select(F.col("j"), F.col("i"), m, b(1 - F.col("d"))))
