"""Neighbours of entities in triples, paths between two of them, and metadata texts of variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.schema import Schema


def one_hop(triples: DataFrame, entity: str, label: str = "label", most: int | None = 50) -> DataFrame:
    """p, o, p_label, o_label of the entity's links whose property and object both have a label; the first `most` by name, as a report of neighbours."""
    labels = triples.where(F.col("p") == label).groupBy("s").agg(F.min("o").alias("text"))
    links = triples.where((F.col("s") == entity) & (F.col("o_kind") == "iri")).select("p", "o").distinct()
    named = links.join(labels.select(F.col("s").alias("p"), F.col("text").alias("p_label")), "p").join(labels.select(F.col("s").alias("o"), F.col("text").alias("o_label")), "o")
    out = named.select("p", "o", "p_label", "o_label")
    return out if most is None else out.orderBy("p", "o").limit(most)


def relational_path(triples: DataFrame, a: str, b: str, noisy: tuple[str, ...] = ("rdf:type",)) -> DataFrame:
    """kind, via, p, q: direct links between the two either way; without any, the entities that both are linked with."""
    links = triples.where((F.col("o_kind") == "iri") & ~F.col("p").isin(*noisy)).select("s", "p", "o").distinct()
    direct = links.where((F.col("s") == a) & (F.col("o") == b)).select(F.lit("forward").alias("kind"), F.lit(None).cast("string").alias("via"), "p", F.lit(None).cast("string").alias("q"))
    direct = direct.unionByName(links.where((F.col("s") == b) & (F.col("o") == a)).select(F.lit("backward").alias("kind"), F.lit(None).cast("string").alias("via"), "p", F.lit(None).cast("string").alias("q")))
    shared = links.where(F.col("s") == a).select(F.col("o").alias("via"), "p").join(links.where(F.col("s") == b).select(F.col("o").alias("via"), F.col("p").alias("q")), "via").select(F.lit("shared").alias("kind"), "via", "p", "q")
    none = direct.agg((F.count("*") == 0).alias("none"))
    return direct.unionByName(shared.crossJoin(F.broadcast(none)).where("none").drop("none"))


def attributed(rows: DataFrame, entity: str, value: str, order: str) -> DataFrame:
    """entity and value: of several rows of an entity the last by `order` (of equals the greatest value) counts."""
    return rows.groupBy(entity).agg(F.max_by(value, F.struct(order, value)).alias(value))


def informative(priors: DataFrame) -> DataFrame:
    """n: off-diagonal prior cells that say something."""
    return priors.where("i <> j").agg(F.coalesce(F.sum(F.when(F.abs(F.col("value") - 0.5) > 1e-9, 1).otherwise(0)), F.lit(0)).alias("n"))


def resampled(df: DataFrame, weight: str, key: Column, n: float, seed: int = 0) -> DataFrame:
    """About n rows, each repeated by its share of the weights: the whole part always, the rest by a hash of the key."""
    from lodestone.functions.text import uniform

    total = df.agg(F.sum(weight).alias("_all"))
    wanted = F.col(weight) / F.col("_all") * n
    copies = F.floor(wanted) + F.when(uniform(seed, key) < wanted - F.floor(wanted), 1).otherwise(0)
    return df.crossJoin(F.broadcast(total)).withColumn("_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))).otherwise(F.array().cast("array<int>")))).drop("_all", "_copy")


def described(schema: Schema, labels: dict[str, str] | None = None, comments: dict[str, str] | None = None) -> dict[str, str]:
    """A line of text for each variable, for people and for makers of priors."""
    labels, comments = labels or {}, comments or {}
    out = {}
    for n in schema.nodes():
        text = f"{labels.get(n.prop, n.prop)} of {labels.get(n.domain, n.domain)} ({n.range})"
        out[n.name] = f"{text}: {comments[n.prop]}" if n.prop in comments else text
    return out
