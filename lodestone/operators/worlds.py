"""Counterfactual worlds and fitted models as triples whose names come from their content, so that runs add up as sets."""

from __future__ import annotations

import json
from hashlib import sha1

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.causal_graph import VOCABULARY
from lodestone.operators.mixed_model import Choice, Given, Line, MixedModel, Steps, Table

#: A world: what was asked of which unit, and what it would be. Without an entity the unit is hypothetical: it is what was observed of it.
WORLD = "entity string, model string, do map<string,string>, observed map<string,string>, predicted map<string,string>, probability map<string,double>, coupling string"


def _text(entries: Column) -> Column:
    """A map as a text that does not depend on the order of its entries; no map as an empty one."""
    return F.coalesce(F.to_json(F.array_sort(F.map_entries(entries))), F.lit("[]"))


def _name(length: int, *parts: Column) -> Column:
    """Hex digits of the parts, each with its length in front, so that no two lists of parts make one text; a null is no text."""
    known = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.substring(F.sha1(F.concat(*known).cast("binary")), 1, length)


def world_ids(worlds: DataFrame) -> DataFrame:
    """worlds with `world`: of a named unit by model, entity and what is set; of a hypothetical one by what was observed as well."""
    observed = F.when(F.col("entity").isNull(), _text(F.col("observed")))
    return worlds.withColumn("world", _name(12, F.col("model"), F.col("entity"), _text(F.col("do")), observed))


def world_triples(worlds: DataFrame, nodes: list[str] | None = None, base: str = VOCABULARY) -> DataFrame:
    """s, p, o, o_kind of worlds: the question, its acts and an estimate for each predicted node that is not set.

    The same act on the same unit is one resource in whatever world it stands; acts on hypothetical units are shared by
    node and value. Nodes that are not among `nodes` are left out; what is null makes no triple; equal triples are one, so
    the union of several runs, made distinct, is the set of what all of them say.
    """
    w = world_ids(worlds)
    s = F.concat(F.lit(f"{base}query/"), F.col("world"))
    literal = lambda p, o: F.struct(F.lit(base + p).alias("p"), o.cast("string").alias("o"), F.lit("literal").alias("o_kind"))
    link = lambda p, o: F.struct(F.lit(base + p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"))
    kind = lambda name: F.struct(F.lit("rdf:type").alias("p"), F.lit(base + name).alias("o"), F.lit("iri").alias("o_kind"))

    def made(df: DataFrame, subject: Column, facts: list[Column]) -> DataFrame:
        return df.select(subject.alias("s"), F.explode(F.array(*facts)).alias("t")).select("s", "t.*").where("o IS NOT NULL AND s IS NOT NULL")

    def of_nodes(df: DataFrame) -> DataFrame:
        return df if nodes is None else df.where(F.col("node").isin(nodes))

    out = made(w, s, [kind("CounterfactualQuery"), link("aboutEntity", F.col("entity")), link("onModel", F.concat(F.lit(f"{base}model/"), F.col("model"))), literal("coupling", F.col("coupling"))])
    acts = of_nodes(w.select("world", "entity", F.explode("do").alias("node", "value")))
    act = F.concat(F.lit(f"{base}act/"), _name(12, F.col("entity"), F.col("node"), F.col("value")))
    out = out.unionByName(made(acts, s, [link("hasAct", act)])).unionByName(made(acts, act, [kind("Act"), literal("node", F.col("node")), literal("value", F.col("value")), link("ofEntity", F.col("entity"))]))
    told = of_nodes(w.select("world", "observed", "probability", F.map_keys("do").alias("acted"), F.explode("predicted").alias("node", "value")).where(~F.array_contains(F.coalesce("acted", F.array().cast("array<string>")), F.col("node"))))
    estimate = F.concat(F.lit(f"{base}estimate/"), F.col("world"), F.lit("-"), _name(8, F.col("node")))
    facts = [kind("CounterfactualEstimate"), literal("node", F.col("node")), literal("value", F.col("value")), literal("observedValue", F.try_element_at("observed", F.col("node"))), literal("probability", F.try_element_at("probability", F.col("node"))), link("estimateOf", s)]
    return out.unionByName(made(told, estimate, facts)).distinct()


def worlds_of(drawn: DataFrame, nodes: list[str], do: dict[str, str], model: str, entity: str | None = None, coupling: str | None = "gumbel-max") -> DataFrame:
    """A world for each row that counterfactuals were drawn for: its likeliest level of each node over the draws (of equals the least), and that level's share.

    drawn: id, the nodes, cf_<node> of each, and the column `entity` that names the row's unit (none: hypothetical).
    """
    found = [n for n in nodes if f"cf_{n}" in drawn.columns]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.col(f"cf_{n}").cast("string").alias("value")) for n in found]))
    name = F.col(entity).cast("string") if entity else F.lit(None).cast("string")
    observed = F.map_from_arrays(F.array(*map(F.lit, nodes)), F.array(*[F.col(n).cast("string") for n in nodes]))
    votes = drawn.select("id", name.alias("entity"), observed.alias("observed"), each.alias("e")).groupBy("id", "e.node", "e.value").agg(F.count("*").alias("n"), F.first("entity").alias("entity"), F.first("observed").alias("observed"))
    best = votes.groupBy("id", "node").agg(F.max_by("value", F.struct("n", F.expr("-hash(value)"))).alias("value"), (F.max("n") / F.sum("n")).alias("share"), F.first("entity").alias("entity"), F.first("observed").alias("observed"))
    given = F.create_map(*[F.lit(x) for kv in sorted(do.items()) for x in kv]) if do else F.create_map().cast("map<string,string>")
    pair = lambda x: F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", x))))
    return best.groupBy("id").agg(F.first("entity").alias("entity"), F.first("observed").alias("observed"), pair("value").alias("predicted"), pair("share").alias("probability")).select("entity", F.lit(model).alias("model"), given.alias("do"), "observed", "predicted", "probability", F.lit(coupling).alias("coupling"))


def model_id(model: MixedModel, fingerprint: str) -> str:
    """The same for the same network, kinds and table that it was fitted on."""
    return sha1(json.dumps([model.network, model.kinds, fingerprint], sort_keys=True).encode()).hexdigest()[:12]


def mechanism_rows(spark: SparkSession, model: MixedModel) -> DataFrame:
    """node, kind, parents, mechanism, invertible and explained of each node."""
    rows = [(n, model.kinds[n], ",".join(model.network[n]), type(m).__name__, True, float(m.explained) if isinstance(m, Line | Steps | Given) else None) for n, m in sorted(model.mechanisms.items())]
    return spark.createDataFrame(rows, "node string, kind string, parents string, mechanism string, invertible boolean, explained double")


def model_triples(spark: SparkSession, model: MixedModel, fingerprint: str, rows: int, base: str = VOCABULARY) -> DataFrame:
    """s, p, o, o_kind of a fitted model: the table that it was fitted on, and its mechanisms with their parents and coupling."""
    s, out = f"{base}model/{model_id(model, fingerprint)}", []
    out += [(s, "rdf:type", f"{base}CausalModel", "iri"), (s, f"{base}trainedOn", fingerprint, "literal"), (s, f"{base}trainingRows", str(rows), "literal")]
    for n, m in sorted(model.mechanisms.items()):
        t = f"{s}/mechanism/{sha1(n.encode()).hexdigest()[:8]}"
        out += [(s, f"{base}hasMechanism", t, "iri"), (t, f"{base}node", n, "literal"), (t, f"{base}mechanismType", type(m).__name__, "literal")]
        out += [(t, f"{base}parent", p, "literal") for p in model.network[n]]
        out += [(t, f"{base}coupling", "gumbel-max", "literal")] if isinstance(m, Choice | Table) else []
    return spark.createDataFrame(out, "s string, p string, o string, o_kind string")
