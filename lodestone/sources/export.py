"""Artefacts out: tables in Spark's formats, triples as N-Triples, a session's state as a folder, and priors back in."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import ntriples

FORMATS = ("csv", "json", "parquet", "nt")


def save(df: DataFrame, path: str, kind: str) -> None:
    """Write a table; `nt` takes triples. Nested columns become JSON texts in CSV, which has no others."""
    if kind == "nt":
        ntriples.write(df, path)
    elif kind == "csv":
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
        df.withColumns({c: F.to_json(c) for c in nested}).write.option("header", True).csv(path)
    elif kind in FORMATS:
        df.write.format(kind).save(path)
    else:
        raise ValueError(f"unknown format {kind!r}; there are {', '.join(FORMATS)}")


def save_priors(priors: DataFrame, path: str) -> None:
    priors.select("i", "j", "m", "b").write.json(path)


def load_priors(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """i, j, m, b of every ordered pair of names; 0.5 where there is none or no number. Names that the file has besides are left out."""
    stored = spark.read.schema("i string, j string, m double, b double").json(path)
    of = spark.createDataFrame([(x,) for x in names], "n string")
    pairs = of.select(F.col("n").alias("i")).crossJoin(of.select(F.col("n").alias("j"))).where("i <> j")
    clean = lambda c: F.coalesce(F.when(F.isnan(c), None).otherwise(F.col(c)), F.lit(0.5)).alias(c)
    return pairs.join(stored, ["i", "j"], "left").select("i", "j", clean("m"), clean("b"))


def save_project(project, folder: str) -> None:
    """The runs, edges, queries and answers of a session as tables, and what was curated as one JSON line."""
    spark = project.join().df.sparkSession
    from lodestone.operators.answers import answer_table, query_table

    state = {"version": 1, "hops": project.hops, "optional": project.optional, "excluded": sorted(project.excluded), "roles": project.roles, "values": project.values, "manual": sorted(project.manual), "selected": project.selected, "runs": len(project.runs)}
    spark.createDataFrame([(json.dumps(state),)], "value string").write.text(f"{folder}/state")
    for k, g in enumerate(project.runs):
        ntriples.write(g.triples(spark), f"{folder}/runs/{k:04d}")
    query_table(spark, project.queries).write.parquet(f"{folder}/queries")
    answer_table(spark, project.answers).write.parquet(f"{folder}/answers")


def load_project(spark: SparkSession, folder: str, schema, source):
    """A session with the stored curation, runs, queries and answers over a source given again; ValueError for another version."""
    from lodestone.operators.answers import load_answers, load_queries
    from lodestone.operators.causal_graph import load
    from lodestone.project import Project

    state = json.loads(spark.read.text(f"{folder}/state").first().value)
    if state["version"] != 1:
        raise ValueError(f"version {state['version']} of a stored session")
    p = Project(schema, source, state["hops"], state["optional"], set(state["excluded"]), state["roles"], state.get("values", {}))
    stored = spark.read.option("recursiveFileLookup", True).text(f"{folder}/runs") if state.get("runs", bool(state["selected"] or state["manual"])) else None
    if stored is not None:
        from lodestone.operators.causal_graph import graphs_in

        triples = ntriples.parse(stored)
        p.runs = [load(triples, r.graph) for r in graphs_in(triples).orderBy("graph").collect()]
    p.manual, p.selected = {tuple(e) for e in state["manual"]}, [tuple(e) for e in state["selected"]]
    p.queries = load_queries(spark.read.parquet(f"{folder}/queries"))
    p.answers = load_answers(spark.read.parquet(f"{folder}/answers"))
    return p
