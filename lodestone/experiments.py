"""Several discovery methods over one flat table: what each finds, how that compares with known edges, and its graphs as files."""

from __future__ import annotations

import time

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import ledger
from lodestone.operators.causal_graph import VOCABULARY
from lodestone.project import Project
from lodestone.sources import ntriples
from lodestone.vocabulary import RDF, RDFS

SUMMARY = "method string, constrained boolean, status string, edges int, seconds double, validity double"

#: Classes and properties of the triples that graphs, models, questions and worlds become.
CLASSES = ("Act", "CausalGraph", "CausalModel", "CounterfactualEstimate", "CounterfactualQuery", "DiscoveryRun")
PROPERTIES = ("aboutEntity", "answers", "backend", "cause", "constrained", "coupling", "createdAt", "derivedFrom", "domain", "edgeCount", "effect", "entity", "estimateOf", "hasAct", "hasEdge", "hasMechanism", "hasParameter", "hasSlot", "kind", "level", "levelOf", "manual", "mechanismType", "method", "model", "node", "nodeCount", "nodeKind", "observedValue", "ofEntity", "onModel", "parameterKind", "parameterName", "parameterValue", "parent", "predicted", "probability", "property", "range", "samples", "slotIndex", "slotNode", "source", "target", "trainedOn", "trainingRows", "value", "viaPath", "viaRelation", "wasGeneratedBy", "weight")


def vocabulary_triples(spark: SparkSession, base: str = VOCABULARY) -> DataFrame:
    """s, p, o, o_kind that declare the names above, each with its label."""
    rows = [(base + n, f"{RDF}type", f"{kind}", "iri") for names, kind in ((CLASSES, f"{RDFS}Class"), (PROPERTIES, f"{RDF}Property")) for n in names]
    rows += [(base + n, f"{RDFS}label", n, "literal") for n in (*CLASSES, *PROPERTIES)]
    return spark.createDataFrame(rows, "s string, p string, o string, o_kind string")


def run(project: Project, methods: list[str], columns: list[str] | None = None, constrained: tuple[bool, ...] = (True, False), truth: list[tuple[str, str]] | None = None, folder: str | None = None, parameters: dict[str, dict] | None = None) -> DataFrame:
    """A row for each method, with the schema's constraint and without: status, number of edges, seconds, and validity, the share of its edges that the constraint allows.

    With truth, the metrics of the edges against it as well. With a folder, each graph is written there as N-Triples, under
    method and constraint. A method that fails has its error as status, and the others still run. Graphs are kept as runs
    of the project.
    """
    spark = project.join().df.sparkSession
    allowed = spark.createDataFrame(project.constraint().white_list(), "src string, dst string")
    known = spark.createDataFrame(truth, "src string, dst string") if truth is not None else None
    rows, scores = [], []
    for method in methods:
        for bound in constrained:
            began = time.time()
            try:
                g = project.discover(method, columns, bound, **(parameters or {}).get(method, {}))
            except (ValueError, KeyError, ArithmeticError, PySparkException) as e:
                rows.append((method, bound, f"{type(e).__name__}: {str(e).splitlines()[0]}", None, round(time.time() - began, 3), None))
                continue
            names = g.names
            edges = spark.createDataFrame([(names[i], names[j]) for i, j in g.edges()], "src string, dst string")
            rows.append((method, bound, "done", len(g.edges()), round(time.time() - began, 3), ledger.validity(edges, allowed).first().validity))
            if known is not None:
                scores.append(ledger.metrics(edges, known).select(F.lit(method).alias("method"), F.lit(bound).alias("constrained"), "*"))
            if folder:
                ntriples.write(g.triples(spark), f"{folder}/{method}-{'constrained' if bound else 'free'}")
    out = spark.createDataFrame(rows, SUMMARY)
    if known is None:
        return out
    shape = ["tp", "fp", "fn", "shd", "precision", "recall", "f1", "skeleton_precision", "skeleton_recall", "skeleton_f1"]
    if not scores:
        return out.select("*", *[F.lit(None).cast("double").alias(c) for c in shape])
    every = scores[0]
    for s in scores[1:]:
        every = every.unionByName(s)
    return out.join(every, ["method", "constrained"], "left")
