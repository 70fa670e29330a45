"""python -m lodestone: discovery and questions over N-Triples from the command line; results are JSON lines on standard output.

    discover TRIPLES... --session FOLDER [--method GES]... [--columns A,B] [--free] [--min-freq 1]
    ask TRIPLES... --session FOLDER --kind intervene --target T --set X=1 [--given Z=2] [--entity E] [--draws 200]
    graphs TRIPLES...
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from lodestone import experiments
from lodestone.operators.answers import KINDS
from lodestone.operators.causal_graph import graphs_in
from lodestone.plans.schema import Schema, schema_of
from lodestone.project import METHODS, Project
from lodestone.sources import export, ntriples
from lodestone.storage import materialise


def _pairs(values: list[str]) -> dict[str, str]:
    out = {}
    for v in values or ():
        name, sign, value = v.partition("=")
        if not sign:
            raise SystemExit(f"{v!r}: expected NODE=VALUE")
        out[name] = value
    return out


def _source(spark: SparkSession, paths: list[str]) -> tuple[Schema, ntriples.TripleSource, DataFrame]:
    parsed = materialise(ntriples.parse(spark.read.text(paths)), "parsed")
    triples = materialise(ntriples.localised(parsed), "triples")
    return schema_of(triples), ntriples.TripleSource(triples), parsed


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("discover", "ask", "graphs"):
        c = commands.add_parser(name)
        c.add_argument("triples", nargs="+")
        if name != "graphs":
            c.add_argument("--session", required=True)
        if name == "discover":
            c.add_argument("--method", action="append", choices=METHODS)
            c.add_argument("--columns")
            c.add_argument("--free", action="store_true", help="do not hold methods to the schema's relations")
            c.add_argument("--min-freq", type=int, default=1)
        if name == "ask":
            c.add_argument("--kind", choices=KINDS, required=True)
            c.add_argument("--target", required=True)
            c.add_argument("--set", action="append", default=[])
            c.add_argument("--given", action="append", default=[])
            c.add_argument("--entity")
            c.add_argument("--draws", type=int, default=200)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> None:
    """Run one command; spark: by default a session as spark-submit configures it."""
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    schema, source, parsed = _source(spark, a.triples)
    if a.command == "graphs":
        for r in graphs_in(parsed).orderBy("graph").collect():
            print(json.dumps(r.asDict()), file=out)
    elif a.command == "discover":
        p = Project(schema, source)
        columns = a.columns.split(",") if a.columns else None
        for r in experiments.run(p, a.method or ["GES"], columns, (not a.free,)).collect():
            print(json.dumps(r.asDict()), file=out)
        chosen = p.auto_select(a.min_freq, only_allowed=not a.free)
        print(json.dumps({"selected": chosen}), file=out)
        export.save_project(p, a.session)
    else:
        p = export.load_project(spark, a.session, schema, source)
        answer = p.ask(a.kind, a.target, _pairs(a.set), _pairs(a.given) or None, a.entity, a.draws)
        print(json.dumps({"query": answer.query, "predicted": answer.predicted, "distribution": answer.distribution, "backend": answer.backend, "reaches": answer.reaches}), file=out)


if __name__ == "__main__":
    main()
