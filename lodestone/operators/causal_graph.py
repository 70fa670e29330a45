"""A causal graph over property nodes: identity, tables, triples, and back."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from hashlib import sha1

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.constraint import EPSILON, Path, label_text, parse_label
from lodestone.plans.graphs import to_dag
from lodestone.plans.schema import PropertyNode, unique_names
from lodestone.vocabulary import is_type

#: Names of the vocabulary start with this; a parameter wherever triples are made or read.
VOCABULARY = "urn:lodestone:"


def _short(n: int, *parts: object) -> str:
    return sha1("|".join(map(str, parts)).encode()).hexdigest()[:n]


def typed_parameter(value: object) -> tuple[str, str]:
    """kind and text of a hyper-parameter."""
    for kind, types in (("bool", bool), ("int", int), ("float", float), ("str", str)):
        if isinstance(value, types):
            return kind, str(value).lower() if kind == "bool" else str(value)
    return ("null", "") if value is None else ("json", json.dumps(value, sort_keys=True))


def parameter_value(kind: str, text: str) -> object:
    return {"bool": lambda t: t == "true", "int": int, "float": float, "str": str, "null": lambda t: None, "json": json.loads}[kind](text)


@dataclass
class CausalGraph:
    nodes: list[PropertyNode]
    adjacency: np.ndarray
    weights: np.ndarray | None = None
    labels: dict[tuple[int, int], list[Path]] = field(default_factory=dict)
    method: str | None = None
    constrained: bool | None = None
    source: str | None = None
    parameters: dict[str, object] = field(default_factory=dict)
    manual: set[tuple[int, int]] = field(default_factory=set)
    derived_from: list[str] = field(default_factory=list)
    created_at: str | None = None

    @property
    def names(self) -> list[str]:
        made = unique_names(self.nodes)
        return [made[n] for n in self.nodes]

    @property
    def id(self) -> str:
        print_of = _short(12, self.method, json.dumps(self.parameters, sort_keys=True, default=str), *self.names, self.adjacency.astype(np.int8).tobytes().hex())
        return f"{re.sub(r'[^A-Za-z0-9_.-]', '_', self.method or 'graph')}-{print_of}"

    def edges(self) -> list[tuple[int, int]]:
        return [(int(i), int(j)) for i, j in zip(*np.nonzero(self.adjacency), strict=True)]

    def weight(self, i: int, j: int) -> float:
        return float(self.weights[i, j]) if self.weights is not None else 1.0

    def node_id(self, k: int) -> str:
        n = self.nodes[k]
        return f"{VOCABULARY}node/{n.name}-{_short(8, n.domain, n.prop, n.range)}"

    def subset(self, names: list[str]) -> CausalGraph:
        at = [self.names.index(n) for n in names]
        to = {k: i for i, k in enumerate(at)}
        grid = np.ix_(at, at)
        return replace(self, nodes=[self.nodes[k] for k in at], adjacency=self.adjacency[grid], weights=None if self.weights is None else self.weights[grid], labels={(to[i], to[j]): v for (i, j), v in self.labels.items() if i in to and j in to}, manual={(to[i], to[j]) for i, j in self.manual if i in to and j in to})

    def acyclic(self, on_cycle: str = "error", allowed: np.ndarray | None = None) -> CausalGraph:
        """Without cycles: `error` refuses them, `weight` drops the lightest edge of each, `constraint` first what is not allowed. What is known of the graph stays."""
        a = self.adjacency & allowed if on_cycle == "constraint" and allowed is not None else self.adjacency
        w = self.weights if self.weights is not None else self.adjacency.astype(float)
        a = to_dag(a, None if on_cycle == "error" else w)
        kept = {(i, j) for i, j in self.edges() if a[i, j]}
        return replace(self, adjacency=a, labels={k: v for k, v in self.labels.items() if k in kept}, manual=self.manual & kept, derived_from=[*self.derived_from, self.id])

    def to_json(self) -> str:
        """All that is known of the graph, as one JSON text; `from_json` reads it back."""
        body = {
            "id": self.id, "nodes": [[n.domain, n.prop, n.range, n.kind] for n in self.nodes], "edges": [[i, j, self.weight(i, j)] for i, j in self.edges()], "weighted": self.weights is not None,
            "labels": [[i, j, [label_text(p) for p in paths]] for (i, j), paths in sorted(self.labels.items())], "method": self.method, "constrained": self.constrained, "source": self.source,
            "parameters": self.parameters, "manual": sorted(map(list, self.manual)), "derived_from": self.derived_from, "created_at": self.created_at,
        }
        return json.dumps(body, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> CausalGraph:
        """The graph of such a text; ValueError if its content is not what its id says."""
        x = json.loads(text)
        n = len(x["nodes"])
        a, w = np.zeros((n, n), bool), np.zeros((n, n))
        for i, j, weight in x["edges"]:
            a[i, j], w[i, j] = True, weight
        labels = {(i, j): [parse_label(p) for p in paths] for i, j, paths in x["labels"]}
        out = cls([PropertyNode(*v) for v in x["nodes"]], a, w if x["weighted"] else None, labels, x["method"], x["constrained"], x["source"], x["parameters"], {tuple(e) for e in x["manual"]}, x["derived_from"], x["created_at"])
        if out.id != x["id"]:
            raise ValueError(f"{x['id']}: the graph is another, {out.id}")
        return out

    def edge_frame(self, spark: SparkSession) -> DataFrame:
        names = self.names
        rows = [(self.method, names[i], names[j], self.nodes[i].domain, self.nodes[j].domain, "; ".join(label_text(p) for p in self.labels.get((i, j), [])), self.weight(i, j), (i, j) in self.manual) for i, j in self.edges()]
        return spark.createDataFrame(rows, "method string, cause string, effect string, cause_domain string, effect_domain string, relation string, weight double, manual boolean")

    def triples(self, spark: SparkSession, base: str = VOCABULARY) -> DataFrame:
        """s, p, o, o_kind, o_dt: the graph, its run and parameters, the slots of its nodes, and its edges. What is not known makes no triple."""
        g, run = f"{base}graph/{self.id}", f"{base}run/{self.id}"
        out: list[tuple] = []

        def add(s: str, p: str, o: object, kind: str = "literal") -> None:
            if o is not None:
                dt = {bool: "xsd:boolean", int: "xsd:integer", float: "xsd:double"}.get(type(o))
                out.append((s, p if p.startswith("rdf:") else base + p, str(o).lower() if isinstance(o, bool) else str(o), kind, dt))

        add(g, "rdf:type", f"{base}CausalGraph", "iri")
        add(run, "rdf:type", f"{base}DiscoveryRun", "iri")
        add(g, "wasGeneratedBy", run, "iri")
        for p, o in (("nodeCount", len(self.nodes)), ("edgeCount", len(self.edges()))):
            add(g, p, o)
        for p, o in (("method", self.method), ("constrained", self.constrained), ("source", self.source), ("createdAt", self.created_at)):
            add(run, p, o)
        for d in self.derived_from:
            add(g, "derivedFrom", f"{base}graph/{d}", "iri")
        for name, value in sorted(self.parameters.items()):
            kind, text = typed_parameter(value)
            s = f"{run}/parameter/{_short(8, name)}"
            add(run, "hasParameter", s, "iri")
            for p, o in (("parameterName", name), ("parameterKind", kind), ("parameterValue", text)):
                add(s, p, o)
        for k, n in enumerate(self.nodes):
            slot, node = f"{g}/slot/{k}", self.node_id(k)
            add(g, "hasSlot", slot, "iri")
            add(slot, "slotIndex", k)
            add(slot, "slotNode", node, "iri")
            for p, o in (("domain", n.domain), ("property", n.prop), ("range", n.range), ("nodeKind", n.kind)):
                add(node, p, o)
        for i, j in self.edges():
            e = f"{g}/edge/{i}-{j}"
            add(g, "hasEdge", e, "iri")
            add(e, "cause", self.node_id(i), "iri")
            add(e, "effect", self.node_id(j), "iri")
            add(e, "weight", self.weight(i, j))
            if (i, j) in self.manual:
                add(e, "manual", True)
            for path in self.labels.get((i, j), []):
                add(e, "viaPath", label_text(path))
                for relation, _ in () if path == EPSILON else path:
                    add(e, "viaRelation", relation)
        return spark.createDataFrame(sorted(set(out)), "s string, p string, o string, o_kind string, o_dt string")


def graphs_in(triples: DataFrame, base: str = VOCABULARY) -> DataFrame:
    """graph, method, constrained, n_nodes, n_edges, created_at of the causal graphs in a triple table."""
    t = triples.select("s", "p", "o")

    def value(p: str, name: str) -> DataFrame:
        return t.where(F.col("p") == base + p).select("s", F.col("o").alias(name))

    g = t.where(is_type(F.col("p")) & (F.col("o") == f"{base}CausalGraph")).select("s").join(value("wasGeneratedBy", "run"), "s", "left")
    for p, name in (("nodeCount", "n_nodes"), ("edgeCount", "n_edges")):
        g = g.join(value(p, name), "s", "left")
    g = g.withColumnRenamed("s", "graph")
    for p, name in (("method", "method"), ("constrained", "constrained"), ("createdAt", "created_at")):
        g = g.join(value(p, name).withColumnRenamed("s", "run"), "run", "left")
    return g.select("graph", "method", (F.col("constrained") == "true").alias("constrained"), F.col("n_nodes").cast("int"), F.col("n_edges").cast("int"), "created_at")


def load(triples: DataFrame, graph: str | None = None, method: str | None = None, base: str = VOCABULARY) -> CausalGraph:
    """The one graph that fits; LookupError if none or several do. Only this graph's own triples reach the driver."""
    found = graphs_in(triples, base)
    if graph:
        found = found.where(F.col("graph").isin(graph, f"{base}graph/{graph}"))
    if method:
        found = found.where(F.col("method") == method)
    names = [r.graph for r in found.limit(3).collect()]
    if len(names) != 1:
        raise LookupError(f"{len(names) or 'no'} causal graphs fit" + (f": {names}" if names else ""))
    g = names[0]
    own = triples.where(F.col("s").startswith(g) | F.col("s").startswith(g.replace(f"{base}graph/", f"{base}run/")))
    rows = own.select("s", "p", "o").collect()
    by: dict[str, dict[str, list[str]]] = {}
    for r in rows:
        by.setdefault(r.s, {}).setdefault(r.p.removeprefix(base), []).append(r.o)
    slots = sorted((by[s] for s in by[g].get("hasSlot", [])), key=lambda s: int(s["slotIndex"][0]))
    ids = [s["slotNode"][0] for s in slots]
    facts: dict[str, dict[str, str]] = {}
    for r in triples.where(F.col("s").isin(ids or [""])).select("s", "p", "o").collect():
        facts.setdefault(r.s, {})[r.p.removeprefix(base)] = r.o
    nodes = [PropertyNode(f["domain"], f["property"], f["range"], f.get("nodeKind", "data")) for f in (facts[i] for i in ids)]
    at = {i: k for k, i in enumerate(ids)}
    n = len(nodes)
    adjacency, weights, labels, manual = np.zeros((n, n), bool), np.zeros((n, n)), {}, set()
    for e in by[g].get("hasEdge", []):
        i, j = at[by[e]["cause"][0]], at[by[e]["effect"][0]]
        adjacency[i, j], weights[i, j] = True, float(by[e].get("weight", ["1"])[0])
        if paths := sorted(by[e].get("viaPath", [])):
            labels[i, j] = [parse_label(p) for p in paths]
        if by[e].get("manual") == ["true"]:
            manual.add((i, j))
    run = by.get(by[g].get("wasGeneratedBy", [""])[0], {})
    one = lambda k: run.get(k, [None])[0]
    parameters = {by[p]["parameterName"][0]: parameter_value(by[p]["parameterKind"][0], by[p].get("parameterValue", [""])[0]) for p in run.get("hasParameter", [])}
    return CausalGraph(nodes, adjacency, weights, labels, one("method"), None if one("constrained") is None else one("constrained") == "true", one("source"), parameters, manual, sorted(d.removeprefix(f"{base}graph/") for d in by[g].get("derivedFrom", [])), one("createdAt"))
