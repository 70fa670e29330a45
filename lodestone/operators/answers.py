"""Queries and their answers as records: identity by content, validation, storage as tables or triples, and replay."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from hashlib import sha1

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.causal_graph import VOCABULARY
from lodestone.operators.inference import descendants

KINDS = ("condition", "intervene", "counterfactual")


@dataclass(frozen=True)
class Setting:
    """A node with a value; `entity` for counterfactuals of one unit."""

    node: str
    value: str | float | None
    entity: str | None = None


@dataclass(frozen=True)
class Query:
    kind: str
    model: str
    target: str
    settings: tuple[Setting, ...] = ()  # evidence, or what is set
    conditions: tuple[Setting, ...] = ()  # evidence besides what is set
    entity: str | None = None

    @property
    def id(self) -> str:
        """The same for the same content, in whatever order it was given."""
        body = asdict(self)
        for k in ("settings", "conditions"):
            body[k] = sorted(body[k], key=lambda s: json.dumps(s, sort_keys=True))
        return sha1(json.dumps(body, sort_keys=True).encode()).hexdigest()[:12]

    def check(self, network: dict[str, list[str]]) -> None:
        """ValueError or KeyError if the query can't be asked of the network."""
        if self.kind not in KINDS:
            raise ValueError(f"unknown kind {self.kind!r}")
        nodes = [s.node for s in (*self.settings, *self.conditions)]
        if unknown := sorted({self.target, *nodes} - set(network)):
            raise KeyError(f"unknown: {unknown}")
        if self.target in nodes:
            raise ValueError(f"{self.target} is asked for and given")
        if len(set(nodes)) < len(nodes):
            raise ValueError("a node is given twice")
        if any(s.value is None for s in (*self.settings, *self.conditions)):
            raise ValueError("a value is missing")
        if self.kind == "counterfactual" and not self.settings:
            raise ValueError("nothing is set")

    def reaches_target(self, network: dict[str, list[str]]) -> bool:
        """Whether what is set can change the target at all."""
        return any(self.target in descendants(network, s.node) for s in self.settings)


@dataclass
class Answer:
    query: str
    distribution: dict[str, float] = field(default_factory=dict)
    backend: str = ""
    n_samples: int = 0
    ess: float | None = None
    reaches: bool = True  # whether what is set can change the target at all

    @property
    def predicted(self) -> str | None:
        """The likeliest level, of equals the least."""
        return min(self.distribution, key=lambda k: (-self.distribution[k], k)) if self.distribution else None


def estimand(q: Query) -> str:
    """The question in the usual notation: P(y | do(x = 1), z = 2), and with the unit below for a counterfactual."""
    said = lambda ss: [f"{s.node} = {s.value}" for s in sorted(ss, key=lambda s: s.node)]
    acts = said(q.settings) if q.kind == "condition" else [f"do({x})" for x in said(q.settings)]
    given = ", ".join([*acts, *said(q.conditions)])
    unit = f"; {q.entity}" if q.entity else ""
    return f"P({q.target}{' | ' + given if given else ''}{unit})"


def matching(queries: DataFrame, kind: str | None = None, target: str | None = None, entity: str | None = None, node: str | None = None, value: str | None = None) -> DataFrame:
    """Stored queries of a kind, target and entity that set or are given a node (with a value)."""
    for c, v in (("kind", kind), ("target", target), ("entity", entity)):
        queries = queries if v is None else queries.where(F.col(c) == v)
    fits = lambda s: (s["node"] == node) if value is None else (s["node"] == node) & (s["value"] == json.dumps(value))
    return queries if node is None else queries.where(F.exists("settings", fits) | F.exists("conditions", fits))


_QUERY = "id string, kind string, model string, target string, entity string, settings array<struct<node:string,value:string,entity:string>>, conditions array<struct<node:string,value:string,entity:string>>"
_ANSWER = "query string, backend string, n_samples long, ess double, distribution map<string,double>, predicted string, reaches boolean"


def query_table(spark: SparkSession, queries: list[Query]) -> DataFrame:
    def flat(s: tuple[Setting, ...]) -> list[tuple]:
        return [(x.node, json.dumps(x.value), x.entity) for x in s]

    return spark.createDataFrame([(q.id, q.kind, q.model, q.target, q.entity, flat(q.settings), flat(q.conditions)) for q in queries], _QUERY)


def answer_table(spark: SparkSession, answers: list[Answer]) -> DataFrame:
    return spark.createDataFrame([(a.query, a.backend, a.n_samples, a.ess, a.distribution, a.predicted, a.reaches) for a in answers], _ANSWER)


def load_queries(table: DataFrame) -> list[Query]:
    """The stored queries (those of one session), ready to be asked again."""

    def settings(rows) -> tuple[Setting, ...]:
        return tuple(Setting(r.node, json.loads(r.value), r.entity) for r in rows or ())

    return [Query(r.kind, r.model, r.target, settings(r.settings), settings(r.conditions), r.entity) for r in table.orderBy("id").collect()]


def load_answers(table: DataFrame) -> list[Answer]:
    """The stored answers (those of one session), in the order of their queries' ids."""
    return [Answer(r.query, dict(r.distribution or {}), r.backend, r.n_samples, r.ess, r.reaches) for r in table.orderBy("query").collect()]


def as_triples(queries: DataFrame, answers: DataFrame, base: str = VOCABULARY) -> DataFrame:
    """s, p, o, o_kind of stored queries, their settings and the levels of their answers, as Spark expressions over the tables."""
    q = F.concat(F.lit(f"{base}query/"), F.col("id"))

    def facts(df: DataFrame, s, pairs: dict) -> DataFrame:
        made = F.array(*[F.struct(F.lit(base + p).alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("o_kind")) for p, (o, kind) in pairs.items()])
        return df.select(s.alias("s"), F.explode(made).alias("t")).select("s", "t.*").where("o IS NOT NULL")

    out = facts(queries, q, {"kind": (F.col("kind"), "literal"), "target": (F.col("target"), "literal"), "entity": (F.col("entity"), "literal"), "model": (F.concat(F.lit(f"{base}model/"), F.col("model")), "iri")})
    for part in ("settings", "conditions"):
        one = queries.select("id", F.explode(part).alias("x"))
        s = F.concat(F.lit(f"{base}{part[:-1]}/"), F.substring(F.sha1(F.concat_ws("|", F.coalesce("x.entity", F.lit("")), "x.node", "x.value").cast("binary")), 1, 8))
        out = out.unionByName(facts(one, s, {"node": (F.col("x.node"), "literal"), "value": (F.col("x.value"), "literal"), "ofEntity": (F.col("x.entity"), "literal")}))
        out = out.unionByName(one.select(q.alias("s"), F.lit(f"{base}{part[:-1]}").alias("p"), s.alias("o"), F.lit("iri").alias("o_kind")))
    a = F.concat(F.lit(f"{base}answer/"), F.col("query"))
    levels = answers.select("query", F.explode("distribution").alias("level", "p"))
    level = F.concat(a, F.lit("/level/"), F.substring(F.sha1(F.col("level").cast("binary")), 1, 8))
    out = out.unionByName(facts(answers, a, {"answers": (F.concat(F.lit(f"{base}query/"), F.col("query")), "iri"), "backend": (F.col("backend"), "literal"), "samples": (F.col("n_samples"), "literal"), "predicted": (F.col("predicted"), "literal")}))
    out = out.unionByName(facts(levels, level, {"level": (F.col("level"), "literal"), "probability": (F.col("p"), "literal"), "levelOf": (a, "iri")}))
    return out.distinct()


def entities_meet(flat: DataFrame, entity_columns: list[str], a: str, b: str) -> bool:
    """Whether the two entities stand in one row of the flat join."""
    has = lambda e: F.array_contains(F.array(*[F.col(c).cast("string") for c in entity_columns]), e)
    return bool(flat.where(has(a) & has(b)).limit(1).count())


def rows_of(flat: DataFrame, entity_columns: list[str], entity: str) -> DataFrame:
    """The rows in which the entity stands, under any class; KeyError if there are none."""
    has = F.array_contains(F.array(*[F.col(c).cast("string") for c in entity_columns]), entity)
    found = flat.where(has)
    if not found.limit(1).count():
        raise KeyError(entity)
    return found
