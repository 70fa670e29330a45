"""A session: a source, its variables, what was curated, found, fitted and asked; changes drop what depended on what changed."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import answers as qa
from lodestone.operators import cpt, discovery, inference, ledger
from lodestone.operators.causal_graph import CausalGraph
from lodestone.operators.counterfactual import answer as cf_answer
from lodestone.operators.counterfactual import counterfactual, numbered
from lodestone.operators.mixed_scores import MixedScores
from lodestone.operators.profile import numeric_columns
from lodestone.plans.constraint import Constraint, constraint
from lodestone.plans.flat_join import FlatJoin, flat_join, value_variables
from lodestone.plans.schema import PropertyNode, Schema, unique_names
from lodestone.storage import materialise

DISCRETE, NUMERIC = ("GES", "HC"), ("PC", "NOTEARS", "DAGMA", "LiNGAM")
METHODS = (*DISCRETE, *NUMERIC, *discovery.PRIOR_METHODS)


@dataclass
class Project:
    schema: Schema
    source: object
    hops: int = 1
    optional: bool = False
    excluded: set[str] = field(default_factory=set)
    roles: dict[str, str] = field(default_factory=dict)  # object property: join, variable or drop
    values: dict[str, str] = field(default_factory=dict)  # object node that is a variable: CLASS or the property of its range that stands for it
    runs: list[CausalGraph] = field(default_factory=list)
    manual: set[tuple[str, str]] = field(default_factory=set)
    selected: list[tuple[str, str]] = field(default_factory=list)
    queries: list[qa.Query] = field(default_factory=list)
    answers: list[qa.Answer] = field(default_factory=list)
    _join: FlatJoin | None = None
    _tables: dict[float, dict[str, DataFrame]] = field(default_factory=dict)

    # what is curated

    def nodes(self) -> list[PropertyNode]:
        """Variables that are kept: data nodes and object nodes in the role of a variable."""
        return [n for n in self.schema.nodes() if n.name not in self.excluded and (n.kind == "data" or self.roles.get(n.prop) == "variable")]

    def exclude(self, *names: str) -> None:
        self.excluded |= set(names)
        self._dropped("join")

    def include(self, *names: str) -> None:
        self.excluded -= set(names)
        self._dropped("join")

    def set_role(self, prop: str, role: str) -> None:
        if prop not in self.schema.objects or role not in ("join", "variable", "drop"):
            raise ValueError(f"{prop}: {role}")
        self.roles[prop] = role
        self._dropped("join")

    def seed_roles(self) -> list[str]:
        """Make variables of the object properties that point at values modelled as classes, where that splits no join; returns their nodes' names."""
        found = value_variables(self.schema)
        for n in found:
            self.set_role(n.prop, "variable")
        return [n.name for n in found]

    def _dropped(self, since: str) -> None:
        """Forget what depends on the join, the runs or the selection."""
        if since == "join":
            self._join, self.runs, self.manual = None, [], set()
        if since in ("join", "runs"):
            self.selected = []
        self._tables, self.queries, self.answers = {}, [], []

    # what follows from it

    def join(self) -> FlatJoin:
        if self._join is None:
            kept = self.nodes()
            classes = {n.domain for n in kept}
            joined = [n for n in self.schema.nodes() if n.kind == "object" and self.roles.get(n.prop, "join") == "join" and {n.domain, n.range} <= classes]
            made = flat_join(self.schema, self.source, kept, joined, optional=self.optional, values=self.values)
            self._join = FlatJoin(materialise(made.df, "flat"), made.entities, made.columns, made.skipped, made.residual, made.warnings)
        return self._join

    def constraint(self) -> Constraint:
        return constraint(self.schema, self.nodes(), self.hops)

    def discover(self, method: str, columns: list[str] | None = None, constrained: bool = True, score: str = "discrete", priors: DataFrame | None = None, **parameters) -> CausalGraph:
        """Run a method on the flat table (columns: by default all variables) and keep the graph.

        score, of the methods that search by one: discrete, gauss, mixed, or auto (by the types of the columns). priors, of
        those that use them: i, j, a, c, d of pairs of variables, as `ledger.prior_matrices` takes them.
        """
        if method not in METHODS:
            raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
        c = self.constraint().subset(columns or self.join().columns)
        allowed = c.allowed if constrained else None
        df = self.join().df
        if method in DISCRETE:
            by = self._scores(df, c.names, score)
            found = discovery.ges(by, c.names, allowed, **parameters) if method == "GES" else discovery.hill_climb(by, c.names, allowed, **parameters)
        elif method in discovery.PRIOR_METHODS:
            rows = ledger.prior_matrices(priors).collect() if priors is not None else []  # as many as there are pairs of variables
            matrices = {k: {(r.i, r.j): r[k] for r in rows} for k in ("m", "b")}
            found = discovery.with_priors(method, self._scores(df, c.names, score), c.names, matrices, allowed, **parameters)
        else:
            found = {"PC": discovery.pc, "NOTEARS": discovery.notears, "DAGMA": discovery.dagma, "LiNGAM": discovery.lingam}[method](df, c.names, allowed=allowed, **parameters)
        labels = {(c.names.index(a), c.names.index(b)): v for (a, b), v in c.labels.items() if found[c.names.index(a), c.names.index(b)]}
        graph = CausalGraph(c.nodes, found != 0, found.astype(float) if found.dtype != bool else None, labels, method, constrained, None, parameters)
        self.runs.append(graph)
        self._dropped("runs")
        return graph

    def _scores(self, df: DataFrame, names: list[str], kind: str) -> discovery.Score:
        numeric = [n for n in names if n in numeric_columns(df)]
        if kind == "auto":
            kind = "mixed" if 0 < len(numeric) < len(names) else "gauss" if numeric else "discrete"
        if kind == "discrete":
            return cpt.BicScores(df, names)
        if kind == "gauss":
            return discovery.GaussScores(df, names)
        if kind == "mixed":
            return MixedScores(df, numeric, [n for n in names if n not in numeric])
        raise ValueError(f"score: {kind!r}")

    def ledger(self) -> DataFrame:
        spark = self.join().df.sparkSession
        rows = [(k, g.method, g.names[i], g.names[j]) for k, g in enumerate(self.runs) for i, j in g.edges()]
        rows += [(-1, "manual", a, b) for a, b in sorted(self.manual)]
        return ledger.ledger(spark.createDataFrame(rows, "run int, method string, src string, dst string"))

    def add_edge(self, a: str, b: str) -> None:
        self.manual.add((a, b))
        self._dropped("runs")

    def select(self, edges: list[tuple[str, str]]) -> None:
        """Choose edges by hand; ValueError if they close a cycle."""
        network: dict[str, list[str]] = {n: [] for e in edges for n in e}
        for a, b in edges:
            network[b].append(a)
        inference.topological(network)
        self.selected = list(dict.fromkeys(edges))
        self._dropped("selection")

    def auto_select(self, min_freq: int = 1, top_k: int | None = None, only_allowed: bool = True) -> list[tuple[str, str]]:
        allowed = set(self.constraint().white_list()) if only_allowed else None
        self.select(ledger.selected(self.ledger(), allowed, min_freq, top_k))
        return self.selected

    def curated(self) -> CausalGraph:
        nodes = [n for n in self.nodes() if n.name in {x for e in self.selected for x in e}]
        names = list(unique_names(nodes).values())
        a = np.zeros((len(names),) * 2, bool)
        for s, t in self.selected:
            a[names.index(s), names.index(t)] = True
        return CausalGraph(nodes, a, method="curated", manual={(names.index(s), names.index(t)) for s, t in self.selected if (s, t) in self.manual}, derived_from=[g.id for g in self.runs])

    # the model and what it is asked

    def network(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {n: [] for e in self.selected for n in e}
        for a, b in self.selected:
            out[b].append(a)
        return out

    def fit(self, ess: float = 5.0) -> dict[str, DataFrame]:
        """Tables of all nodes of the selection from one pass over the rows, kept in the shared folder for each ess."""
        if not self.selected:
            raise ValueError("no edges are selected")
        if ess not in self._tables:
            self._tables[ess] = {n: materialise(t, "cpt") for n, t in inference.fit(self.join().df, self.network(), ess).items()}
        return self._tables[ess]

    def _rows(self, entity: str | None, conditions: dict[str, str] | None) -> DataFrame:
        """The rows asked about: an entity's (KeyError if it has none), and of them those that meet the conditions."""
        rows = self.join().df if entity is None else qa.rows_of(self.join().df, self.join().entities, entity)
        for n, v in (conditions or {}).items():
            rows = rows.where(F.col(n).cast("string") == v)
        return rows.select(*[F.col(n).cast("string").alias(n) for n in self.network()])

    def ask(self, kind: str, target: str, settings: dict[str, str], conditions: dict[str, str] | None = None, entity: str | None = None, draws: int = 200, ess: float = 5.0) -> qa.Answer:
        """Ask the model, and keep question and answer.

        entity: interventions and counterfactuals are then about the rows in which it stands, and about those of them that
        meet the conditions. What is conditioned on holds for the population, so that with an entity is a ValueError, and
        so are conditions that no row meets.
        """
        as_settings = lambda d: tuple(qa.Setting(n, v, entity) for n, v in sorted((d or {}).items()))
        q = qa.Query(kind, self.curated().id, target, as_settings(settings), as_settings(conditions), entity)
        network = self.network()
        q.check(network)
        if kind == "condition" and entity is not None:
            raise ValueError("a condition is about the population; its entity has no part in it")
        tables, level = self.fit(ess), target
        if kind == "counterfactual":
            rows = self._rows(entity, conditions)
            if rows.isEmpty():
                raise ValueError("no rows to ask about")
            worlds = counterfactual(numbered(rows, list(network)), tables, network, settings, draws, targets=[target])
            got, level, backend = cf_answer(worlds, target), "level", "gumbel-max-abduction"
        elif kind == "intervene" and entity is not None:
            got, backend = inference.intervene_rows(self._rows(entity, conditions), tables, network, target, settings), "truncated-factorisation-of-rows"
        elif kind == "intervene":
            got, backend = inference.intervene(tables, network, target, settings, conditions), "truncated-factorisation"
        else:
            evidence = {**settings, **(conditions or {})}
            backend = "mechanism" if inference.mechanism_applies(network, target, evidence) else "elimination"
            got = inference.condition(tables, network, target, evidence)
        found = {r[level]: r.p for r in got.collect()}
        a = qa.Answer(q.id, found, backend, draws if kind == "counterfactual" else 0, reaches=kind == "condition" or q.reaches_target(network))
        self.queries.append(q)
        self.answers.append(a)
        return a

    def replay(self) -> list[qa.Answer]:
        """Ask all kept questions again, of the model as it is now, and return the new answers in the same order; questions about another graph are left as they are.

        The answers that were kept for these questions are replaced.
        """
        now = self.curated().id
        of = {a.query: a for a in self.answers}
        again = [(q, of[q.id]) for q in self.queries if q.model == now and q.id in of]
        old = {q.id for q, _ in again}
        self.queries, self.answers = [q for q in self.queries if q.id not in old], [a for a in self.answers if a.query not in old]
        plain = lambda ss: {s.node: s.value for s in ss}
        return [self.ask(q.kind, q.target, plain(q.settings), plain(q.conditions) or None, q.entity, a.n_samples or 200) for q, a in again]
