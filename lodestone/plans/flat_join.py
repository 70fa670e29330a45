"""The flat join: one row for each combination of linked entities, with their properties as columns.

One variable for each class that takes part; every object property that joins is an equality of its column with its
range's key. A tree of them becomes equi-joins that Catalyst orders and places; the others, which close cycles, are
filters. Data properties of a class that takes part restrict rows even where they are not shown, unless optional.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.schema import PropertyNode, Schema, unique_names


class DisconnectedJoin(ValueError):
    """The classes fall into groups that no object property links, and no limit bounds their product."""


@dataclass
class FlatJoin:
    df: DataFrame
    entities: list[str]
    columns: list[str]
    skipped: list[PropertyNode] = field(default_factory=list)
    residual: list[PropertyNode] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def multiplicity(self) -> DataFrame:
        """(entity, multiplicity): rows for each distinct entity; 0 without rows."""
        counts = self.df.agg(F.count("*").alias("rows"), *[F.count_distinct(e).alias(e) for e in self.entities])
        pairs = F.explode(F.array(*[F.struct(F.lit(e).alias("entity"), F.when(F.col(e) > 0, F.col("rows") / F.col(e)).otherwise(0.0).alias("multiplicity")) for e in self.entities]))
        return counts.select(pairs.alias("m")).select("m.*")


def components(classes: set[str], relations: list[PropertyNode]) -> list[set[str]]:
    """Groups of classes that the relations link, in the order of their least class."""
    group = {c: c for c in classes}

    def root(c: str) -> str:
        while group[c] != c:
            c = group[c]
        return c

    for r in relations:
        a, b = sorted((root(r.domain), root(r.range)))
        group[b] = a
    found: dict[str, set[str]] = {}
    for c in sorted(classes):
        found.setdefault(root(c), set()).add(c)
    return [found[k] for k in sorted(found)]


def role_can_be_variable(schema: Schema, joined: list[PropertyNode], node: PropertyNode, active: set[str]) -> bool:
    """Whether showing the object property as a column, not joining it, leaves no more groups than joining it."""
    others = [n for n in joined if n != node]
    return len(components(active, others)) <= len(components(active, [*others, node]))


#: Where an object property's column shows the related entity's class, as the property that says it; else one of its properties.
CLASS = "rdf:type"


def value_only_classes(schema: Schema) -> set[str]:
    """Classes that have no data property: joined, they add no column; their entities are values."""
    return schema.classes - {d for pairs in schema.data.values() for d, _ in pairs}


def value_variables(schema: Schema) -> list[PropertyNode]:
    """Object properties whose range is a value-only class, in order of their names, but for those without whose join classes with data would fall into more groups."""
    values, nodes = value_only_classes(schema), schema.nodes()
    links = [n for n in nodes if n.kind == "object" and n.domain != n.range]
    classes = {c for n in nodes for c in ((n.domain, n.range) if n.kind == "object" else (n.domain,))}
    groups = lambda rest: sum(1 for g in components(classes, rest) if g - values)
    found: list[PropertyNode] = []
    for n in sorted((n for n in nodes if n.kind == "object" and n.range in values), key=lambda n: n.name):
        rest = [x for x in links if x not in found]
        if groups([x for x in rest if x != n]) <= groups(rest):
            found.append(n)
    return found


def flat_join(schema: Schema, source, retained: list[PropertyNode], joined: list[PropertyNode] | None = None, optional: bool = False, limit: int | None = None, show_keys: bool = True, values: dict[str, str] | None = None) -> FlatJoin:
    """retained: data nodes to show, and object nodes to show as a column. joined: object nodes that join; by default all
    whose two classes take part. limit bounds the rows and allows unlinked groups.

    values: what the columns of object nodes show, by their names, where it isn't the related entity's name: CLASS for the
    classes of the schema that it has, else the values of that property of it. Classes and properties are looked up
    beside the join: the range takes no part by that, and none of its other properties restrict rows. An entity with
    several gives several rows, one with none no row (a null if optional). A property that the range does not have is
    replaced by its class, with a warning.
    """
    active = {n.domain for n in retained} | {c for n in joined or () for c in (n.domain, n.range)}
    if joined is None:
        joined = [n for n in schema.nodes() if n.kind == "object" and n not in retained and {n.domain, n.range} <= active]
    skipped = [n for n in joined if n.domain == n.range]
    links = [n for n in joined if n.domain != n.range]
    groups = components(active, links)
    if len(groups) > 1 and limit is None:
        raise DisconnectedJoin(f"no object property links {' | '.join(', '.join(sorted(g)) for g in groups)}")
    shown = [n for n in retained if n.kind == "object"]
    residual: list[PropertyNode] = []
    at = unique_names(list({*links, *shown, *retained}))  # a property with several ranges has a column for each

    def frame(cls: str) -> DataFrame:
        data = [p for p, pairs in schema.data.items() for d, _ in pairs if d == cls]
        out = source.frame(cls, data, [n.prop for n in [*links, *shown] if n.domain == cls])
        for n in {*links, *shown}:
            if n.domain == cls and at[n] != n.name:  # its values are bound apart from those of the other range
                own = source.frame(cls, [], [n.prop]).select(*key(cls), F.col(n.name).alias(at[n]))
                out = out.join(own.dropDuplicates(), key(cls))
        needed = [at[n] for n in [*links, *shown] if n.domain == cls] + ([] if optional else [f"{cls}__{p}" for p in data])
        return out.dropna(subset=needed) if needed else out

    for n in links:
        if len(source.classes[n.range].key) > 1:
            raise ValueError(f"{n.name}: {n.range} has a key of several columns, which one column can't match")

    def key(cls: str) -> list[str]:
        return [f"{cls}__{k}" for k in source.classes[cls].key]

    joins: list[DataFrame] = []
    for group in groups:
        own = [n for n in links if n.domain in group]
        inside, used = {min(group)}, set()
        df = frame(min(group))
        while len(inside) < len(group):
            n = next(n for n in own if n not in used and len({n.domain, n.range} & inside) == 1)
            new = n.range if n.domain in inside else n.domain
            df = df.join(frame(new), F.col(at[n]) == F.col(key(n.range)[0]))
            inside.add(new)
            used.add(n)
        for n in own:
            if n not in used:
                df = df.where(F.col(at[n]) == F.col(key(n.range)[0]))
                residual.append(n)
        joins.append(df)
    df = reduce(lambda a, b: a.crossJoin(b), [j.limit(limit) for j in joins] if len(joins) > 1 else joins)
    entities = [c for cls in sorted(active) for c in key(cls)]
    columns = [at[n] for n in sorted(retained) if n.kind == "data"]
    warnings: list[str] = []
    for n in shown:
        wanted = (values or {}).get(n.name)
        if wanted:
            if wanted != CLASS and n.range not in {d for d, _ in schema.data.get(wanted, ())}:
                warnings.append(f"{n.name}: {n.range} has no property {wanted}; its class stands instead")
                wanted = CLASS
            found = source.values(n.range, None if wanted == CLASS else wanted, sorted(schema.classes)).toDF("_entity", "_value")
            df = df.join(found, df[at[n]] == F.col("_entity"), "left" if optional else "inner").withColumn(at[n], F.col("_value")).drop("_entity", "_value")
    plain = {n for n in shown if not (values or {}).get(n.name)}
    column = lambda n: at[n] if n.kind == "object" else n.name  # noqa: E731  a data property's values are the same whatever its datatypes
    named = [(source.iri(n.range, (at[n],)) if n in plain else F.col(column(n))).alias(at[n]) for n in sorted(retained)]
    out = df.select(*([F.col(e) for e in entities if e not in {at[n] for n in retained}] if show_keys else []), *named)
    return FlatJoin(out if limit is None else out.limit(limit), entities, columns, skipped, residual, warnings)


def component_joins(schema: Schema, source, retained: list[PropertyNode], joined: list[PropertyNode] | None = None, optional: bool = False) -> list[FlatJoin]:
    """One flat join for each group of linked classes, in the order of their least class, so that none is a product."""
    active = {n.domain for n in retained} | {c for n in joined or () for c in (n.domain, n.range)}
    if joined is None:
        joined = [n for n in schema.nodes() if n.kind == "object" and n not in retained and {n.domain, n.range} <= active]
    groups = components(active, [n for n in joined if n.domain != n.range])
    return [flat_join(schema, source, [n for n in retained if n.domain in g], [n for n in joined if n.domain in g], optional) for g in groups]


def main_component(joins: list[FlatJoin]) -> int:
    """The join with the most shown variables; of equal ones the first."""
    return max(range(len(joins)), key=lambda i: (len(joins[i].columns), -i))
