"""Classes, properties and the property nodes that serve as variables; inference of a schema from triples."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.vocabulary import is_name, is_type, names


@dataclass(frozen=True, order=True)
class PropertyNode:
    """A variable: property `prop` of `domain`, with a datatype or a class as range."""

    domain: str
    prop: str
    range: str
    kind: str = "data"

    @property
    def name(self) -> str:
        return f"{self.domain}__{self.prop}"


@dataclass
class Schema:
    classes: set[str]
    data: dict[str, list[tuple[str, str]]] = field(default_factory=lambda: defaultdict(list))  # property: (domain, datatype)
    objects: dict[str, list[tuple[str, str]]] = field(default_factory=lambda: defaultdict(list))  # property: (domain, range)
    conflicts: dict[str, str] = field(default_factory=dict)

    def nodes(self) -> list[PropertyNode]:
        """All property nodes in the order of domain, property, range."""
        return sorted(PropertyNode(d, p, r, kind) for kind, found in (("data", self.data), ("object", self.objects)) for p, pairs in found.items() for d, r in pairs)

    def relations(self) -> list[tuple[str, str, str]]:
        """(domain, property, range) of object properties, sorted."""
        return sorted((d, p, r) for p, pairs in self.objects.items() for d, r in pairs)

    def summary(self) -> dict[str, int]:
        return {"classes": len(self.classes), "data_properties": len(self.data), "object_properties": len(self.objects), "conflicts": len(self.conflicts)}


def unique_names(nodes: list[PropertyNode]) -> dict[PropertyNode, str]:
    """Names by node; the second and later nodes of a name get _2, _3 and so on, in node order."""
    seen: dict[str, int] = defaultdict(int)
    out = {}
    for n in sorted(nodes):
        seen[n.name] += 1
        out[n] = n.name if seen[n.name] == 1 else f"{n.name}_{seen[n.name]}"
    return out


def mapped_schema(source) -> Schema:
    """The schema of a MappedSource, with Spark's names as datatypes."""
    schema = Schema(set(source.classes))
    for cls, m in source.classes.items():
        types = dict(source.frame(cls, list(m.data), []).dtypes)
        for c in m.data:
            schema.data[c].append((cls, types[f"{cls}__{c}"]))
        for c, to in m.objects.items():
            schema.objects[c].append((cls, to))
    return schema


def infer_properties(triples: DataFrame) -> DataFrame:
    """(p, kind, domain, range, datatype): what the use of each predicate shows, for all predicates in one pass of joins.

    A predicate is data if all its objects are literals (the commonest datatype, of equals the least, is its range),
    object if any is an IRI (each typed class of its objects is a range), else a conflict. Untyped subjects don't count.
    """
    types = triples.where(is_type(F.col("p"))).select("s", F.col("o").alias("cls")).distinct()
    facts = triples.where(~is_type(F.col("p")))
    datatype = F.coalesce(F.col("o_dt"), F.lit("xsd:string")) if "o_dt" in triples.columns else F.lit("xsd:string")
    kinds = facts.groupBy("p").agg(F.bool_and(F.col("o_kind") == "literal").alias("all_literal"), F.bool_or(F.col("o_kind") == "iri").alias("any_iri"), F.mode(F.when(F.col("o_kind") == "literal", datatype), True).alias("datatype"))
    domains = facts.join(types, "s").select("p", F.col("cls").alias("domain")).distinct()
    ranges = facts.where("o_kind = 'iri'").join(types.select(F.col("s").alias("o"), F.col("cls").alias("range")), "o").select("p", "range").distinct()
    kind = F.when(F.col("all_literal"), "data").when(F.col("any_iri"), "object").otherwise("conflict")
    typed = domains.join(kinds.withColumn("kind", kind), "p")
    data = typed.where("kind = 'data'").select("p", "kind", "domain", F.col("datatype").alias("range"))
    objects = typed.where("kind = 'object'").join(ranges, "p").select("p", "kind", "domain", "range")
    return data.unionByName(objects).unionByName(typed.where("kind = 'conflict'").select("p", "kind", "domain", F.lit(None).cast("string").alias("range")))


def declared_classes(triples: DataFrame) -> DataFrame:
    """cls: what is declared an owl:Class or rdfs:Class."""
    return triples.where(is_type(F.col("p")) & is_name(F.col("o"), "owl:Class", "rdfs:Class")).select(F.col("s").alias("cls")).distinct()


def declared_properties(triples: DataFrame) -> DataFrame:
    """(p, kind, domain, range) of owl:DatatypeProperty and owl:ObjectProperty declarations, a row for each pair of a domain and a range; without a domain there is none, and a missing range of a data property is a string."""
    kind = F.when(is_name(F.col("o"), "owl:DatatypeProperty"), "data").when(is_name(F.col("o"), "owl:ObjectProperty"), "object")
    found = triples.where(is_type(F.col("p"))).select(F.col("s").alias("p"), kind.alias("kind")).where("kind IS NOT NULL").distinct()
    side = lambda short, name: triples.where(is_name(F.col("p"), short)).select(F.col("s").alias("p"), F.col("o").alias(name)).distinct()
    joined = found.join(side("rdfs:domain", "domain"), "p").join(side("rdfs:range", "range"), "p", "left")
    return joined.withColumn("range", F.when(F.col("kind") == "data", F.coalesce("range", F.lit("xsd:string"))).otherwise(F.col("range"))).where("range IS NOT NULL")


def texts_of(triples: DataFrame) -> DataFrame:
    """(s, label, comment): the least rdfs:label and rdfs:comment of each subject that has one."""
    least = lambda short: F.min(F.when(is_name(F.col("p"), short), F.col("o")))
    return triples.where(F.col("p").isin(names("rdfs:label", "rdfs:comment"))).groupBy("s").agg(least("rdfs:label").alias("label"), least("rdfs:comment").alias("comment"))


def undeclared_predicates(triples: DataFrame) -> DataFrame:
    """p: predicates in use that no declaration names, vocabulary terms left out."""
    used = triples.where(~F.col("p").rlike(r"^(rdfs?:|owl:|http://www\.w3\.org/)")).select("p").distinct()
    return used.join(declared_properties(triples).select("p").distinct(), "p", "left_anti")


def schema_of(triples: DataFrame, infer_missing: bool = True) -> Schema:
    """The declared schema; with infer_missing, what no declaration names is inferred from use. Both are as small as the vocabulary."""
    declared = Schema({r.cls for r in declared_classes(triples).collect()})
    for r in declared_properties(triples).orderBy("p", "domain", "range").collect():
        (declared.data if r.kind == "data" else declared.objects)[r.p].append((r.domain, r.range))
        declared.classes |= {r.domain} | ({r.range} if r.kind == "object" else set())
    if infer_missing:
        known = set(declared.data) | set(declared.objects)
        use = inferred_schema(triples.where(~F.col("p").rlike(r"^(rdfs:|owl:|http://www\.w3\.org/(2000|2002)/)")))
        for p in sorted(set(use.data) - known):
            declared.data[p] = use.data[p]
        for p in sorted(set(use.objects) - known):
            declared.objects[p] = use.objects[p]
        declared.conflicts |= {p: why for p, why in use.conflicts.items() if p not in known}
        declared.classes |= {c for p in [*declared.data, *declared.objects] if p not in known for c, _ in [*use.data.get(p, []), *use.objects.get(p, [])]}
    return declared


def inferred_schema(triples: DataFrame) -> Schema:
    """The inferred properties as a schema; they are as few as the predicates."""
    rows = infer_properties(triples).collect()
    schema = Schema({r.domain for r in rows} | {r.range for r in rows if r.kind == "object"})
    for r in sorted(rows, key=lambda r: (r.p, r.domain, r.range or "")):
        if r.kind == "conflict":
            schema.conflicts[r.p] = "objects are neither literals nor entities"
        else:
            (schema.data if r.kind == "data" else schema.objects)[r.p].append((r.domain, r.range))
    return schema
