"""IRIs of the RDF, RDFS and OWL vocabularies that the readers know."""

from __future__ import annotations

from pyspark.sql import Column

# Fixed values of the published vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
PREFIXES = {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD}


def names(*short: str) -> list[str]:
    """Each name, given as prefix:local, in both its forms: the short one, which triples made here use, and the full IRI."""
    return [x for s in short for x in (s, PREFIXES[s.split(":")[0]] + s.split(":")[1])]


def is_name(column: Column, *short: str) -> Column:
    return column.isin(names(*short))


def is_type(column: Column) -> Column:
    return is_name(column, "rdf:type")
