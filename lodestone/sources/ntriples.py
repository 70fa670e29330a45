"""N-Triples and N-Quads in and out, as Column expressions over lines of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import local_name
from lodestone.vocabulary import is_type

_TERM = r'(<[^>]*>|_:[^\s]+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9\-]+)?)'
_LINE = rf"^\s*(<[^>]*>|_:[^\s]+)\s+(<[^>]*>)\s+{_TERM}\s*(<[^>]*>)?\s*\.\s*(?:#.*)?$"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _plain(term: Column) -> Column:
    return F.when(term.startswith("<"), _unescaped(term.substr(F.lit(2), F.length(term) - 2))).otherwise(term)


def _unescaped(text: Column) -> Column:
    """Escapes of one character, and of a code point by four or eight hex digits, each read once from left to right."""
    marks = {"\\t": "\t", "\\b": "\b", "\\n": "\n", "\\r": "\r", "\\f": "\f"}

    def read(part: Column) -> Column:
        code = F.decode(F.unhex(F.lpad(part.substr(F.lit(3), F.length(part)), 8, "0")), "UTF-32")
        out = F.when(part.rlike(r"^\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})$"), code)
        for short, long in marks.items():
            out = out.when(part == short, F.lit(long))
        return out.when(part.startswith("\\"), part.substr(F.lit(2), F.length(part))).otherwise(part)

    parts = F.regexp_extract_all(text, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), 1)
    return F.when(text.contains("\\"), F.array_join(F.transform(parts, read), "")).otherwise(text)


def _escaped(text: Column) -> Column:
    for char, short in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(short))
    return text


def parse(lines: DataFrame, column: str = "value", strict: bool = True) -> DataFrame:
    """s, p, o, o_kind (iri, literal, bnode), o_dt, o_lang and g, as a set. Blank lines and comments are passed over; a
    line that is none of these raises if strict, else it is left out."""
    line = F.col(column)
    rows = lines.where(~line.rlike(r"^\s*(#.*)?$"))
    part = [F.regexp_extract(line, _LINE, i) for i in range(1, 5)]
    rows = rows.select(line.alias("line"), *[x.alias(n) for x, n in zip(part, ("s", "p", "t", "g"), strict=True)])
    rows = rows.withColumn("s", F.when(F.col("s") == "", F.raise_error(F.concat(F.lit("no triple: "), "line"))).otherwise(F.col("s"))) if strict else rows.where("s <> ''")
    t = F.col("t")
    literal = t.startswith('"')
    body = F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*)"', 1)
    dt, lang = F.regexp_extract(t, r'"\^\^<([^>]*)>$', 1), F.regexp_extract(t, r'"@([A-Za-z0-9\-]+)$', 1)
    return rows.select(
        _plain(F.col("s")).alias("s"),
        _plain(F.col("p")).alias("p"),
        F.when(literal, _unescaped(body)).otherwise(_plain(t)).alias("o"),
        F.when(literal, "literal").when(t.startswith("<"), "iri").otherwise("bnode").alias("o_kind"),
        F.when(literal & (dt != ""), dt).alias("o_dt"),
        F.when(literal & (lang != ""), lang).alias("o_lang"),
        F.when(F.col("g") != "", _plain(F.col("g"))).alias("g"),
    ).distinct()


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return parse(spark.read.text(path), strict=strict)


def lines(triples: DataFrame) -> DataFrame:
    """value: one line for each distinct triple, with a graph name where g is there and not null."""
    has = set(triples.columns)

    def name(c: str) -> Column:
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))

    tail = F.lit("")
    if "o_dt" in has:
        tail = F.when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise(tail)
    if "o_lang" in has:
        tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise(tail)
    literal = F.concat(F.lit('"'), _escaped(F.col("o")), F.lit('"'), tail)
    graph = F.when(F.col("g").isNotNull(), F.concat(F.lit(" <"), "g", F.lit(">"))).otherwise("") if "g" in has else F.lit("")
    return triples.select(F.concat(name("s"), F.lit(" "), name("p"), F.lit(" "), F.when(F.col("o_kind") == "literal", literal).otherwise(name("o")), graph, F.lit(" .")).alias("value")).distinct()


def write(triples: DataFrame, path: str) -> None:
    lines(triples).write.text(path)


def localised(triples: DataFrame) -> DataFrame:
    """triples with local names for predicates, classes and what declares them; entities keep their IRIs.

    An object is a name of the schema where its subject is declared: the subjects of rdfs and owl triples, and the
    objects of these and of types, lose what stands before the last # or /.
    """
    declares = F.col("p").rlike(r"^(rdfs:|http://www\.w3\.org/2000/01/rdf-schema#)") | (is_type(F.col("p")) & F.col("o").rlike(r"^(owl:|rdfs:|http://www\.w3\.org/(2002/07/owl|2000/01/rdf-schema)#)"))
    known = F.col("p").rlike(r"^(rdfs?:|owl:|http://www\.w3\.org/)")
    o = F.when((F.col("o_kind") == "iri") & (is_type(F.col("p")) | declares) & ~F.col("o").rlike(r"^http://www\.w3\.org/"), local_name(F.col("o"))).otherwise(F.col("o"))
    return triples.withColumns({"s": F.when(declares, local_name(F.col("s"))).otherwise(F.col("s")), "p": F.when(known, F.col("p")).otherwise(local_name(F.col("p"))), "o": o})


class TripleSource:
    """Frames of entities from triples with local property names: one grouped scan of a class's own facts for each class."""

    def __init__(self, triples: DataFrame):
        from types import SimpleNamespace

        self.triples = triples
        self.classes = _Keyed(lambda cls: SimpleNamespace(key=("iri",)))

    def iri(self, cls: str, columns: tuple[str, ...]) -> Column:
        return F.col(columns[0])

    def values(self, cls: str, prop: str | None, classes: list[str]) -> DataFrame:
        """Entity and value of a property, or the classes of the schema that it has; repeated facts count once."""
        fits = is_type(F.col("p")) & F.col("o").isin(classes) if prop is None else F.col("p") == prop
        return self.triples.where(fits).select(F.col("s").alias("entity"), F.col("o").alias("value")).distinct()

    def frame(self, cls: str, data: list[str], objects: list[str]) -> DataFrame:
        """A row for each entity and combination of its values: one pass gathers the distinct values of each property beside whether the entity is of the class, then they are exploded; absent ones are null."""
        wanted = list(dict.fromkeys([*data, *objects]))
        member = is_type(F.col("p")) & (F.col("o") == cls)
        values = [F.sort_array(F.collect_set(F.when(F.col("p") == p, F.col("o")))).alias(f"v{i}") for i, p in enumerate(wanted)]
        out = self.triples.where(member | F.col("p").isin(wanted)).groupBy("s").agg(F.bool_or(member).alias("_member"), *values).where("_member")
        for i in range(len(wanted)):
            out = out.withColumn(f"v{i}", F.explode_outer(f"v{i}"))
        return out.select(F.col("s").alias(f"{cls}__iri"), *[F.col(f"v{i}").alias(f"{cls}__{p}") for i, p in enumerate(wanted)])


class _Keyed(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = self.make(key)
        return self[key]
