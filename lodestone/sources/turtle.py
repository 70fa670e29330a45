"""Turtle files as triples: a small reader for prefixes, lists of predicates and objects, literals and blank nodes.

A file is parsed by one task, as its prefixes hold for all of it; many files are parsed in parallel. Graphs too large
for that belong in N-Triples, which any line splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "s string, p string, o string, o_kind string, o_dt string, o_lang string"
_XSD, _RDF = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_TOKEN = re.compile(
    r'\s+|#[^\n]*|(?P<iri><[^<>\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<text>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<at>@[A-Za-z][A-Za-z0-9\-]*)|(?P<dt>\^\^)'
    r"|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<blank>_:[\w\-]+)|(?P<name>[\w\-]*(?:\.[\w\-]+)*:(?:[\w\-%]+(?:\.[\w\-%]+)*)?|a(?![\w:\-])|true|false|PREFIX|BASE|prefix|base)|(?P<mark>[.;,\[\]()])"
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class TurtleError(ValueError):
    pass


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"not Turtle at {text[at : at + 40]!r}")
        at = m.end()
        if m.lastgroup:
            yield m.lastgroup, m[0]


def _unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" else _ESCAPES.get(m[1], m[1]), text)


class _Reader:
    def __init__(self, text: str, name: str):
        self.tokens, self.at = list(_tokens(text)), 0
        self.prefixes: dict[str, str] = {}
        self.base, self.name, self.blanks = "", name, 0
        self.out: list[tuple] = []

    def take(self, *marks: str) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TurtleError("the text ends within a statement")
        kind, text = self.tokens[self.at]
        if marks and text not in marks:
            raise TurtleError(f"{text!r} where one of {marks} should be")
        self.at += 1
        return kind, text

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            inner = _unescape(text[1:-1])
            return inner if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", inner) else self.base + inner
        if text == "a":
            return f"{_RDF}type"
        prefix, _, local = text.partition(":")
        if kind != "name" or prefix not in self.prefixes:
            raise TurtleError(f"no IRI or unknown prefix: {text!r}")
        return self.prefixes[prefix] + local

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:{self.name}-{self.blanks}"

    def node(self) -> tuple[str, str, str | None, str | None]:
        kind, text = self.take()
        if kind in ("text", "long"):
            value = _unescape(text[3:-3] if kind == "long" else text[1:-1])
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "at":
                return value, "literal", None, self.take()[1][1:]
            if self.peek() == "^^":
                self.take()
                return value, "literal", self.iri(*self.take()), None
            return value, "literal", None, None
        if kind == "number":
            return text, "literal", _XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        if text in ("true", "false"):
            return text, "literal", f"{_XSD}boolean", None
        if kind == "blank":
            return f"_:{self.name}-{text[2:]}", "bnode", None, None
        if text == "[":
            blank = self.fresh()
            if self.peek() != "]":
                self.properties(blank)
            self.take("]")
            return blank, "bnode", None, None
        if text == "(":
            items = []
            while self.peek() != ")":
                items.append(self.node())
            self.take(")")
            rest: tuple = (f"{_RDF}nil", "iri", None, None)
            for item in reversed(items):
                cell = self.fresh()
                self.out += [(cell, f"{_RDF}first", *item), (cell, f"{_RDF}rest", *rest)]
                rest = (cell, "bnode", None, None)
            return rest
        return self.iri(kind, text), "iri", None, None

    def properties(self, subject: str) -> None:
        while True:
            predicate = self.iri(*self.take())
            while True:
                self.out.append((subject, predicate, *self.node()))
                if self.peek() != ",":
                    break
                self.take(",")
            if self.peek() != ";":
                return
            while self.peek() == ";":
                self.take(";")
            if self.peek() in (".", "]"):
                return

    def read(self) -> list[tuple]:
        while self.at < len(self.tokens):
            text = self.peek().lower()
            if text in ("@prefix", "prefix"):
                self.take()
                prefix = self.take()[1].rstrip(":")
                self.prefixes[prefix] = self.iri(*self.take())
            elif text in ("@base", "base"):
                self.take()
                self.base = self.iri(*self.take())
            else:
                subject, *_ = self.node()
                if self.peek() != ".":
                    self.properties(subject)
                self.take(".")
                continue
            if text.startswith("@"):
                self.take(".")
        return self.out


def parse(text: str, name: str = "b") -> list[tuple]:
    """Triples of a text; blank nodes are named after `name`. TurtleError says what is wrong."""
    return _Reader(text, name).read()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The distinct triples of all Turtle files under a path that Spark reads."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha1

        names = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = parse(content.decode("utf-8"), sha1(path.encode()).hexdigest()[:8])
                for i in range(0, len(rows), 10_000):
                    part = rows[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in part], pa.string()) for k in range(6)], names=names)

    return files.mapInArrow(each, SCHEMA).distinct()
