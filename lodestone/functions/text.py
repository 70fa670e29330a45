"""Scalar functions on names, and deterministic identifiers and random numbers, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_name(iri: Column) -> Column:
    """What follows the last # and then the last /; the whole if that is empty."""
    after = F.element_at(F.split(F.element_at(F.split(iri, "#"), -1), "/"), -1)
    return F.when(after == "", iri).otherwise(after)


def localise(value: Column) -> Column:
    """The local name of http names, all else as it is."""
    return F.when(value.startswith("http"), local_name(value)).otherwise(value)


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.\-]", "_")


def natural_key(text: Column) -> Column:
    """A sort key that orders runs of digits by value: each is filled with zeros to 20 places."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 20, "0")).otherwise(r)), "")


def short_hash(length: int, *parts: Column) -> Column:
    """The first hex digits of the sha1 of the parts, joined by |; a null part counts as the text None."""
    return F.substring(F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]).cast("binary")), 1, length)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) that seed and keys decide, wherever and in whatever order rows are handled."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (h.cast("double") + 0.5) / F.lit(float(1 << 53))


def gumbel(u: Column) -> Column:
    return -F.log(-F.log(u))


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number by Box and Muller from two hash uniforms."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * F.pi() * uniform(seed + 1, *keys))
