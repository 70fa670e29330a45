"""RDF collections as rows: chains of rdf:first and rdf:rest, ranked by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import materialise

_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


class BrokenList(ValueError):
    """A cell without exactly one item and one rest, a rest that is no cell, two cells with one rest, or a circle."""


def _is(p: Column, name: str) -> Column:
    return p.isin(f"rdf:{name}", _RDF + name)


def list_items(triples: DataFrame) -> DataFrame:
    """head, place (from 0), item of every list in s, p, o triples; BrokenList if a chain is no list.

    Each cell points at the one before it; in a round it points at what that one points at, so a list of n cells takes
    log2(n) rounds, each a join of the cells with themselves. An empty list has no cells and so no rows.
    """
    first, rest = _is(F.col("p"), "first"), _is(F.col("p"), "rest")
    cells = triples.where(first | rest).select("s", "p", "o").distinct().groupBy("s").agg(F.count(F.when(first, 1)).alias("n_first"), F.count(F.when(rest, 1)).alias("n_rest"), F.max(F.when(first, F.col("o"))).alias("item"), F.max(F.when(rest, F.col("o"))).alias("rest"))
    cells = materialise(cells, "cells")
    odd = cells.where("n_first <> 1 OR n_rest <> 1").select("s").first()
    if odd:
        raise BrokenList(f"{odd.s}: not one item and one rest")
    links = cells.where(~F.col("rest").isin("rdf:nil", _RDF + "nil")).select(F.col("rest").alias("cell"), F.col("s").alias("before"))
    lost = links.join(cells.select(F.col("s").alias("cell")), "cell", "left_anti").first()
    if lost:
        raise BrokenList(f"{lost.before}: its rest {lost.cell} is no cell")
    shared = links.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").first()
    if shared:
        raise BrokenList(f"{shared.cell}: the rest of several cells")
    n = cells.count()
    at = cells.select(F.col("s").alias("cell"), "item").join(links, "cell", "left").select("cell", "item", F.coalesce("before", "cell").alias("up"), F.col("before").isNotNull().cast("long").alias("place"))
    at = materialise(at, "ranks")
    heads = at.where("place = 0").select(F.col("cell").alias("up"))
    reach = 1
    while reach < n:
        further = at.select(F.col("cell").alias("up"), F.col("up").alias("above"), F.col("place").alias("more"))
        at = materialise(at.join(further, "up").select("cell", "item", F.col("above").alias("up"), (F.col("place") + F.col("more")).alias("place")), "ranks")
        reach *= 2
        if at.join(heads, "up", "left_anti").isEmpty():
            break
    circle = at.join(heads, "up", "left_anti").first()
    if circle:
        raise BrokenList(f"{circle.cell}: in a circle")
    return at.select(F.col("up").alias("head"), "place", "item")
