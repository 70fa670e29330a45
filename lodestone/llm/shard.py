"""K-d tree partitioning into shards of nearly equal bytes, with DataFrame functions only.

A node of k shards is split at the weighted quantile k_left / k of its bytes along its widest metadata dimension (the
range of values against the whole table's), until each leaf is one shard and so holds the target bytes. Rows of equal
value are ordered by a hash of all their metadata and text, and rows equal in all of it by a hash of their number in the
table, so a value or a whole row that a third of all rows share is split as well as any.

The quantiles of all nodes of a level are found together: each round sums the bytes of 4,096 cells of every node's
open interval in Spark, with partial aggregation, and keeps the cell of the quantile. At most that many sums for each of
half the shards reach the driver, whatever the input; rows never do, and no task sees a whole node or shard.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialise

SHARDS = 24
CELL_BITS = 12
#: A cut may leave this share of a shard on the wrong side before another round of cells is worth while.
TOLERANCE = 0.002
#: Rows of one block of a shard, within which they are numbered.
SLOT_ROWS = 2048
#: Rounds of cells that a key has: the first along the dimension, over the node's own range, the next by the row's hash, the last by that of its number.
ROUNDS = 5


def _prefix_number(name: str) -> Column:
    """The first seven UTF-8 bytes as a number, which keeps the order of strings; null as an empty one."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(F.col(name).cast("string"), F.lit("")), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("double")


#: The metadata dimensions.
DIMENSIONS = {"d_source": _prefix_number, "d_lang": _prefix_number, "d_id": lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(-1.0)), "d_size": lambda c: F.log1p(F.col(c).cast("double"))}
_COLUMNS = {"d_source": "source", "d_lang": "lang", "d_id": "doc_id", "d_size": "size"}


@dataclass
class Node:
    """`n` shards from `first` on, with their bytes; if it is split: the dimension, its range in the node, and the last key of the left side."""

    first: int
    n: int
    total: int = 0
    dim: str = ""
    low: float = 0.0
    high: float = 0.0
    cut: int = -1


def _by_node(nodes: list[Node], value) -> Column:
    """value(node) for the node of a row; null for other nodes."""
    return F.create_map(*[x for n in nodes for x in (F.lit(n.first), F.lit(value(n)))])[F.col("node")]


def _key(nodes: list[Node]) -> Column:
    """CELL_BITS of the row's place in its node's range of the node's dimension, below them a hash of the row, and last one of its number."""
    value = F.coalesce(*[F.when(F.col("node").isin([n.first for n in nodes if n.dim == d]), F.col(d)) for d in sorted({n.dim for n in nodes})])
    place = F.floor((value - _by_node(nodes, lambda n: n.low)) * _by_node(nodes, lambda n: ((1 << CELL_BITS) - 1) / (n.high - n.low) if n.high > n.low else 0.0))
    below = (ROUNDS - 1) * CELL_BITS
    own = F.shiftleft(F.pmod(F.col("h"), F.lit(1 << (below - CELL_BITS))), CELL_BITS) + F.pmod(F.col("tie"), F.lit(1 << CELL_BITS))
    return F.shiftleft(place.cast("long"), below) + own


def _split(rows: DataFrame, nodes: list[Node], extent: dict[str, float], target: float) -> list[Node]:
    """The nodes that have rows, with dimension and cut."""
    dims = list(extent)
    of = {n.first: n for n in nodes}
    for r in rows.groupBy("node").agg(F.sum("size").alias("total"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("low", F.min), ("high", F.max))]).collect():
        n = of[r.node]
        spread = {d: (r[f"high_{d}"] - r[f"low_{d}"]) / extent[d] if extent[d] > 0 else 0.0 for d in dims}
        n.total, n.dim = r.total, max(dims, key=lambda d: (spread[d], d))
        n.low, n.high = r[f"low_{n.dim}"], r[f"high_{n.dim}"]
    nodes = [n for n in nodes if n.dim]
    searched, before, base = nodes, {n.first: 0 for n in nodes}, {n.first: 0 for n in nodes}
    for shift in range((ROUNDS - 1) * CELL_BITS, -1, -CELL_BITS):
        keyed = rows.where(F.col("node").isin([n.first for n in searched])).select("node", _key(searched).alias("key"), "size")
        inside = F.shiftright("key", shift + CELL_BITS) == _by_node(searched, lambda n, s=shift + CELL_BITS: base[n.first] >> s)
        cells = keyed.where(inside).groupBy("node", F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
        cells.sort(key=lambda r: (r.node, r.cell))
        left: list[Node] = []
        for n in searched:
            wanted, seen = n.total * (n.n // 2) / n.n, before[n.first]
            for r in (r for r in cells if r.node == n.first):
                if seen + r.bytes >= wanted:
                    less, more = wanted - seen, seen + r.bytes - wanted
                    n.cut = ((r.cell + (less >= more)) << shift) - 1
                    if min(less, more) > TOLERANCE * target and shift and r.rows > 1:
                        before[n.first], base[n.first] = seen, r.cell << shift
                        left.append(n)
                    break
                seen += r.bytes
        searched = left
        if not searched:
            break
    return nodes


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32 and shard of each document, and tie, a hash of its row number.

    Null texts have no bytes; null metadata sorts first; rows equal in all metadata and text are dealt by the number
    that they get when the metadata is written, which stays fixed from there; a missing metadata column doesn't count; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    present = {c.lower() for c in docs.columns}
    dims = {d: c for d, c in _COLUMNS.items() if c in present or c == "size"}
    flat = docs.select("doc_id", *[c for c in ("source", "lang") if c in present], (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = materialise(flat.select("doc_id", "size", "text_crc32", *[DIMENSIONS[d](c).alias(d) for d, c in dims.items()], F.xxhash64(*flat.columns).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"), F.lit(0).alias("node")), "metadata")
    whole = rows.agg(F.sum("size").alias("total"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    level = [Node(0, shards)] if whole.total is not None else []
    while level := [n for n in level if n.n > 1]:
        level = _split(rows.where(F.col("node").isin([n.first for n in level])), level, {d: whole[d] for d in dims}, whole.total / shards)
        right = F.coalesce(_key(level) > _by_node(level, lambda n: n.cut), F.lit(False))
        rows = materialise(rows.withColumn("node", F.col("node") + F.when(right, _by_node(level, lambda n: n.n // 2)).otherwise(0)), "nodes")
        level = [p for n in level for p in (Node(n.first, n.n // 2), Node(n.first + n.n // 2, n.n - n.n // 2))]
    return rows.select("doc_id", "size", "text_crc32", "tie", F.col("node").alias("shard"))


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """rows with their block; equal rows part by their tie."""
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", "tie"), F.lit(blocks)))


def with_slots(rows: DataFrame) -> DataFrame:
    """rows without tie, with slot: gapless from 0 within each shard. Rows are numbered in blocks of about SLOT_ROWS, by a hash; sums of the block sizes before say where each block begins."""
    from pyspark.sql import Window

    blocks = max(1, ceil(rows.count() / SLOT_ROWS / 8))
    dealt = _dealt(rows, blocks)
    numbered = dealt.withColumn("place", F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size", "tie")))
    sizes = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    begin = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "block", F.coalesce(begin, F.lit(0)).alias("begin"))
    return numbered.join(starts, ["shard", "block"]).withColumn("slot", F.col("begin") + F.col("place") - 1).drop("block", "place", "begin", "tie")


def op4_kd_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.common import table

    rows = with_slots(kd_shards(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
