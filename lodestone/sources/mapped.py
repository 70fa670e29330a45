"""Relational tables read as entities and properties: a direct mapping of tables to classes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class ClassMap:
    """A table as a class: the columns that make its key, its data properties, and object properties as {column: class}."""

    table: str
    key: tuple[str, ...]
    data: tuple[str, ...]
    objects: dict[str, str] = field(default_factory=dict)


#: The standard tables as classes.
TABLES = {
    "Region": ClassMap("region", ("r_regionkey",), ("r_name",)),
    "Nation": ClassMap("nation", ("n_nationkey",), ("n_name",), {"n_regionkey": "Region"}),
    "Customer": ClassMap("customer", ("c_custkey",), ("c_name", "c_acctbal", "c_mktsegment"), {"c_nationkey": "Nation"}),
    "Supplier": ClassMap("supplier", ("s_suppkey",), ("s_name", "s_acctbal"), {"s_nationkey": "Nation"}),
    "Part": ClassMap("part", ("p_partkey",), ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "Order": ClassMap("orders", ("o_orderkey",), ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), {"o_custkey": "Customer"}),
    "Lineitem": ClassMap("lineitem", ("l_orderkey", "l_linenumber"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"), {"l_orderkey": "Order", "l_partkey": "Part", "l_suppkey": "Supplier"}),
}


@dataclass
class MappedSource:
    """Frames of entities from tables. A class is one scan, of the columns that the plan asks for only."""

    spark: SparkSession
    folder: str
    classes: dict[str, ClassMap] = field(default_factory=lambda: dict(TABLES))

    def iri(self, cls: str, columns: tuple[str, ...] | None = None) -> Column:
        """The name of an entity, from its key or from columns that refer to it."""
        return F.concat(F.lit(f"{cls}/"), F.concat_ws("-", *[F.col(c).cast("string") for c in columns or self.classes[cls].key]))

    def frame(self, cls: str, data: list[str], objects: list[str]) -> DataFrame:
        """A row for each entity: its key columns, data and object properties, all named Class__column. Keys stay typed, so that joins compare numbers."""
        m = self.classes[cls]
        wanted = list(dict.fromkeys([*m.key, *data, *objects]))
        return table(self.spark, self.folder, m.table).select(*[F.col(c).alias(f"{cls}__{c}") for c in wanted])

    def values(self, cls: str, prop: str | None, classes: list[str]) -> DataFrame:
        """The key of each entity and its value of a property, or its class; nulls are left out."""
        m = self.classes[cls]
        return table(self.spark, self.folder, m.table).select(F.col(m.key[0]).alias("entity"), (F.lit(cls) if prop is None else F.col(prop)).alias("value")).dropna()

    def triples(self, cls: str) -> DataFrame:
        """The class as (s, p, o, o_kind): a type triple, and one for each property that is not null, from one scan."""
        m = self.classes[cls]
        s = self.iri(cls)
        made = [F.struct(F.lit("rdf:type").alias("p"), F.lit(cls).alias("o"), F.lit("iri").alias("o_kind"))]
        made += [F.struct(F.lit(c).alias("p"), F.col(c).cast("string").alias("o"), F.lit("literal").alias("o_kind")) for c in m.data]
        made += [F.struct(F.lit(c).alias("p"), self.iri(to, (c,)).alias("o"), F.lit("iri").alias("o_kind")) for c, to in m.objects.items()]
        rows = table(self.spark, self.folder, m.table).select(s.alias("s"), F.explode(F.array(*made)).alias("t"))
        return rows.select("s", "t.*").where("o IS NOT NULL")
