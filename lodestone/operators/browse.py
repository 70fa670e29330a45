"""Looking at a flat join: entities by name and by class, the state of one unit, comparisons and summaries of small reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.answers import rows_of
from lodestone.operators.profile import long_form

#: Where the names of RDF, RDFS, OWL and of the mapping languages begin.
VOCABULARIES = ("http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/ns/r2rml#", "http://semweb.mmlab.be/ns/rml#", "http://semweb.mmlab.be/ns/ql#")


def is_vocabulary(iri: Column) -> Column:
    """Whether a name belongs to the vocabularies that describe data, rather than to the data; null of null."""
    return reduce(lambda a, b: a | b, [iri.startswith(v) for v in VOCABULARIES])


def of_classes(triples: DataFrame, classes: list[str], type_predicates: tuple[str, ...]) -> DataFrame:
    """The triples whose subject is of one of the classes, each once for each time that it is given."""
    typed = triples.where(F.col("p").isin(*type_predicates) & F.col("o").isin(*classes)).select("s").distinct()
    return triples.join(typed, "s", "left_semi")


def entities(flat: DataFrame, entity_columns: list[str]) -> DataFrame:
    """class (the column) and entity, each pair once; nulls are no entities."""
    pairs = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"`{c}`").cast("string").alias("entity")) for c in entity_columns])
    return flat.select(F.explode(pairs).alias("e")).select("e.*").where("entity IS NOT NULL").distinct()


def entity_search(flat: DataFrame, entity_columns: list[str], part: str) -> DataFrame:
    """class and entity of the entities whose name holds the text, upper and lower case alike; the empty text fits all."""
    return entities(flat, entity_columns).where(F.lower("entity").contains(part.lower()))


def entities_per_class(flat: DataFrame, entity_columns: list[str], most: int = 20) -> DataFrame:
    """class, n (all its entities) and the first `most` of them by name. The rank filter is taken in each partition before the shuffle, so no task holds a whole class."""
    seen = entities(flat, entity_columns)
    first = seen.withColumn("_rank", F.row_number().over(Window.partitionBy("class").orderBy("entity"))).where(F.col("_rank") <= most)
    named = first.groupBy("class").agg(F.sort_array(F.collect_list("entity")).alias("entities"))
    return seen.groupBy("class").agg(F.count("*").alias("n")).join(named, "class")


def factual_state(flat: DataFrame, entity_columns: list[str], entity: str, columns: list[str], categorical: list[str]) -> DataFrame:
    """node, level (the mode, of ties the least; null of numeric nodes) and mean (null of categorical ones) over the rows of the entity; KeyError if it has none."""
    rows = rows_of(flat, entity_columns, entity)
    one = rows.agg(*[(F.mode(F.col(f"`{c}`"), True).cast("string") if c in categorical else F.avg(F.col(f"`{c}`").cast("double"))).alias(f"v{i}") for i, c in enumerate(columns)])
    none = {"level": F.lit(None).cast("string"), "mean": F.lit(None).cast("double")}
    return long_form(one, {c: none | {"level" if c in categorical else "mean": F.col(f"v{i}")} for i, c in enumerate(columns)}).withColumnRenamed("column", "node")


def in_order(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns named, in that order; those that df lacks are null."""
    return df.select(*[F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def preview(df: DataFrame, rows: int = 20) -> DataFrame:
    """Some rows, at most as many as given; which ones is not defined."""
    return df.limit(rows)


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_left and only_right: how many rows, repeats counted, one frame has more than the other; both 0 if and only if
    the frames hold the same rows. Columns are matched by name; ValueError if the names differ. One shuffle."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    names = list(a.columns)
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    more = both.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.sum("_side").alias("_more"))
    return more.agg(*[F.coalesce(F.sum(F.greatest(sign * F.col("_more"), F.lit(0))), F.lit(0)).alias(name) for name, sign in (("only_left", 1), ("only_right", -1))])


def zero_filled(distribution: DataFrame, levels: list[str]) -> DataFrame:
    """level, p and place: the declared levels in their order, 0 where the distribution has none; levels that are not declared follow by name."""
    declared = distribution.sparkSession.createDataFrame([(v, i) for i, v in enumerate(dict.fromkeys(levels))], "level string, place int")
    both = distribution.select("level", "p").join(declared, "level", "full_outer")
    # undeclared levels are numbered by how many undeclared ones stand before them: as few as a column has levels
    rest = F.row_number().over(Window.partitionBy(F.col("place").isNull()).orderBy("level")) - 1 + len(set(levels))
    return both.select("level", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("place", rest).alias("place"))


def component_summary(nodes: DataFrame) -> DataFrame:
    """component, n_classes, n_nodes and n_retained from one row for each node: component, class, retained."""
    return nodes.groupBy("component").agg(F.count_distinct("class").alias("n_classes"), F.count("*").alias("n_nodes"), F.count_if("retained").alias("n_retained"))


def evaluation_summary(report: DataFrame) -> DataFrame:
    """nodes, failing (those that don't beat their baseline), mean_lift and worst_node (the least lift, of ties the first by name) from node, lift and beats_baseline."""
    return report.agg(F.count("*").alias("nodes"), F.count_if(~F.col("beats_baseline")).alias("failing"), F.avg("lift").alias("mean_lift"), F.min_by("node", F.struct("lift", "node")).alias("worst_node"))


def short_number(x: Column) -> Column:
    """A number as a short text: whole numbers without a point, others with at most three decimals and no zeros at the end."""
    fixed = F.regexp_replace(F.format_string("%.3f", x.cast("double")), r"\.?0+$", "")
    return F.when(x.isNotNull(), F.when(fixed == "-0", "0").otherwise(fixed))
