import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import normal, uniform
from lodestone.operators import ladder, mixed_model
from lodestone.plans.flat_join import CLASS, flat_join, value_variables
from lodestone.plans.schema import Schema, inferred_schema
from lodestone.project import Project
from lodestone.sources import lists, models
from lodestone.sources.ntriples import TripleSource

FACT = "s string, p string, o string, o_kind string"


def chain(name, n, end="rdf:nil"):
    return [x for i in range(n) for x in ((f"{name}{i}", "rdf:first", f"item{i}"), (f"{name}{i}", "rdf:rest", f"{name}{i + 1}" if i + 1 < n else end))]


def test_lists_in_order(spark):
    rows = chain("a", 1000) + chain("b", 1) + chain("c", 7, "http://www.w3.org/1999/02/22-rdf-syntax-ns#nil") + [("a0", "rdf:first", "item0"), ("x", "label", "y")]
    got = lists.list_items(spark.createDataFrame(rows, "s string, p string, o string")).collect()
    assert sorted((r.head, r.place, r.item) for r in got) == sorted([("a0", i, f"item{i}") for i in range(1000)] + [("b0", 0, "item0")] + [("c0", i, f"item{i}") for i in range(7)])
    assert lists.list_items(spark.createDataFrame([], "s string, p string, o string")).count() == 0


@pytest.mark.parametrize(
    ("rows", "message"),
    [
        (chain("a", 5, "a2"), "of several cells"),
        (chain("a", 6, "a0"), "circle"),
        (chain("a", 3, "gone"), "no cell"),
        ([*chain("a", 3), ("a1", "rdf:first", "other")], "one item"),
        (chain("a", 3)[:-1], "one item"),
    ],
)
def test_chains_that_are_no_lists(spark, rows, message):
    with pytest.raises(lists.BrokenList, match=message):
        lists.list_items(spark.createDataFrame(rows, "s string, p string, o string"))


def test_fingerprints_are_of_multisets(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") > 3, F.lit("x")).alias("t"))
    mark = models.fingerprint(df)
    assert mark == models.fingerprint(df.repartition(5).orderBy(F.desc("id")).select("t", "id", "k"))
    changed = [df.withColumn("t", F.when(F.col("id") == 500, "y").otherwise(F.col("t"))), df.union(df.limit(1)), df.withColumn("k", F.col("k").cast("int")), df.withColumnRenamed("k", "l"), df.select("id", "k", F.coalesce("t", F.lit("")).alias("t"))]
    assert len({mark, *(models.fingerprint(c) for c in changed)}) == 6
    assert models.fingerprint(df.limit(0)) == models.fingerprint(df.where("id < 0"))


def test_models_are_stored(spark, tmp_path):
    key = F.col("id")
    rows = spark.range(2000).select("id", normal(1, key).alias("x"), F.when(uniform(5, key) < 0.5, "s").otherwise("t").alias("f"))
    rows = rows.withColumn("y", F.when(F.col("x") + normal(9, key) > 0, "yes").otherwise("no")).withColumn("z", F.col("x") * 2 + normal(11, key)).withColumn("o", F.floor(F.abs("x")).cast("string"))
    network = {"x": [], "f": [], "y": ["x"], "z": ["x", "f"], "o": ["x"], "g": ["f"]}
    rows = rows.withColumn("g", F.upper("f"))
    model = mixed_model.fit(rows, network, {"x": "number", "f": "category", "y": "category", "z": "number", "o": "ordered", "g": "category"})
    models.save_model(model, str(tmp_path / "m"), rows)
    again = models.load_model(spark, str(tmp_path / "m"), rows.repartition(3))
    for target, given in (("y", {"x": 0.5}), ("z", {"x": 1.0, "f": "s"}), ("o", {"x": 1.5}), ("g", {"f": "t"})):
        assert ladder.condition(spark, again, target, given) == ladder.condition(spark, model, target, given)
    with pytest.raises(ValueError, match="not the one"):
        models.load_model(spark, str(tmp_path / "m"), rows.limit(1999))


def facts(spark):
    """Patients with a stage, modelled as a class without data properties, and a ward, which has names."""
    rows = []
    for i in range(6):
        rows += [(f"p{i}", "rdf:type", "Patient", "iri"), (f"p{i}", "age", str(40 + i), "literal"), (f"p{i}", "stage", f"s{i % 2}", "iri"), (f"p{i}", "ward", f"w{i % 3}", "iri")]
    rows += [(f"s{i}", "rdf:type", c, "iri") for i in range(2) for c in ("Stage", "Level")]
    rows += [("w0", "rdf:type", "Ward", "iri"), ("w1", "rdf:type", "Ward", "iri"), ("w2", "rdf:type", "Ward", "iri"), ("w0", "name", "north", "literal"), ("w0", "name", "N", "literal"), ("w1", "name", "south", "literal")]
    return spark.createDataFrame(rows, FACT).cache()


def test_values_of_related_entities(spark):
    triples = facts(spark)
    schema, source = inferred_schema(triples.where("o <> 'Level'")), TripleSource(triples)
    schema.classes.add("Level")
    nodes = {n.prop: n for n in schema.nodes()}
    show = lambda prop, value, **how: flat_join(schema, source, [nodes["age"], nodes[prop]], [], values={nodes[prop].name: value}, **how)
    named = show("ward", "name")
    assert sorted((r[1], r[2]) for r in named.df.collect()) == [("40", "N"), ("40", "north"), ("41", "south"), ("43", "N"), ("43", "north"), ("44", "south")] and not named.warnings
    assert named.entities == ["Patient__iri"]
    assert {(r[1], r[2]) for r in show("ward", "name", optional=True).df.collect()} >= {("42", None), ("45", None)}
    assert sorted({r[2] for r in show("stage", CLASS).df.collect()}) == ["Level", "Stage"]
    fallen = show("stage", "name")
    assert fallen.warnings and {r[2] for r in fallen.df.collect()} == {"Level", "Stage"}
    assert sorted({r[2] for r in flat_join(schema, source, [nodes["age"], nodes["stage"]], []).df.collect()}) == ["s0", "s1"]


def test_values_modelled_as_classes_become_variables(spark):
    triples = facts(spark).where("o <> 'Level'")
    p = Project(inferred_schema(triples), TripleSource(triples))
    assert p.seed_roles() == ["Patient__stage"] and p.roles == {"stage": "variable"}
    assert {r[0] for r in p.join().df.select("Patient__stage").distinct().collect()} == {"s0", "s1"}
    linked = Schema({"A", "B", "V", "W"})
    linked.data["x"], linked.data["y"] = [("A", "int")], [("B", "int")]
    linked.objects["a"], linked.objects["b"], linked.objects["w"] = [("A", "V")], [("B", "V")], [("A", "W")]
    assert [n.prop for n in value_variables(linked)] == ["w"]  # V is all that links A with B


def test_only_small_sides_are_broadcast(spark):
    from lodestone.storage import broadcast_if_small

    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    df = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"), F.array(F.lit(None).cast("int")).alias("a"))
    assert hinted(broadcast_if_small(df)) and hinted(broadcast_if_small(df.limit(0)))
    assert not hinted(broadcast_if_small(df, most=99)) and not hinted(broadcast_if_small(df, most_bytes=50_000))
