import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import normal, uniform
from lodestone.operators import evaluation, falsify

NET = {"a": [], "b": [], "c": ["a", "b"], "d": ["c"], "e": ["d"]}
WRONG = {"c": [], "e": ["c"], "a": ["e"], "b": ["e"], "d": ["a"]}


@pytest.fixture(scope="module")
def rows(spark):
    key = F.col("id")
    out = spark.range(5000).select("id", normal(1, key).alias("a"), normal(3, key).alias("b"))
    out = out.withColumn("c", F.col("a") + F.col("b") + normal(5, key)).withColumn("d", F.col("c") + normal(7, key)).withColumn("e", F.col("d") + normal(9, key))
    return out.cache()


def test_true_graph_stands_and_wrong_one_falls(rows):
    own = falsify.falsify(rows, NET)
    assert own.violations == 0 and own.judged == 120 and own.p <= 2 / 120 and not own.falsified
    other = falsify.falsify(rows, WRONG)
    assert other.violations > 0 and other.falsified and other.p > own.p
    drawn = falsify.falsify(rows, NET, most=50, seed=3)
    assert drawn.judged == 50 and drawn.p <= 0.1


def test_counts_agree_with_spark_tests(spark, monkeypatch):
    key = F.col("id")
    df = spark.range(4000).select((uniform(1, key) < 0.5).cast("string").alias("a"), F.floor(uniform(3, key) * 3).cast("string").alias("b"), key)
    df = df.withColumn("c", F.concat("a", F.when(uniform(5, key) < 0.7, F.col("b")).otherwise("0"))).withColumn("d", F.when(uniform(7, key) < 0.8, F.col("c")).otherwise("x")).drop("id")
    network = {"a": [], "b": [], "c": ["a", "b"], "d": ["c"]}
    columns = sorted(network)
    test = falsify.count_tests(df, columns)
    for x, y, given in [*evaluation.claimed_independences(network), ("a", "c", []), ("b", "d", ["a"])]:
        assert abs(test(x, y, tuple(given)) - evaluation.g_test(df, x, y, given)[2]) < 1e-6
    monkeypatch.setattr(falsify, "MOST_CONFIGURATIONS", 1)
    wide = falsify.count_tests(df, columns)
    assert abs(wide("a", "d", ("c",)) - test("a", "d", ("c",))) < 1e-6
    monkeypatch.undo()
    assert not falsify.falsify(df, network, "counts", alpha=0.1).falsified


def test_features_see_what_correlations_do_not(spark):
    key = F.col("id")
    df = spark.range(4000).select(normal(1, key).alias("x"), normal(5, key).alias("u"), key)
    df = df.withColumn("y", F.col("x") * F.col("x") + 0.3 * normal(3, key)).withColumn("z", F.cos(F.col("y")) + 0.3 * normal(7, key)).drop("id")
    columns = ["u", "x", "y", "z"]
    linear, smooth = falsify.linear_tests(df, columns), falsify.feature_tests(df, columns)
    assert linear("x", "y", ()) > 1e-3 and smooth("x", "y", ()) < 1e-10
    assert smooth("u", "x", ()) > 0.01 and smooth("u", "y", ("x",)) > 0.01
    assert smooth("x", "z", ()) < 1e-6 < smooth("x", "z", ("y",))


def test_uniform_p_values(spark):
    """Independent columns: p-values of random features are spread evenly enough."""
    df = spark.range(1500).select(*[normal(2 * i + 1, F.col("id")).alias(f"v{i}") for i in range(10)])
    test = falsify.feature_tests(df, [f"v{i}" for i in range(10)])
    ps = np.array([test(f"v{i}", f"v{j}", ()) for i in range(10) for j in range(i)])
    assert 0.3 < ps.mean() < 0.7 and (ps < 0.05).mean() < 0.2


def test_odd_tables(spark, rows):
    with pytest.raises(ValueError, match="kind"):
        falsify.falsify(rows, NET, "guess")
    full = falsify.falsify(rows, {"a": [], "b": ["a"]})
    assert full.claims == 0 and full.p == 1.0
    empty = falsify.falsify(rows.limit(0), NET, "features")
    assert empty.violations == 0


def test_worlds_as_triples(spark):
    from lodestone.operators import mixed_model, worlds

    shape = worlds.WORLD
    one = ("e1", "m", {"x": "1"}, {"x": "0", "y": "0"}, {"x": "1", "y": "1"}, {"y": 0.75}, "gumbel-max")
    made = spark.createDataFrame([one, one, (None, "m", {"x": "1"}, {"y": "0"}, {"y": "1"}, None, None), (None, "m", {"x": "1"}, {"y": "2"}, {"y": "1"}, None, None), ("e1", "n", {"x": "1"}, None, {"gone": "1"}, None, None)], shape)
    ids = [r.world for r in worlds.world_ids(made).collect()]
    assert ids[0] == ids[1] and len(set(ids)) == 4
    t = worlds.world_triples(made, nodes=["x", "y"])
    kinds = {r.o.rsplit(":", 1)[1]: r["count"] for r in t.where("p = 'rdf:type'").groupBy("o").count().collect()}
    assert kinds == {"CounterfactualQuery": 4, "Act": 2, "CounterfactualEstimate": 3}
    assert t.where("p LIKE '%aboutEntity'").count() == 2 and t.where("p LIKE '%probability'").first().o == "0.75" and t.where("o IS NULL").count() == 0
    again = t.unionByName(worlds.world_triples(made.limit(2), nodes=["x", "y"])).distinct()
    assert again.count() == t.count()

    key = F.col("id")
    rows = spark.range(300).select("id", (uniform(1, key) < 0.5).cast("string").alias("x"))
    rows = rows.withColumn("y", F.when(uniform(3, key) < 0.9, F.col("x")).otherwise("other"))
    network = {"x": [], "y": ["x"]}
    model = mixed_model.fit(rows, network, dict.fromkeys(network, "category"))
    drawn = mixed_model.counterfactual(rows.limit(20), model, {"x": "true"}, draws=9)
    found = worlds.worlds_of(drawn, ["x", "y"], {"x": "true"}, worlds.model_id(model, "f")).collect()
    assert len(found) == 20 and all(r.predicted["x"] == "true" and r.entity is None and 0 < r.probability["y"] <= 1 for r in found)
    facts = worlds.model_triples(spark, model, "f", 300)
    assert facts.where("p LIKE '%coupling'").count() == 2 and facts.where("p LIKE '%parent'").count() == 1
    assert [tuple(r)[:4] for r in worlds.mechanism_rows(spark, model).collect()] == [("x", "category", "", "Table"), ("y", "category", "x", "Table")]
