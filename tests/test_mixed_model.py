import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import normal, uniform
from lodestone.operators import discovery, ladder, mixed_model
from lodestone.operators.counterfactual import numbered

NET = {"x": [], "y": ["x"]}
NUMBERS = {"x": "number", "y": "number"}


@pytest.fixture(scope="module")
def line(spark):
    """x normal, y = 2 x + 1 + normal: correlated by 2 / sqrt(5)."""
    rows = spark.range(20_000).select("id", normal(1, F.col("id")).alias("x"), normal(3, F.col("id")).alias("e"))
    return rows.withColumn("y", 2 * F.col("x") + 1 + F.col("e")).cache()


@pytest.fixture(scope="module")
def line_model(line):
    return mixed_model.fit(line, NET, NUMBERS)


def test_noise_is_density_and_quantiles(line_model):
    noise = line_model.mechanisms["y"].noise
    assert abs(sum(noise.density) * noise.step - 1) < 1e-3 and abs(noise.quantiles[256]) < 0.03 and noise.quantiles[5] < -2
    at = np.interp(0.0, noise.low + noise.step * np.arange(len(noise.density)), noise.density)
    assert abs(at - 1 / math.sqrt(2 * math.pi)) < 0.02


def test_numeric_evidence_weights_draws(spark, line_model):
    """Given y = 3, x is normal with mean 2/5 (3 - 1) and variance 1/5; by weights and by matching."""
    for backend in ("auto", "rejection"):
        got = ladder.condition(spark, line_model, ["x"], {"y": 3.0}, backend=backend, n=40_000)["x"]
        assert abs(got.mean - 0.8) < 0.05 and abs(got.sd - math.sqrt(0.2)) < 0.05 and not got.low_confidence
        assert got.backend == ("likelihood-weighting" if backend == "auto" else "rejection")
    far = ladder.condition(spark, line_model, ["x"], {"y": 12.0}, n=20_000)["x"]
    assert far.low_confidence
    with pytest.raises(ValueError, match="no weight"):
        ladder.condition(spark, line_model, ["x"], {"y": 1e6})


def test_mechanism_answers_first(spark, line_model):
    got = ladder.condition(spark, line_model, "y", {"x": 2.0})["y"]
    assert got.backend == "mechanism" and abs(got.mean - 5) < 0.05 and abs(got.sd - 1) < 0.05
    for wrong in ({"targets": ["x"], "evidence": {"x": 1.0}}, {"targets": ["x"], "evidence": {}, "backend": "guess"}, {"targets": ["x"], "evidence": {"y": 1.0}, "backend": "mechanism"}):
        with pytest.raises(ValueError):
            ladder.condition(spark, line_model, **wrong)
    with pytest.raises(KeyError):
        ladder.condition(spark, line_model, "z", {})


def test_wide_networks_are_sampled(spark):
    """A hidden cause of 12 flags makes a table of 2^12 cells when it goes first: too many for a limit of 1,000, but not for 10^6."""
    key = F.col("id")
    rows = spark.range(3000).select("id", (uniform(1, key) < 0.5).cast("string").alias("c"))
    flags = [f"f{i:02d}" for i in range(12)]
    rows = rows.select("*", *[(uniform(3 + 2 * i, key) < F.when(F.col("c") == "true", 0.8).otherwise(0.3)).cast("string").alias(f) for i, f in enumerate(flags)])
    network = {"c": []} | {f: ["c"] for f in flags} | {"all": flags[:3]}
    rows = rows.withColumn("all", F.concat_ws("", *flags[:3]))
    model = mixed_model.fit(rows, network, dict.fromkeys(network, "category"))
    evidence = {f: "true" for f in flags[6:]}
    assert ladder.elimination_cells(network, {n: len(v) for n, v in model.levels.items()}, {"all"}, set(evidence)) >= 64
    exact = ladder.condition(spark, model, "f00", evidence)["f00"]
    drawn = ladder.condition(spark, model, "f00", evidence, most_cells=1, n=30_000)["f00"]
    assert (exact.backend, drawn.backend) == ("elimination", "likelihood-weighting")
    assert abs(exact.probabilities["true"] - drawn.probabilities["true"]) < 0.03
    both = ladder.condition(spark, model, ["f00", "f01"], evidence, most_cells=1)
    assert both["f00"].ess == both["f01"].ess


def test_softmax_with_numbers_and_abduction(spark):
    """Shares of a category whose log-odds are linear in a number and a flag; abduction gives each row's level back, and worlds move as the shares do."""
    key = F.col("id")
    rows = spark.range(12_000).select("id", normal(1, key).alias("x"), F.when(uniform(5, key) < 0.4, "s").otherwise("t").alias("f"))
    odds = 1.5 * F.col("x") + F.when(F.col("f") == "s", 1.0).otherwise(0.0)
    rows = rows.withColumn("y", F.when(uniform(7, key) < 1 / (1 + F.exp(-odds)), "yes").otherwise("no"))
    network, kinds = {"x": [], "f": [], "y": ["x", "f"]}, {"x": "number", "f": "category", "y": "category"}
    model = mixed_model.fit(rows, network, kinds)
    m = model.mechanisms["y"]
    w = np.array(m.weights[m.levels.index("yes")]) - np.array(m.weights[m.levels.index("no")])
    assert abs(w[0] - 1.5) < 0.12 and abs(w[1] + 1.0) < 0.15
    again = mixed_model.abducted_levels(rows, model, "y", ["id"])
    assert again.where("again = y").count() == 12_000
    worlds = mixed_model.counterfactual(rows, model, {"x": 2.0}, draws=3)
    moved = worlds.groupBy("f").agg(F.avg((F.col("cf_y") == "yes").cast("double")).alias("p")).collect()
    assert all(abs(r.p - 1 / (1 + math.exp(-3.0 - (r.f == "s")))) < 0.02 for r in moved)
    assert worlds.where("y = 'yes' AND x < 2 AND cf_y = 'no'").count() == 0  # what raises its odds never takes a yes away
    same = mixed_model.counterfactual(rows.limit(200), model, {}, draws=2)
    assert same.where("cf_y != y OR cf_x != x").count() == 0
    null = mixed_model.probabilities(spark.createDataFrame([(None, "s"), (1.0, "unseen")], "x double, f string"), model, "y").collect()
    assert null[0].p_yes is None and 0 < null[1].p_yes < 1


def test_ordered_levels(spark):
    """Trees explain steps that a line does not, also in rows that they were not fitted on; answers are levels again."""
    key = F.col("id")
    rows = spark.range(6000).select("id", (uniform(1, key) * 50).alias("x"))
    rows = rows.withColumn("y", F.when(F.col("x") < 10, "level 2").when(F.col("x") < 25, "level 10").when(F.col("x") < 40, "level 1").otherwise("level 10"))
    fitted, rest = rows.where("id % 3 > 0"), rows.where("id % 3 = 0")
    kinds = {"x": "number", "y": "ordered"}
    model = mixed_model.fit(fitted, NET, kinds)
    assert model.levels["y"] == ["level 1", "level 2", "level 10"]
    codes = model.encoded(rest)
    told = model.mechanisms["y"].with_mean(codes, F.col, "m")
    off, spread = told.agg(F.avg((F.col("m") - F.col("y")) ** 2), F.var_pop("y")).first()
    _, _, g = discovery.gram(codes, ["x", "y"])
    assert 1 - off / spread > 0.9 > g[0, 1] ** 2 / (g[0, 0] * g[1, 1])
    moved = mixed_model.counterfactual(rest, model, {"x": 30.0})
    assert {r.cf_y for r in moved.select("cf_y").distinct().collect()} <= set(model.levels["y"]) and moved.where("cf_y = 'level 1'").count() > 0.95 * moved.count()
    got = ladder.condition(spark, model, "y", {"x": 5.0})["y"]
    assert got.backend == "mechanism" and max(got.probabilities, key=got.probabilities.get) == "level 2"
    with pytest.raises(KeyError):
        model.encode("y", "level 3")


def test_rows_are_numbered_alike_in_any_order(spark):
    rows = spark.createDataFrame([("a", "1")] * 2500 + [("b", None)] * 3, "k string, v string")
    one, two = (numbered(r, ["k", "v"]).collect() for r in (rows, rows.repartition(7).orderBy("v")))
    assert len(one) == 2503 == len({r.id for r in one}) and sorted(map(str, one)) == sorted(map(str, two))


def test_kernel_means_of_no_rows(spark):
    rows = spark.createDataFrame([(1.0, None), (None, 2.0), (-3.0, 5.0)], "x double, y double")
    asked = spark.createDataFrame([(1, 1.0), (2, -3.0), (3, None)], "question int, x double")
    assert [tuple(r) for r in ladder.kernel_means(rows, asked, "y", {"x": 0.1}).collect()] == [(2, 5.0, 1.0)]


def test_count_losses(spark, monkeypatch):
    """Value and gradient as by numpy, on the driver and in Spark; a finite difference agrees; other values are refused."""
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (300, 3)).astype(float)
    w = rng.normal(size=(3, 3)) * 0.2
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    m = x @ w
    value = float((np.exp(m) - x * m).sum() / 300)
    for most in (200_000, 1):
        monkeypatch.setattr(discovery, "MOST_CONFIGURATIONS", most)
        loss = discovery.count_loss(df, list("abc"), "poisson")
        got, grad = loss(w)
        assert abs(got - value) < 1e-9
        step = np.zeros((3, 3))
        step[0, 1] = 1e-6
        assert abs((loss(w + step)[0] - got) / 1e-6 - grad[0, 1]) < 1e-4
    with pytest.raises(ValueError, match="other values"):
        discovery.count_loss(df, list("abc"), "logistic")
    with pytest.raises(ValueError):
        discovery.notears(df, list("abc"), loss="cubic")


def test_given_mechanisms(spark, line, tmp_path):
    """y = 2 x + 1 + e with the mean 2 x given: what is beyond has mean 1 and sd 1, moves with its row, and is stored with the expression."""
    from lodestone.sources.models import load_model, save_model

    model = mixed_model.fit(line, NET, NUMBERS, given={"y": "2 * {x}"})
    m = model.mechanisms["y"]
    assert abs(m.shift - 1) < 0.03 and abs(m.explained - 0.8) < 0.02
    got = ladder.condition(spark, model, "y", {"x": 2.0})["y"]
    assert got.backend == "mechanism" and abs(got.mean - 5) < 0.05 and abs(got.sd - 1) < 0.05
    drawn = mixed_model.sample(spark, model, 20_000, do={"x": 3.0}).agg(F.avg("y"), F.stddev("y")).first()
    assert abs(drawn[0] - 7) < 0.05 and abs(drawn[1] - 1) < 0.05
    moved = mixed_model.counterfactual(line, model, {"x": -1.0}).where(F.abs(F.col("cf_y") - (F.col("e") - 1)) > 1e-9)
    assert moved.count() == 0
    save_model(model, f"{tmp_path}/m", line)
    assert load_model(spark, f"{tmp_path}/m", line).mechanisms["y"] == m
    square = mixed_model.fit(line.withColumn("y", F.col("x") * F.col("x")), NET, NUMBERS, given={"y": "{x} * {x}"})
    assert abs(square.mechanisms["y"].explained - 1) < 1e-9
    null = mixed_model.fit(line, NET, NUMBERS, given={"y": "CASE WHEN {x} > 0 THEN 2 * {x} END"})
    assert abs(null.mechanisms["y"].shift - 1) < 0.05
    for wrong in ({"y": "{z}"}, {"x": "{y}"}, {"w": "1"}):
        with pytest.raises(ValueError, match="no mean"):
            mixed_model.fit(line, NET, NUMBERS, given=wrong)


def test_trees_are_fitted_on_counts_of_equal_rows(spark, monkeypatch):
    """Trees see each distinct row once, with its count; predictions, noise and what is explained are those of all rows."""
    from pyspark.sql import functions as F

    sizes, fitted = [], mixed_model.GBTRegressor.fit
    monkeypatch.setattr(mixed_model.GBTRegressor, "fit", lambda self, table: (sizes.append(table.count()), fitted(self, table))[1])
    rows = spark.range(4000).select((F.col("id") % 10).cast("double").alias("x"), F.when(F.col("id") % 10 < 3, "1").when(F.col("id") % 100 == 99, "3").otherwise("2").alias("y"))
    steps = mixed_model.fit(rows, {"x": [], "y": ["x"]}, {"x": "number", "y": "ordered"}).mechanisms["y"]
    assert sizes == [11]
    assert dict(zip(range(int(steps.noise.low), 9), steps.noise.density, strict=False)) == {0: 0.99, 1: 0.01}
    assert steps.noise.quantiles[0] == 0 and steps.noise.quantiles[-1] == 1 and steps.noise.quantiles.count(1.0) == 6
    left = sum(n * (y - m) ** 2 for y, m, n in ((1, 1.1, 360), (2, 1.1, 40)))
    assert abs(steps.explained - (1 - left / sum(n * (y - 0.71) ** 2 for y, n in ((0, 1200), (1, 2760), (2, 40))))) < 1e-3


@pytest.mark.parametrize("penalty", [0.0, 1e-2])
def test_softmax_takes_few_passes_to_the_weights_of_another_solver(spark, monkeypatch, penalty):
    """Newton's steps end after some ten passes over the rows, at the optimum that Spark ML's L-BFGS ends at."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import DataFrame

    rows = spark.range(3000).select(*[normal(s, F.col("id")).alias(x) for s, x in ((1, "a"), (5, "b"))], F.lit(7.0).alias("c"), uniform(9, F.col("id")).alias("u"))
    rows = rows.select("a", (100 * F.col("b") + 1000).alias("b"), "c", F.when(F.col("u") < 1 / (1 + F.exp(-F.col("a"))), 0.0).when(F.col("b") > 0.3, 1.0).otherwise(2.0).alias("_y")).withColumn("_n", F.lit(1.0)).cache()
    passes, mapped = [], DataFrame.mapInArrow
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "mapInArrow", lambda self, *a, **b: (passes.append(1), mapped(self, *a, **b))[1])
        intercepts, weights = mixed_model.softmax_weights(rows, ["a", "b", "c"], 3, penalty)
    assert len(passes) <= 15
    table = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(rows)
    other = LogisticRegression(featuresCol="x", labelCol="_y", family="multinomial", regParam=penalty, maxIter=500, tol=1e-12).fit(table)
    assert np.allclose(weights, other.coefficientMatrix.toArray(), atol=1e-4) and np.allclose(intercepts, np.array(other.interceptVector), rtol=1e-3, atol=1e-3)
