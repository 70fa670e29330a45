import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import local_name, natural_key, normal, slug, uniform
from lodestone.operators import counterfactual as cf
from lodestone.operators import cpt, discovery, encode, inference, ledger, mechanisms, profile, ranks, weighted
from lodestone.streaming.counts import current_counts, maintain_counts

NET = {"a": [], "b": ["a"], "c": ["a", "b"]}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2, 3000)
    b = (rng.random(3000) < np.where(a, 0.8, 0.3)).astype(int)
    c = (rng.random(3000) < 0.1 + 0.4 * a + 0.4 * b).astype(int)
    return spark.createDataFrame([(f"a{x}", f"b{y}", f"c{z}") for x, y, z in zip(a, b, c, strict=True)], "a string, b string, c string").cache()


@pytest.fixture(scope="module")
def linear(spark):
    """x causes y causes z, noise uniform."""
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, 4000)
    y = 1.5 * x + rng.uniform(-1, 1, 4000)
    z = -1.2 * y + rng.uniform(-1, 1, 4000)
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(x, y, z, strict=True)], "x double, y double, z double").cache()


def test_scalars(spark):
    row = spark.createDataFrame([("http://x/a#b/c", "item 10", "a b!c")], "i string, k string, t string").select(local_name(F.col("i")), natural_key(F.col("k")), slug(F.col("t"))).first()
    assert tuple(row) == ("c", "item " + "10".zfill(20), "a_b_c")


def test_hash_numbers_do_not_depend_on_partitions(spark):
    a = spark.range(1000).repartition(7).select("id", uniform(3, F.col("id")).alias("u"), normal(3, F.col("id")).alias("z"))
    b = spark.range(1000).coalesce(1).select("id", uniform(3, F.col("id")).alias("u"), normal(3, F.col("id")).alias("z"))
    x, y = a.orderBy("id").toPandas(), b.orderBy("id").toPandas()
    assert (x == y).all().all() and abs(x.u.mean() - 0.5) < 0.03 and abs(x.z.std() - 1) < 0.08


def test_encodings(spark):
    df = spark.createDataFrame([(i, float(i % 7), None if i == 3 else "ab"[i % 2], 5) for i in range(40)], "id int, v double, s string, k int")
    assert "k" not in profile.drop_constant(df).columns
    kinds = {r.column: r.kind for r in profile.inferred_types(df, max_levels=8).collect()}
    assert kinds == {"id": "discrete", "v": "categorical", "s": "categorical", "k": "categorical"}
    codes = {r.s: r.code for r in encode.coded(df, "s", "code", null_code=-1).collect()}
    assert codes == {"a": 0, "b": 1, None: -1}
    ranks = encode.quantile_binned(df, ["v"], 10).agg(F.min("v"), F.max("v")).first()
    assert tuple(ranks) == (1.0, 7.0)
    bins = encode.quantile_binned(df, ["id"], 4).groupBy("id").count().orderBy("id").collect()
    assert [r["count"] for r in bins] == [10] * 4
    assert encode.width_binned(df, ["id"], 4).select("id").distinct().count() == 4
    weights = encode.row_weights(df, "v").groupBy("v").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 1) < 1e-12 for r in weights)


def test_weighted_summaries(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(size=2000), rng.random(2000)
    df = spark.createDataFrame(list(zip(map(float, x), map(float, w), strict=True)), "x double, w double")
    m = weighted.moments(df, "x", "w").first()
    mean = np.average(x, weights=w)
    assert np.isclose(m.mean, mean) and np.isclose(m.sd, np.sqrt(np.average((x - mean) ** 2, weights=w))) and np.isclose(m.ess, w.sum() ** 2 / (w**2).sum())
    low, high = weighted.interval(df, "x", "w").first()
    order = np.argsort(x)
    expected = np.interp([0.025, 0.975], np.cumsum(w[order]) / w.sum(), x[order])
    assert np.allclose([low, high], expected)
    d = weighted.density(df, "x", "w").orderBy("at").toPandas()
    assert len(d) == 64 and abs(np.trapezoid(d.density, d["at"]) - 1) < 0.05
    assert weighted.density(df.withColumn("x", F.lit(2.0)), "x", "w").count() == 1


def brute(data, target, evidence=None, do=None):
    """By the full joint table, in pandas."""
    p = data.toPandas()
    tables = {n: p.groupby([*ps, n]).size() / (p.groupby(ps).size() if ps else len(p)) for n, ps in NET.items()}
    out = {}
    for a in ("a0", "a1"):
        for b in ("b0", "b1"):
            for c in ("c0", "c1"):
                row = {"a": a, "b": b, "c": c}
                if any(row[k] != v for k, v in {**(evidence or {}), **(do or {})}.items()):
                    continue
                w = 1.0
                for n, ps in NET.items():
                    if n not in (do or {}):
                        key = tuple(row[k] for k in [*ps, n])
                        w *= tables[n][key if ps else row[n]]
                out[row[target]] = out.get(row[target], 0) + w
    s = sum(out.values())
    return {k: v / s for k, v in out.items()}


def as_dict(df, key):
    return {r[key]: r.p for r in df.collect()}


def test_exact_queries_match_the_joint(data):
    tables = inference.fit(data, NET)
    for got, wanted in (
        (inference.condition(tables, NET, "a", {"c": "c1"}), brute(data, "a", {"c": "c1"})),
        (inference.condition(tables, NET, "c", {"a": "a1", "b": "b0"}), brute(data, "c", {"a": "a1", "b": "b0"})),
        (inference.intervene(tables, NET, "c", {"b": "b1"}), brute(data, "c", do={"b": "b1"})),
        (inference.intervene(tables, NET, "a", {"b": "b1"}, {"c": "c1"}), brute(data, "a", {"c": "c1"}, {"b": "b1"})),
    ):
        found = as_dict(got, next(c for c in got.columns if c != "p"))
        assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
    total = sum(r.difference for r in inference.effect(tables, NET, "c", {"b": "b1"}, {"b": "b0"}).collect())
    assert abs(total) < 1e-12
    with pytest.raises(ValueError):
        inference.condition(tables, NET, "a", {"a": "a1"})
    with pytest.raises(KeyError):
        inference.condition(tables, NET, "a", {"q": "1"})


def test_sampling_agrees_with_exact(spark, data):
    tables = inference.fit(data, NET)
    drawn = inference.sample(spark, tables, NET, 20000, evidence={"c": "c1"})
    got, wanted = as_dict(inference.weighted_answer(drawn, "a"), "a"), brute(data, "a", {"c": "c1"})
    assert all(abs(got[k] - wanted[k]) < 0.02 for k in wanted)
    done = as_dict(inference.weighted_answer(inference.sample(spark, tables, NET, 20000, do={"b": "b1"}), "c"), "c")
    assert abs(done["c1"] - brute(data, "c", do={"b": "b1"})["c1"]) < 0.02
    with pytest.raises(ValueError, match="probability 0"):
        inference.weighted_answer(inference.sample(spark, tables, NET, 10, evidence={"c": "none"}), "a")


def test_counterfactual_worlds(data):
    tables = inference.fit(data, NET)
    rows = data.limit(200).withColumn("id", F.monotonically_increasing_id())
    same = cf.counterfactual(rows.withColumn("b", F.lit("b1")), tables, NET, {"b": "b1"}, draws=5)
    assert same.where("cf_c <> c OR cf_a <> a").count() == 0  # the world as it was
    moved = cf.answer(cf.counterfactual(data.withColumn("id", F.monotonically_increasing_id()), tables, NET, {"b": "b1"}, draws=5), "c")
    wanted = brute(data, "c", do={"b": "b1"})
    assert abs(as_dict(moved, "level")["c1"] - wanted["c1"]) < 0.03
    assert cf.agreement(same, "c", "c").first().rate == 1.0


def test_linear_counterfactual(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 5.0)], "x double, y double, z double")
    out = cf.linear_counterfactual(rows, {"x": {}, "y": {"x": 2.0}, "z": {"y": -1.0}}, {"x": 3.0}).first()
    assert (out.cf_x, out.cf_y, out.cf_z) == (3.0, 6.0, 1.0)
    drawn = inference.linear_gaussian_sample(spark, {"x": {}, "y": {"x": 2.0}}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 0.5}, 5000, do={"x": 3.0})
    assert abs(drawn.agg(F.avg("y")).first()[0] - 6.0) < 0.05


def test_linear_mechanisms_and_soft_interventions(spark, linear):
    net = {"x": [], "y": ["x"], "z": ["y"]}
    model = mechanisms.fit_linear(linear.withColumn("x", F.col("x") + 1e6).withColumn("y", F.col("y") + 1.5e6), net)  # large offsets keep their digits
    assert abs(model["y"].weights["x"] - 1.5) < 0.05 and abs(model["z"].weights["y"] + 1.2) < 0.05 and abs(model["y"].sd - 3**-0.5) < 0.02
    model = mechanisms.fit_linear(linear, net)
    row = spark.createDataFrame([(1, 1.0, 2.0, 5.0), (2, None, 1.0, 1.0)], "id int, x double, y double, z double")
    kept, empty = mechanisms.act(row, model, {"x": lambda v: v + 1}).orderBy("id").collect()
    assert np.isclose(kept.new_y, 2 + model["y"].weights["x"]) and np.isclose(kept.new_z, 5 + model["z"].weights["y"] * model["y"].weights["x"]) and empty.new_z is None
    assert mechanisms.act(row, model, {}).where("new_z <> z").isEmpty()  # nothing set, nothing moves
    drawn = mechanisms.act(linear.withColumn("id", F.monotonically_increasing_id()), model, {"x": 2.0}, "drawn", key=["id"]).agg(F.avg("new_y").alias("m"), F.stddev("new_y").alias("s")).first()
    assert abs(drawn.m - model["y"].intercept - 2 * model["y"].weights["x"]) < 0.05 and abs(drawn.s - model["y"].sd) < 0.05
    with pytest.raises(ValueError, match="tell rows apart"):
        mechanisms.act(row, model, {"x": 1.0}, "drawn")
    with pytest.raises(KeyError):
        mechanisms.act(row, model, {"q": 1.0})


def test_interventions_on_rows_and_boards(data):
    tables = inference.fit(data, NET)
    some = data.where("a = 'a1'")
    got = as_dict(inference.intervene_rows(some, tables, NET, "c", {"b": "b1"}), "c")
    assert abs(got["c1"] - brute(data, "c", {"a": "a1"}, {"b": "b1"})["c1"]) < 1e-9
    board = {(r.node, r.level): r.p for r in inference.answers_for(tables, NET, None, {"c": "c1"}).collect()}
    assert all(abs(board[n, v] - p) < 1e-9 for n in "ab" for v, p in brute(data, n, {"c": "c1"}).items()) and len(board) == 4
    with pytest.raises(ValueError, match="no rows"):
        inference.intervene_rows(data.limit(0), tables, NET, "c", {"b": "b1"})


def test_ranks_by_ranges(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=3000), 2)
    df = spark.createDataFrame([(None,), *[(float(v),) for v in x]], "x double")
    at = [0.0, 0.1, 1 / 3, 0.5, 0.99, 1.0]
    assert np.allclose(ranks.quantiles(df, "x", at), np.quantile(x, at)) and ranks.quantiles(df.limit(0), "x", at) == []
    by_value = df.dropna().distinct().withColumn("one", F.lit(1))
    got = {r.x: r.c for r in ranks.running(by_value, "x", "one").collect()}
    assert got == {v: i + 1 for i, v in enumerate(np.unique(x))}
    assert profile.level_counts(df, ["x"], 5)["x"] > 5 and profile.level_counts(df, ["x"], 5000)["x"] == len(np.unique(x))


def test_cpt_cross_validation(data):
    row = cpt.cross_validated(data, "c", ["a", "b"], F.pmod(F.xxhash64("a", "b", "c", F.monotonically_increasing_id()), F.lit(5)).cast("int")).first()
    assert 0.6 < row.accuracy <= 1 and row.accuracy > row.baseline


def test_score_search_finds_the_class(data):
    columns = ["a", "b", "c"]
    score = cpt.BicScores(data, columns)
    far = cpt.BicScores(data, columns, most=0)  # by Spark aggregates
    assert abs(score("c", frozenset("ab")) - far("c", frozenset("ab"))) < 1e-6
    assert abs(score("c", frozenset("a")) - cpt.bic_score(data, "c", ["a"]).first().score) < 1e-6
    found = discovery.ges(score, columns)
    assert (found | found.T).sum() == 6  # all linked
    dag = discovery.hill_climb(score, columns)
    assert (dag | dag.T).sum() == 6 and not (dag & dag.T).any()
    none = discovery.ges(score, columns, allowed=np.zeros((3, 3), bool))
    assert not none.any()
    led = discovery.with_prior(score, {("a", "b"): 0.999})
    assert led("b", frozenset("a")) > score("b", frozenset("a"))
    assert discovery.oriented(found, np.triu(np.ones((3, 3))), greedy=True).sum() == 3


def test_linear_methods_find_the_chain(linear):
    columns = ["x", "y", "z"]
    skeleton = {(0, 1), (1, 2)}
    for found in (discovery.pc(linear, columns), discovery.notears(linear, columns) != 0, discovery.dagma(linear, columns) != 0):
        assert {(min(i, j), max(i, j)) for i, j in zip(*np.nonzero(found), strict=True)} == skeleton
    w = discovery.lingam(linear, columns)
    assert {(i, j) for i, j in zip(*np.nonzero(w), strict=True)} == skeleton
    assert abs(w[0, 1] - 1.5) < 0.1 and abs(w[1, 2] + 1.2) < 0.1
    one_way = np.triu(np.ones((3, 3), bool), 1)
    assert not np.tril(discovery.notears(linear, columns, allowed=one_way)).any()


def test_ledger_tools(spark):
    e = spark.createDataFrame([(0, "m", "x", "y"), (1, "m", "x", "y"), (0, "m", "y", "x"), (1, "m", "y", "z")], "run int, method string, src string, dst string")
    assert ledger.selected(ledger.ledger(e)) == [("x", "y"), ("y", "z")]
    assert ledger.selected(ledger.ledger(e), top_k=1) == [("x", "y")]
    m = ledger.metrics(e.limit(1), spark.createDataFrame([("y", "x")], "src string, dst string")).first()
    assert (m.shd, m.skeleton_f1) == (2, 1.0)
    assert ledger.validity(e.limit(0), e).first().validity == 1.0
    p = {(r.i, r.j): (r.m, r.b) for r in ledger.prior_matrices(spark.createDataFrame([("x", "y", 0.5, 0.8, 0.75), ("x", "z", None, 0.1, None)], "i string, j string, a double, c double, d double")).collect()}
    assert np.allclose(p["x", "y"], (0.4, 0.3)) and np.allclose(p["y", "x"], (0.4, 0.1)) and p["x", "z"] == (0.5, 0.5)


def test_streamed_counts_add_up(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = maintain_counts(stream, ["event_type"], str(tmp_path / "counts"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = {r.event_type: r.n for r in current_counts(spark, str(tmp_path / "counts"), ["event_type"]).collect()}
    assert got == {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}


def test_worlds_are_made_after_look_ups_and_draw_for_rivals_only(spark):
    """Probabilities are joined to rows before these are multiplied, and levels that can't win need no draw: the worlds are those of all draws."""
    import re

    from pyspark.sql import functions as F

    from lodestone.operators.counterfactual import abducted, counterfactual, likeliest

    shares = {"x": {"p": 0.5, "q": 0.3, "r": 0.2}, "y": {"p": 0.2, "q": 0.3, "r": 0.5}}
    tables = {"b": spark.createDataFrame([(a, b, p) for a, by in shares.items() for b, p in by.items()], "a string, b string, p double")}
    rows = spark.createDataFrame([(i, "x", b) for i in range(100) for b in "pqr"] + [(7, "x", None), (8, "z", "q")], "id long, a string, b string").withColumn("id", F.xxhash64("id", "b"))
    got = counterfactual(rows, tables, {"a": [], "b": ["a"]}, {"a": "y"}, draws=20)
    assert re.findall(r"Join (\w+)", got._jdf.queryExecution().optimizedPlan().toString())[0] != "LeftOuter"
    logs = {a: [F.log(F.lit(p)) for p in by.values()] for a, by in shares.items()}
    worlds = rows.crossJoin(spark.range(20).select(F.col("id").alias("draw")))
    noise = abducted("b", F.col("b"), list("pqr"), logs["x"], 0, [F.col("id"), F.col("draw")])
    plain = worlds.withColumn("cf_b", F.when(F.col("a") == "z", F.col("b")).otherwise(likeliest(list("pqr"), [new + g for new, g in zip(logs["y"], noise, strict=True)])))
    wanted = sorted(map(repr, plain.select("id", "draw", "cf_b").collect()))
    assert sorted(map(repr, got.select("id", "draw", "cf_b").collect())) == wanted and len(wanted) == 6040
