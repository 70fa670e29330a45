import numpy as np
import pytest

from lodestone.operators import browse, cpt, discovery
from lodestone.operators.mixed_scores import MixedScores


def test_cycles_are_turned_or_cut():
    ring = np.zeros((3, 3), bool)
    ring[0, 1] = ring[1, 2] = ring[2, 0] = True
    weights = np.array([[0, 3, 0], [0, 0, 2], [1, 0, 0]], float)
    turned = discovery.dagified(ring, weights=weights)
    assert turned[0, 2] and not turned[2, 0] and not discovery.find_cycle(turned)
    none_back = ring.copy()
    assert discovery.dagified(ring, allowed=none_back, weights=weights).sum() == 2


def test_direction_by_prior_stays_in_the_class():
    chain = np.zeros((3, 3), bool)
    chain[0, 1] = chain[1, 0] = chain[1, 2] = chain[2, 1] = True
    prior = np.full((3, 3), 0.5)
    prior[0, 1], prior[1, 0], prior[2, 1], prior[1, 2] = 0.9, 0.1, 0.8, 0.2  # 0 -> 1 <- 2 would be a new collider
    out = discovery.oriented_in_class(chain, prior)
    assert out[0, 1] and not out[1, 0] and out[1, 2] and not out[2, 1]


def test_mixed_scores_of_flags_are_bic_and_of_equal_rows_finite(spark):
    rows = spark.createDataFrame([(a, b, float(i)) for i, (a, b) in enumerate([("p", "u"), ("p", "v"), ("q", "v"), ("q", "v"), ("q", None)] * 3)], "a string, b string, x double")
    mixed, plain = MixedScores(rows.drop("x"), [], ["a", "b"]), cpt.BicScores(rows.drop("x"), ["a", "b"])
    far = MixedScores(rows.drop("x"), [], ["a", "b"], most=0)
    for child, of in (("a", frozenset()), ("b", frozenset("a"))):
        assert mixed(child, of) == pytest.approx(plain(child, of)) == pytest.approx(far(child, of))
    one = MixedScores(rows.where("a = 'p'").selectExpr("a", "1.5D AS x"), ["x"], ["a"])
    assert np.isfinite(one("x", frozenset("a"))) and np.isfinite(MixedScores(rows.where("false"), ["x"], ["a"])("x", frozenset()))
    assert MixedScores(rows, ["x"], ["a", "b"])("x", frozenset("a")) == pytest.approx(MixedScores(rows, ["x"], ["a", "b"], most=0)("x", frozenset("a")))


def test_frames_names_and_levels(spark):
    a = spark.createDataFrame([(1, "Ab"), (1, "Ab"), (2, None)], "k int, e string")
    b = spark.createDataFrame([(None, 2), ("Ab", 1), ("c", 3)], "e string, k int")
    assert tuple(browse.differing_rows(a, b).first()) == (1, 1) and tuple(browse.differing_rows(a, a).first()) == (0, 0)
    assert tuple(browse.differing_rows(a.where("false"), b.where("false")).first()) == (0, 0)
    with pytest.raises(ValueError):
        browse.differing_rows(a, b.drop("k"))
    assert browse.in_order(a, ["z", "k"]).columns == ["z", "k"] and browse.preview(a, 2).count() == 2
    assert [tuple(r) for r in browse.entity_search(a, ["e"], "AB").collect()] == [("e", "Ab")] and browse.entity_search(a.where("false"), ["e"], "").count() == 0
    got = browse.zero_filled(spark.createDataFrame([("y", 0.7), ("x", 0.3)], "level string, p double"), ["z", "y"])
    assert sorted((r.place, r.level, r.p) for r in got.collect()) == [(0, "z", 0.0), (1, "y", 0.7), (2, "x", 0.3)]
    with pytest.raises(KeyError):
        browse.factual_state(a, ["e"], "nobody", ["k"], [])


def test_short_numbers_and_vocabularies(spark):
    n = spark.createDataFrame([(100.0,), (10.5,), (0.12345,), (-0.0001,), (None,)], "x double")
    assert [r[0] for r in n.select(browse.short_number(n.x)).collect()] == ["100", "10.5", "0.123", "0", None]
    v = spark.createDataFrame([("http://www.w3.org/2002/07/owl#Class",), ("http://x/y",), (None,)], "x string")
    assert [r[0] for r in v.select(browse.is_vocabulary(v.x)).collect()] == [True, False, None]
    t = spark.createDataFrame([("s", "type", "A"), ("s", "type", "B"), ("s", "p", "1"), ("u", "p", "2")], "s string, p string, o string")
    assert browse.of_classes(t, ["A", "B"], ("type",)).count() == 3
    c = spark.createDataFrame([(0, "A", True), (0, "B", False)], "component int, class string, retained boolean")
    assert tuple(browse.component_summary(c).first()) == (0, 2, 2, 1)
