import pytest
from conftest import rows_of

from lodestone import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, sf, name):
    got, wanted = queries.QUERIES[name](spark, sf).toPandas(), duck.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows_of(got) == rows_of(wanted)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).toPandas() is not None


def test_counterfactual_counts_every_open_line(spark, duck, sf):
    """Noise given what was observed, over all rows that the network was fitted on, is noise as it was drawn: the answer is the mean of P(status | F, priority) over the open lines."""
    wanted = duck.sql(f"""WITH t AS (SELECT * FROM {queries._LINES}), f AS (SELECT o_orderpriority, o_orderstatus, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS p FROM t WHERE l_linestatus = 'F' GROUP BY 1, 2)
SELECT f.o_orderstatus AS level, sum(p) / (SELECT count(*) FROM t WHERE l_linestatus = 'O') AS p FROM t JOIN f USING (o_orderpriority) WHERE l_linestatus = 'O' GROUP BY 1""").df()
    got = {r.level: r.p for r in queries.QUERIES["gumbel_counterfactual"](spark, sf).collect()}
    assert all(abs(got.get(r.level, 0.0) - r.p) < 0.01 for r in wanted.itertuples()) and abs(sum(got.values()) - 1) < 1e-9


def test_entry_points_agree(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_likelihood_weighting_agrees_with_elimination(spark, sf):
    exact = {r.l_returnflag: r.p for r in queries.QUERIES["conditional_exact"](spark, sf).collect()}
    drawn = {r.l_returnflag: r for r in queries.QUERIES["likelihood_weighting"](spark, sf).collect()}
    assert exact.keys() == drawn.keys() and all(abs(drawn[k].p - p) < 0.03 for k, p in exact.items()) and not any(r.low_confidence for r in drawn.values())


def test_falsification_by_two_ways(spark, sf):
    """The tests that Spark makes one by one, and those from one table of counts."""
    from lodestone.operators.falsify import count_tests

    columns = sorted(queries._NETWORK)
    test = count_tests(queries._lines(spark, sf).select(*columns), columns)
    for r in queries.QUERIES["falsification"](spark, sf).collect():
        assert abs(r.p - test(r.x, r.y, tuple(filter(None, r.given.split(","))))) < 1e-6 and r.violated == (r.p < 0.05)


def test_clinic_join_gives_the_simulated_table(spark, sf):
    from lodestone.sources import simulate

    got, wanted = queries.QUERIES["clinic_flat_join"](spark, sf), simulate.flat(simulate.clinic(spark))
    columns = [c for c in wanted.columns if "__" in c]
    assert got.select(*columns).exceptAll(wanted.select(*columns)).count() == 0 and got.count() == wanted.count()


def test_counts_are_drawn_in_one_pass(spark, sf, monkeypatch):
    """Counts with known causes need no tables between them, and are those of cumulative Poisson probabilities."""
    import math

    import numpy as np

    def refused(*_, **__):
        raise AssertionError("a table was written")

    monkeypatch.setattr(queries, "materialise", refused)
    rows = queries._counted(spark, sf).select("k", "l", "m").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert abs(sum(r.k for r in rows) / len(rows) - 1) < 0.1
    u, mean = np.array([0.0, 0.1, 0.5, 0.9, 0.999999, 1.0]), np.array([1.0, 3.0, 0.2, 7.0, 2.0, 90.0])
    brute = [sum(sum(math.exp(-m) * m**j / math.factorial(j) for j in range(i + 1)) < x for i in range(40)) for x, m in zip(u, mean, strict=True)]
    assert queries._likely(u, mean).tolist() == brute
