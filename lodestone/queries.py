"""Queries of the causal operators over the standard tables, and SQL that gives the same rows."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import local_name, natural_key, normal, short_hash, slug, uniform
from lodestone.operators import cpt, discovery, encode, inference, ledger, profile, weighted
from lodestone.plans.flat_join import FlatJoin, flat_join
from lodestone.plans.schema import PropertyNode, infer_properties, mapped_schema
from lodestone.sources.mapped import TABLES, ClassMap, MappedSource, table
from lodestone.storage import materialise, shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _joined(spark: SparkSession, d: str, wanted: dict[str, list[str]], classes: list[str], **how) -> FlatJoin:
    """The flat join over some classes, with the data columns wanted of each."""
    source = MappedSource(spark, d, {c: TABLES[c] for c in classes})
    schema = mapped_schema(source)
    by = {(n.domain, n.prop): n for n in schema.nodes()}
    joined = [n for n in schema.nodes() if n.kind == "object" and n.range in classes]
    return flat_join(schema, source, [by[c, p] for c, ps in wanted.items() for p in ps], joined, **how)


def _renamed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.split("__")[-1] for c in df.columns])


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Lineitem and its order, the table that most queries learn from."""
    wanted = {"Lineitem": ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"], "Order": ["o_orderpriority", "o_orderstatus"]}
    return _renamed(_joined(spark, d, wanted, ["Lineitem", "Order"], show_keys=False).df)


_LINES = "(SELECT l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, o_orderpriority, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("SELECT c_custkey, n_nationkey, r_regionkey, c_acctbal, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def flat_join_cust_nation_region(spark: SparkSession, d: str) -> DataFrame:
    return _renamed(_joined(spark, d, {"Customer": ["c_acctbal", "c_mktsegment"], "Nation": ["n_name"], "Region": ["r_name"]}, ["Customer", "Nation", "Region"]).df)


@query("""SELECT n_name, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey AND s_nationkey = n_nationkey GROUP BY n_name""")
def flat_join_cycle(spark: SparkSession, d: str) -> DataFrame:
    """Lineitem to Order to Customer to Nation and to Supplier to Nation: the relation that closes the cycle filters."""
    j = _joined(spark, d, {"Lineitem": ["l_quantity"], "Nation": ["n_name"]}, ["Lineitem", "Order", "Customer", "Supplier", "Nation"])
    return _renamed(j.df).groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("SELECT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL")
def flat_join_excluded_still_filters(spark: SparkSession, d: str) -> DataFrame:
    return _renamed(_joined(spark, d, {"Nation": ["n_name"]}, ["Customer", "Nation"], show_keys=False).df)


@query("SELECT c_custkey, c_mktsegment, 'Nation/' || c_nationkey AS c_nationkey FROM customer WHERE c_nationkey IS NOT NULL")
def flat_join_object_variable(spark: SparkSession, d: str) -> DataFrame:
    source = MappedSource(spark, d, {"Customer": TABLES["Customer"]})
    schema = mapped_schema(source)
    nodes = [n for n in schema.nodes() if n.prop in ("c_mktsegment", "c_nationkey")]
    return _renamed(flat_join(schema, source, nodes, []).df)


_SCORED = "(SELECT doc_id, lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


def _scored(spark: SparkSession, d: str, optional: bool) -> DataFrame:
    """Documents with the labels that some have, as one class; the flat join of it."""
    folder = f"{shared_dir(spark)}/scored-{uuid.uuid4().hex}"
    table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left").write.parquet(f"{folder}/scored.parquet")
    source = MappedSource(spark, folder, {"Document": ClassMap("scored", ("doc_id",), ("lang", "source", "quality", "toxic"))})
    schema = mapped_schema(source)
    return _renamed(flat_join(schema, source, schema.nodes(), optional=optional).df)


@query(f"SELECT * FROM {_SCORED}")
def flat_join_optional(spark: SparkSession, d: str) -> DataFrame:
    """Optional properties: an entity without one keeps its row."""
    return _scored(spark, d, True)


@query(f"SELECT * FROM {_SCORED} WHERE lang IS NOT NULL AND source IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
def flat_join_required(spark: SparkSession, d: str) -> DataFrame:
    """The same where each must be there."""
    return _scored(spark, d, False)


def _valued(spark: SparkSession, d: str, value: str) -> FlatJoin:
    source = MappedSource(spark, d, {c: TABLES[c] for c in ("Customer", "Nation")})
    schema = mapped_schema(source)
    return flat_join(schema, source, [n for n in schema.nodes() if n.prop in ("c_mktsegment", "c_nationkey")], [], values={"Customer__c_nationkey": value})


@query("SELECT c_custkey, c_mktsegment, n_name AS c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL")
def flat_join_key_property(spark: SparkSession, d: str) -> DataFrame:
    """A related entity shown by a property of its own, without joining its class."""
    return _renamed(_valued(spark, d, "n_name").df)


@query("SELECT c_mktsegment, 'Nation' AS c_nationkey, 1 AS warnings, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def flat_join_range_class(spark: SparkSession, d: str) -> DataFrame:
    """A property that the range does not have falls back to the range's class, with a warning."""
    j = _valued(spark, d, "n_population")
    return _renamed(j.df).groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")).withColumn("warnings", F.lit(len(j.warnings)))


@query("SELECT 100 AS n")
def cross_guard_limit(spark: SparkSession, d: str) -> DataFrame:
    """Two classes without a link are refused unless a limit bounds their product."""
    return _joined(spark, d, {"Part": ["p_brand"], "Region": ["r_name"]}, ["Part", "Region"], limit=100).df.agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT c_custkey, n_nationkey, r_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT 'Customer__c_custkey' AS entity, count(*) / count(DISTINCT c_custkey) AS multiplicity FROM j UNION ALL SELECT 'Nation__n_nationkey', count(*) / count(DISTINCT n_nationkey) FROM j UNION ALL SELECT 'Region__r_regionkey', count(*) / count(DISTINCT r_regionkey) FROM j""")
def multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d, {"Customer": ["c_mktsegment"], "Nation": ["n_name"], "Region": ["r_name"]}, ["Customer", "Nation", "Region"]).multiplicity()


_PROFILED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 1 AS is_constant, count(DISTINCT {c}) >= greatest(2, 0.9 * count(*)) AS near_unique, count(DISTINCT {c}) > 20 AS many_levels FROM orders" for c in _PROFILED))
def distinct_constant_near_unique(spark: SparkSession, d: str) -> DataFrame:
    return profile.distinct_profile(table(spark, d, "orders"), list(_PROFILED))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CASE WHEN NOT bool_and(try_cast({c} AS DOUBLE) IS NOT NULL) THEN 'categorical' WHEN NOT bool_and(try_cast({c} AS DOUBLE) % 1 = 0) THEN 'continuous' WHEN count(DISTINCT {c}) <= 20 THEN 'categorical' ELSE 'discrete' END AS kind FROM lineitem" for c in ("l_quantity", "l_discount", "l_returnflag", "l_linenumber", "l_partkey")))
def dtype_inference(spark: SparkSession, d: str) -> DataFrame:
    return profile.inferred_types(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_returnflag", "l_linenumber", "l_partkey"])


@query("SELECT l_orderkey, l_linenumber, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey) AS weight FROM lineitem")
def row_weights(spark: SparkSession, d: str) -> DataFrame:
    return encode.row_weights(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY p_size) AS code FROM part")
def dense_code(spark: SparkSession, d: str) -> DataFrame:
    return encode.coded(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "code", start=1).select("p_partkey", "code")


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders")
def label_encode(spark: SparkSession, d: str) -> DataFrame:
    return encode.coded(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN -1 ELSE quality END AS code FROM documents LEFT JOIN labels USING (doc_id)")
def ordinal_code(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return encode.coded(both.select("doc_id", "quality"), "quality", "code", null_code=-1).select("doc_id", "code")


@query("""WITH e AS (SELECT quantile_cont(o_totalprice, 1/3.0) AS a, quantile_cont(o_totalprice, 2/3.0) AS b FROM orders)
SELECT o_orderkey, CASE WHEN o_totalprice <= a THEN 0.0 WHEN o_totalprice <= b THEN 1.0 ELSE 2.0 END::DOUBLE AS bin FROM orders, e""")
def quantile_bins(spark: SparkSession, d: str) -> DataFrame:
    return encode.quantile_binned(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 3).select("o_orderkey", F.col("o_totalprice").alias("bin"))


@query("""WITH e AS (SELECT min(p_retailprice) AS lo, (max(p_retailprice) - min(p_retailprice)) / 4 AS w FROM part)
SELECT p_partkey, ((p_retailprice > lo + w)::INT + (p_retailprice > lo + w * 2)::INT + (p_retailprice > lo + w * 3)::INT)::DOUBLE AS bin FROM part, e""")
def width_bins(spark: SparkSession, d: str) -> DataFrame:
    return encode.width_binned(table(spark, d, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"], 4).select("p_partkey", F.col("p_retailprice").alias("bin"))


@query("""WITH e AS (SELECT unnest([quantile_cont(l_quantity, 0.0), quantile_cont(l_quantity, 0.25), quantile_cont(l_quantity, 0.5), quantile_cont(l_quantity, 0.75), quantile_cont(l_quantity, 1.0)]) AS x FROM lineitem),
r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM (SELECT DISTINCT x FROM e))
SELECT 'l_quantity' AS "column", (a.i - 1)::INT AS band, a.x::DOUBLE AS low, b.x::DOUBLE AS high FROM r a JOIN r b ON b.i = a.i + 1""")
def unit_bands(spark: SparkSession, d: str) -> DataFrame:
    return encode.unit_bands(table(spark, d, "lineitem"), ["l_quantity"])


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20")
def unit_search(spark: SparkSession, d: str) -> DataFrame:
    return encode.unit_search(table(spark, d, "lineitem"), {"l_returnflag": "R"}, {"l_quantity": (10, 20)}).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) AS k FROM c)
SELECT l_orderkey, m.l_returnflag, a.l_quantity FROM m JOIN (SELECT l_orderkey, round(avg(l_quantity), 6) AS l_quantity FROM lineitem GROUP BY 1) a USING (l_orderkey) WHERE k = 1""")
def entity_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return profile.entity_aggregate(table(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_quantity"], ["l_returnflag"]).withColumn("l_quantity", F.round("l_quantity", 6))


@query("SELECT o_orderpriority AS level, count(*) / sum(count(*)) OVER () AS p FROM orders GROUP BY 1")
def distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT o_orderpriority AS level, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 9) AS p FROM orders GROUP BY 1")
def weighted_distribution(spark: SparkSession, d: str) -> DataFrame:
    return profile.distribution(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").withColumn("p", F.round("p", 9))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, round(avg({c}), 6) AS mean FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")))
def numeric_ranges(spark: SparkSession, d: str) -> DataFrame:
    return profile.numeric_ranges(table(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn("mean", F.round("mean", 6))


@query(f"SELECT o_orderpriority, l_returnflag, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 9) AS p FROM {_LINES} GROUP BY 1, 2")
def cpt_mle(spark: SparkSession, d: str) -> DataFrame:
    return cpt.cpt(_lines(spark, d), "l_returnflag", ["o_orderpriority"]).withColumn("p", F.round("p", 9))


@query(f"""WITH t AS (SELECT * FROM {_LINES}), c AS (SELECT l_linestatus, l_returnflag, count(*) AS n FROM t GROUP BY 1, 2),
f AS (SELECT a.l_linestatus, b.l_returnflag, coalesce(n, 0) AS n, 5.0::DOUBLE / count(*) OVER () AS alpha FROM (SELECT DISTINCT l_linestatus FROM t) a CROSS JOIN (SELECT DISTINCT l_returnflag FROM t) b LEFT JOIN c USING (l_linestatus, l_returnflag))
SELECT l_linestatus, l_returnflag, round((n + alpha) / sum(n + alpha) OVER (PARTITION BY l_linestatus), 9) AS p FROM f""")
def cpt_bdeu(spark: SparkSession, d: str) -> DataFrame:
    return cpt.cpt(_lines(spark, d), "l_returnflag", ["l_linestatus"], ess=5.0).withColumn("p", F.round("p", 9))


_FAMILIES = (("l_returnflag", ()), ("l_returnflag", ("l_linestatus",)), ("o_orderstatus", ("l_linestatus", "o_orderpriority")))


def _bic_sql(child: str, parents: tuple[str, ...]) -> str:
    over = f"PARTITION BY {', '.join(parents)}" if parents else ""
    q = " * ".join(["1", *[f"count(DISTINCT {p})" for p in parents]])
    keys = ", ".join([*parents, child])
    return f"SELECT '{child}' AS child, '{','.join(parents)}' AS parents, round(sum(n * ln(share)) - 0.5 * ln(sum(n)) * ({q}) * (count(DISTINCT {child}) - 1), 4) AS score FROM (SELECT {keys}, n, n / sum(n) OVER ({over}) AS share FROM (SELECT {keys}, count(*) AS n FROM {_LINES} GROUP BY {keys}))"


@query(" UNION ALL ".join(_bic_sql(*f) for f in _FAMILIES))
def bic_local_scores(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d)
    parts = [cpt.bic_score(df, c, list(ps)).select(F.lit(c).alias("child"), F.lit(",".join(ps)).alias("parents"), F.round("score", 4).alias("score")) for c, ps in _FAMILIES]
    return reduce(DataFrame.unionByName, parts)


_NETWORK = {"o_orderpriority": [], "l_linestatus": [], "l_returnflag": ["l_linestatus"], "o_orderstatus": ["l_linestatus", "o_orderpriority"]}


def _tables_sql() -> str:
    out = [f"t AS (SELECT * FROM {_LINES})"]
    for n, ps in _NETWORK.items():
        over = f"PARTITION BY {', '.join(ps)}" if ps else ""
        keys = ", ".join([*ps, n])
        out.append(f"p_{n} AS (SELECT {keys}, count(*) / sum(count(*)) OVER ({over}) AS p_{n} FROM t GROUP BY {keys})")
    return "WITH " + ", ".join(out)


_JOINT = "p_o_orderpriority JOIN p_l_linestatus ON true JOIN p_l_returnflag USING (l_linestatus) JOIN p_o_orderstatus USING (l_linestatus, o_orderpriority)"
_P = "p_o_orderpriority * p_l_linestatus * p_l_returnflag * p_o_orderstatus"


def _tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return inference.fit(_lines(spark, d), _NETWORK)


@query(_tables_sql() + f""", b AS (SELECT sum(ln(p_l_returnflag)) + sum(ln(p_l_linestatus)) + sum(ln(p_o_orderpriority)) + sum(ln(p_o_orderstatus)) AS ll, count(*) AS n FROM t JOIN p_o_orderpriority USING (o_orderpriority) JOIN p_l_linestatus USING (l_linestatus) JOIN p_l_returnflag USING (l_linestatus, l_returnflag) JOIN p_o_orderstatus USING (l_linestatus, o_orderpriority, o_orderstatus)),
k AS (SELECT (count(DISTINCT o_orderpriority) - 1) + (count(DISTINCT l_linestatus) - 1) + (count(DISTINCT l_returnflag) - 1) * count(DISTINCT l_linestatus) + (count(DISTINCT o_orderstatus) - 1) * count(DISTINCT l_linestatus) * count(DISTINCT o_orderpriority) AS k FROM t)
SELECT round(ll, 3) AS log_likelihood, k AS parameters, n AS rows, round(ll - 0.5 * k * ln(n), 3) AS bic FROM b, k""")
def cbn_loglik_bic(spark: SparkSession, d: str) -> DataFrame:
    out = cpt.log_likelihood(_lines(spark, d), _NETWORK)
    return out.select(F.round("log_likelihood", 3).alias("log_likelihood"), "parameters", "rows", F.round("bic", 3).alias("bic"))


@query(_tables_sql() + f" SELECT l_returnflag, round(sum({_P}) / sum(sum({_P})) OVER (), 9) AS p FROM {_JOINT} WHERE o_orderstatus = 'P' GROUP BY 1")
def conditional_exact(spark: SparkSession, d: str) -> DataFrame:
    return inference.condition(_tables(spark, d), _NETWORK, "l_returnflag", {"o_orderstatus": "P"}).withColumn("p", F.round("p", 9))


@query(_tables_sql() + " SELECT o_orderstatus, round(sum(p_o_orderstatus * p_o_orderpriority), 9) AS p FROM p_o_orderstatus JOIN p_o_orderpriority USING (o_orderpriority) WHERE l_linestatus = 'F' GROUP BY 1")
def do_truncated_factorisation(spark: SparkSession, d: str) -> DataFrame:
    return inference.intervene(_tables(spark, d), _NETWORK, "o_orderstatus", {"l_linestatus": "F"}).withColumn("p", F.round("p", 9))


@query(_tables_sql() + """, e AS (SELECT l_linestatus, o_orderstatus, sum(p_o_orderstatus * p_o_orderpriority) AS p FROM p_o_orderstatus JOIN p_o_orderpriority USING (o_orderpriority) GROUP BY 1, 2)
SELECT o_orderstatus, round(coalesce(a.p, 0) - coalesce(b.p, 0), 9) AS difference FROM (SELECT * FROM e WHERE l_linestatus = 'F') a FULL JOIN (SELECT * FROM e WHERE l_linestatus = 'O') b USING (o_orderstatus)""")
def do_contrast(spark: SparkSession, d: str) -> DataFrame:
    return inference.effect(_tables(spark, d), _NETWORK, "o_orderstatus", {"l_linestatus": "F"}, {"l_linestatus": "O"}).withColumn("difference", F.round("difference", 9))


@query(f"""WITH s AS (SELECT o_orderpriority, count(*) AS n, avg(l_quantity) FILTER (l_returnflag = 'R') AS m1, avg(l_quantity) FILTER (l_returnflag = 'N') AS m0 FROM {_LINES} GROUP BY 1)
SELECT round(sum(n * (m1 - m0)) / sum(n), 6) AS effect FROM s WHERE m1 IS NOT NULL AND m0 IS NOT NULL""")
def backdoor_adjusted_ate(spark: SparkSession, d: str) -> DataFrame:
    return inference.backdoor_effect(_lines(spark, d), "l_returnflag", "l_quantity", ["o_orderpriority"], "R", "N").withColumn("effect", F.round("effect", 6))


@query(f"SELECT l_returnflag, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM {_LINES} WHERE l_linestatus = 'F' GROUP BY 1")
def tier0_mechanism(spark: SparkSession, d: str) -> DataFrame:
    return inference.condition(_tables(spark, d), _NETWORK, "l_returnflag", {"l_linestatus": "F"}).withColumn("p", F.round("p", 9))


@query(_tables_sql() + """ SELECT 'o_orderpriority' AS node, o_orderpriority AS level, round(p_o_orderpriority, 9) AS p FROM p_o_orderpriority
UNION ALL SELECT 'l_returnflag', l_returnflag, round(p_l_returnflag, 9) FROM p_l_returnflag WHERE l_linestatus = 'F'
UNION ALL SELECT 'o_orderstatus', o_orderstatus, round(sum(p_o_orderstatus * p_o_orderpriority), 9) FROM p_o_orderstatus JOIN p_o_orderpriority USING (o_orderpriority) WHERE l_linestatus = 'F' GROUP BY 2""")
def board_predict(spark: SparkSession, d: str) -> DataFrame:
    """Every other node's distribution once a line's status is set."""
    return inference.answers_for(_tables(spark, d), _NETWORK, None, do={"l_linestatus": "F"}).withColumn("p", F.round("p", 9))


@query(_tables_sql() + """, u AS (SELECT o_orderpriority, count(*) / sum(count(*)) OVER () AS w FROM t WHERE l_quantity >= 40 AND o_orderstatus = 'O' GROUP BY 1)
SELECT o_orderstatus, round(sum(w * p_o_orderstatus) / sum(sum(w * p_o_orderstatus)) OVER (), 9) AS p FROM u JOIN p_o_orderstatus USING (o_orderpriority) WHERE l_linestatus = 'F' GROUP BY 1""")
def do_subpopulation(spark: SparkSession, d: str) -> DataFrame:
    """What the status of large lines' open orders would be, had the lines been filled: their priorities stay."""
    rows = _lines(spark, d).where("l_quantity >= 40 AND o_orderstatus = 'O'")
    return inference.intervene_rows(rows, _tables(spark, d), _NETWORK, "o_orderstatus", {"l_linestatus": "F"}).withColumn("p", F.round("p", 9))


_LINEAR = {"l_quantity": [], "l_discount": [], "l_extendedprice": ["l_quantity"], "l_tax": ["l_discount"]}


@query("""SELECT 'l_quantity' AS node, NULL AS parent, round(avg(l_quantity), 6) AS weight FROM lineitem UNION ALL SELECT 'l_discount', NULL, round(avg(l_discount), 6) FROM lineitem
UNION ALL SELECT 'l_extendedprice', NULL, round(regr_intercept(l_extendedprice, l_quantity), 6) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 6) FROM lineitem
UNION ALL SELECT 'l_tax', NULL, round(regr_intercept(l_tax, l_discount), 6) FROM lineitem UNION ALL SELECT 'l_tax', 'l_discount', round(regr_slope(l_tax, l_discount), 6) FROM lineitem""")
def linear_mechanisms(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators.mechanisms import fit_linear, mechanism_table

    lines = table(spark, d, "lineitem")
    return mechanism_table(lines, fit_linear(lines, _LINEAR)).select("node", "parent", F.round("weight", 6).alias("weight"))


@query("""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), r AS (SELECT * FROM lineitem, m WHERE l_returnflag = 'R')
SELECT 'hard' AS how, 'l_extendedprice' AS target, round(avg(a + b * 10), 3) AS mean, round(avg(a + b * 10) - avg(l_extendedprice), 3) AS difference FROM r
UNION ALL SELECT 'soft', 'l_extendedprice', round(avg(a + b * l_quantity / 2), 3), round(avg(a + b * l_quantity / 2) - avg(a + b * 10), 3) FROM r""")
def numeric_do(spark: SparkSession, d: str) -> DataFrame:
    """The mean price of returned lines with a quantity of 10, and with half of their own (a soft intervention) against that."""
    from lodestone.operators.mechanisms import fit_linear, numeric_effect

    lines = table(spark, d, "lineitem")
    model, rows, half = fit_linear(lines, _LINEAR), lines.where("l_returnflag = 'R'"), {"l_quantity": lambda x: x / 2}
    both = numeric_effect(rows, model, ["l_extendedprice"], {"l_quantity": 10}).withColumn("how", F.lit("hard"))
    both = both.unionByName(numeric_effect(rows, model, ["l_extendedprice"], half, {"l_quantity": 10}).withColumn("how", F.lit("soft")))
    return both.withColumns({c: F.round(c, 3) for c in ("mean", "difference")})


@query("""WITH w AS (SELECT l_quantity AS x, 1.0::DOUBLE / count(*) OVER (PARTITION BY l_orderkey) AS w FROM lineitem), m AS (SELECT sum(w) AS s, sum(w * w) AS s2, sum(w * x) / sum(w) AS mean FROM w)
SELECT round(any_value(mean), 6) AS mean, round(sqrt(sum(w * (x - mean) ** 2) / any_value(s)), 6) AS sd, round(any_value(s) ** 2 / any_value(s2), 3) AS ess FROM w, m""")
def weighted_moments_ess(spark: SparkSession, d: str) -> DataFrame:
    out = weighted.moments(encode.row_weights(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_orderkey"), "l_quantity", "weight")
    return out.select(F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round("ess", 3).alias("ess"))


_G = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(ln(sum(({a}) * ({b}))), 9) AS ln_s FROM (SELECT *, 1.0::DOUBLE AS one FROM lineitem)" for i, a in enumerate(("one", *_G)) for b in ("one", *_G)[i:]))
def gram_matrix(spark: SparkSession, d: str) -> DataFrame:
    return discovery.moment_table(table(spark, d, "lineitem"), list(_G)).select("a", "b", F.round(F.log("s"), 9).alias("ln_s"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_G) for b in _G[i + 1 :]))
def pearson(spark: SparkSession, d: str) -> DataFrame:
    """From the moments of one pass, as the discovery methods take them."""
    _, _, g = discovery.gram(table(spark, d, "lineitem"), list(_G))
    r = discovery.correlations(g)
    return spark.createDataFrame([(a, b, round(float(r[i, j]), 6)) for i, a in enumerate(_G) for j, b in enumerate(_G) if i < j], "a string, b string, r double")


#: What methods find among the known columns, run by run; the columns of a run are those of its edges.
_RUNS = [(0, "GES", "a", "c"), (0, "GES", "b", "c"), (0, "GES", "c", "d"), (1, "LiNGAM", "a", "c"), (1, "LiNGAM", "c", "d"), (2, "NOTEARS", "b", "c"), (2, "NOTEARS", "c", "d"), (3, "GES", "a", "d"), (3, "GES", "b", "d")]
_RUN_SQL = "(VALUES " + ", ".join(map(str, _RUNS)) + ") e(run, method, src, dst)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Edges that methods find in four tables of the columns; the last hides c, so a and b cause d there."""
    rows = materialise(_dependent(spark, d).select(*"abcd"), "known")
    bcd, acd = list("bcd"), list("acd")
    found = [
        (0, "GES", list("abcd"), discovery.ges(discovery.GaussScores(rows, list("abcd")), list("abcd"))),
        (1, "LiNGAM", acd, discovery.lingam(rows, acd)),
        (2, "NOTEARS", bcd, discovery.notears(rows, bcd, scale=False)),
        (3, "GES", list("abd"), discovery.ges(discovery.GaussScores(rows, list("abd")), list("abd"))),
    ]
    return reduce(DataFrame.unionByName, [discovery.edges(spark, a, columns, m).select(F.lit(k).alias("run"), F.lit(m).alias("method"), "src", "dst") for k, m, columns, a in found])


@query(f"""WITH e AS (SELECT src, dst, count(DISTINCT run) AS freq, array_to_string(list_sort(list(DISTINCT method)), ',') AS methods FROM {_RUN_SQL} GROUP BY 1, 2)
SELECT a.src, a.dst, a.freq, a.methods, a.freq + coalesce(b.freq, 0) AS adjacency_freq, b.freq IS NOT NULL AS conflict FROM e a LEFT JOIN e b ON a.src = b.dst AND a.dst = b.src""")
def edge_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.ledger(_runs(spark, d)).withColumn("methods", F.array_join("methods", ","))


@query(f"""WITH f AS (SELECT DISTINCT src, dst FROM {_RUN_SQL}), t AS (SELECT * FROM (VALUES ('a', 'c'), ('b', 'c'), ('c', 'd')) t(src, dst)),
c AS (SELECT count(*) FILTER (f.src IS NOT NULL AND t.src IS NOT NULL) AS tp, count(*) FILTER (t.src IS NULL) AS fp, count(*) FILTER (f.src IS NULL) AS fn FROM f FULL JOIN t ON f.src = t.src AND f.dst = t.dst)
SELECT tp, fp, fn, fp + fn AS shd, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM c""")
def graph_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ledger.metrics(_runs(spark, d), spark.createDataFrame(_NUMERIC_TRUTH, "src string, dst string")).select("tp", "fp", "fn", "shd", "precision", "recall")


@query("""SELECT * FROM (VALUES ('c_name', 'data', 'Customer', 'xsd:string'), ('c_acctbal', 'data', 'Customer', 'xsd:string'), ('c_mktsegment', 'data', 'Customer', 'xsd:string'), ('c_nationkey', 'object', 'Customer', 'Nation'), ('n_name', 'data', 'Nation', 'xsd:string'), ('n_regionkey', 'object', 'Nation', 'Region'), ('r_name', 'data', 'Region', 'xsd:string')) t(p, kind, domain, range)
WHERE (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) > 0""")
def schema_inference(spark: SparkSession, d: str) -> DataFrame:
    source = MappedSource(spark, d)
    return infer_properties(reduce(DataFrame.unionByName, [source.triples(c) for c in ("Customer", "Nation", "Region")]))


@query("""WITH s AS (SELECT s_name, s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier) SELECT s_name, place FROM s WHERE place <= 20""")
def natural_sort_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 suppliers in natural order of their entity names; a top-k, so only 20 rows are numbered."""
    from pyspark.sql import Window

    named = table(spark, d, "supplier").select("s_name", natural_key(F.concat(F.lit("Supplier/"), F.col("s_suppkey").cast("string"))).alias("k"))
    return named.orderBy("k").limit(20).withColumn("place", F.row_number().over(Window.orderBy("k")).cast("long")).select("s_name", "place")


@query("SELECT count(*) > 0 AS reached FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 1 AND r_name = 'ASIA'")
def relational_reach(spark: SparkSession, d: str) -> DataFrame:
    j = _renamed(_joined(spark, d, {"Customer": ["c_mktsegment"], "Region": ["r_name"], "Nation": ["n_name"]}, ["Customer", "Nation", "Region"]).df)
    return j.where("c_custkey = 1 AND r_name = 'ASIA'").limit(1).agg((F.count("*") > 0).alias("reached"))


@query("""SELECT * FROM (VALUES ('Customer', 'c_acctbal', 'double', 'matched'), ('Customer', 'c_mktsegment', 'string', 'matched'), ('Customer', 'c_name', 'string', 'extra_in_source'), ('Customer', 'c_nationkey', 'Nation', 'extra_in_source'), ('Customer', 'c_age', 'int', 'missing_in_source')) t(domain, prop, range, side)""")
def alignment_anti_joins(spark: SparkSession, d: str) -> DataFrame:
    nodes = mapped_schema(MappedSource(spark, d, {"Customer": TABLES["Customer"]})).nodes()
    as_rows = lambda ns: spark.createDataFrame([(n.domain, n.prop, n.range) for n in ns], "domain string, prop string, range string")
    graph = [*[n for n in nodes if n.prop in ("c_acctbal", "c_mktsegment")], PropertyNode("Customer", "c_age", "int")]
    return ledger.alignment(as_rows(graph), as_rows(nodes))


@query("SELECT a.r_name AS i, b.r_name AS j, coalesce(v, 0.5)::DOUBLE AS value FROM region a JOIN region b ON a.r_name <> b.r_name LEFT JOIN (VALUES ('ASIA', 'EUROPE', 0.9), ('AFRICA', 'ASIA', 0.1)) p(x, y, v) ON a.r_name = x AND b.r_name = y")
def prior_realign(spark: SparkSession, d: str) -> DataFrame:
    priors = spark.createDataFrame([("ASIA", "EUROPE", 0.9), ("AFRICA", "ASIA", 0.1)], "i string, j string, value double")
    return ledger.realigned(priors, table(spark, d, "region").select(F.col("r_name").alias("name")))


@query("SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_.\\-]', '_', 'g') AS slug, substr(sha1('Part|' || p_partkey || '|None'), 1, 8) AS id, 'p' || p_partkey AS name FROM part")
def deterministic_ids(spark: SparkSession, d: str) -> DataFrame:
    """Slugs, short hashes and local names of entities."""
    iri = F.concat(F.lit("http://x/y#a/p"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"), short_hash(8, F.lit("Part"), F.col("p_partkey"), F.lit(None)).alias("id"), local_name(iri).alias("name"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_event_counts(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.streaming.counts import windowed_counts

    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


_NUMERIC_TRUTH, _DISCRETE_TRUTH = [("a", "c"), ("b", "c"), ("c", "d")], [("x", "z"), ("y", "z"), ("z", "w")]


def _truth_sql(edges: list[tuple[str, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(map(str, edges)) + ") t(src, dst)"


def _dependent(spark: SparkSession, d: str) -> DataFrame:
    """Columns of each line whose causes are known: a, b, c = a + b + noise, d = c + noise; x, y, z (x and y, one of ten turned), w (z, but 1 for one of seven). All are hashes of the line's key."""
    key = F.col("l_orderkey"), F.col("l_linenumber")
    noise = lambda seed: (uniform(seed, *key) - 0.5) * F.lit(12**0.5)  # noqa: E731  of variance 1
    lines = table(spark, d, "lineitem").select(*key, noise(1).alias("a"), noise(3).alias("b"), (uniform(11, *key) < 0.5).cast("string").alias("x"), (uniform(13, *key) < 0.4).cast("string").alias("y"))
    lines = lines.withColumn("c", F.col("a") + F.col("b") + noise(5)).withColumn("d", F.col("c") + noise(7))
    lines = lines.withColumn("z", ((F.col("x") == "true") & (F.col("y") == "true")) != (uniform(15, *key) < 0.1)).withColumn("w", F.col("z") | (uniform(17, *key) < 0.15))
    return lines.withColumns({c: F.col(c).cast("string") for c in ("z", "w")})


def _found(spark: SparkSession, a, columns: list[str], method: str) -> DataFrame:
    return discovery.edges(spark, a, columns, method).select("src", "dst")


@query(_truth_sql(_DISCRETE_TRUTH))
def ges_structure(spark: SparkSession, d: str) -> DataFrame:
    """Edges that greedy equivalence search finds among the discrete columns, against the known ones."""
    columns = ["w", "x", "y", "z"]
    return _found(spark, discovery.ges(cpt.BicScores(_dependent(spark, d).select(*columns), columns), columns), columns, "GES")


@query(_truth_sql(_DISCRETE_TRUTH[1:]))
def ges_constrained_structure(spark: SparkSession, d: str) -> DataFrame:
    """The same where x may cause nothing and be caused by nothing."""
    columns = ["w", "x", "y", "z"]
    allowed = ~np.eye(4, dtype=bool)
    allowed[1, :] = allowed[:, 1] = False
    allowed[3, 2] = allowed[0, 3] = allowed[0, 2] = False  # z doesn't cause y, nor w anything
    return _found(spark, discovery.ges(cpt.BicScores(_dependent(spark, d).select(*columns), columns), columns, allowed), columns, "GES")


@query(_truth_sql(_NUMERIC_TRUTH))
def ges_gauss_structure(spark: SparkSession, d: str) -> DataFrame:
    columns = list("abcd")
    return _found(spark, discovery.ges(discovery.GaussScores(_dependent(spark, d), columns), columns), columns, "GES")


@query(_truth_sql(_NUMERIC_TRUTH))
def pc_structure(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, discovery.pc(_dependent(spark, d), list("abcd"), alpha=1e-4), list("abcd"), "PC")


@query(_truth_sql(_NUMERIC_TRUTH))
def notears_structure(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, discovery.notears(_dependent(spark, d), list("abcd"), scale=False), list("abcd"), "NOTEARS")


@query(_truth_sql(_NUMERIC_TRUTH))
def dagma_structure(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, discovery.dagma(_dependent(spark, d), list("abcd"), scale=False), list("abcd"), "DAGMA")


@query(_truth_sql(_NUMERIC_TRUTH))
def lingam_structure(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, discovery.lingam(_dependent(spark, d), list("abcd")), list("abcd"), "LiNGAM")


def _likely(u: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson counts of the means at the uniforms u: how many of the first 40 cumulative probabilities lie below."""
    p = np.exp(-mean)
    c, k = p, np.zeros(len(u))
    for i in range(1, 41):
        below = c < u
        if not below.any():  # nor are the later ones, which are no smaller
            break
        k += below
        p = p * mean / i
        c = c + p
    return k


def _flags(spark: SparkSession, d: str) -> DataFrame:
    """Flags of each line whose causes are known: f, g (by f) and h (against g). All are hashes of the line's key."""
    key = F.col("l_orderkey"), F.col("l_linenumber")
    flag = lambda seed, log_odds: (uniform(seed, *key) < 1 / (1 + F.exp(-log_odds))).cast("double")
    rows = table(spark, d, "lineitem").select(*key, (uniform(31, *key) < 0.5).cast("double").alias("f"))
    return rows.withColumn("g", flag(33, 3 * F.col("f"))).withColumn("h", flag(35, -3 * F.col("g")))


def _counted(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each line whose causes are known: k, l (by k) and m (by l). All are hashes of the line's key."""
    key = F.col("l_orderkey"), F.col("l_linenumber")

    def drawn(batches):
        for batch in batches:
            u, v, w = (c.to_numpy() for c in batch.columns)
            k = _likely(u, np.ones(len(u)))
            l = _likely(v, np.exp(0.5 * k))  # noqa: E741
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k, l, _likely(w, np.exp(-0.6 * l)))], names=list("klm"))

    return table(spark, d, "lineitem").select(*[uniform(seed, *key).alias(f"u{seed}") for seed in (37, 39, 41)]).mapInArrow(drawn, "k double, l double, m double")


@query(_truth_sql([("f", "g"), ("g", "h")]))
def notears_logistic_structure(spark: SparkSession, d: str) -> DataFrame:
    """Edges among 0/1 columns, by the logistic loss."""
    return _found(spark, discovery.notears(_flags(spark, d), list("fgh"), loss="logistic", lam=0.01, threshold=0.5), list("fgh"), "NOTEARS")


@query(_truth_sql([("k", "l"), ("l", "m")]))
def notears_poisson_structure(spark: SparkSession, d: str) -> DataFrame:
    """Edges among counts, by the Poisson loss."""
    return _found(spark, discovery.notears(_counted(spark, d), list("klm"), loss="poisson", lam=0.01, threshold=0.3), list("klm"), "NOTEARS")


_BIG = "CASE WHEN l_extendedprice > 40000 THEN 1.0 ELSE 0.0 END"


@query(f"SELECT l_returnflag AS level, {_BIG} AS big, round(count(*) / sum(count(*)) OVER (PARTITION BY {_BIG}), 4) AS p FROM lineitem GROUP BY 1, 2")
def softmax_mechanism(spark: SparkSession, d: str) -> DataFrame:
    """A category with one numeric parent of two values: the softmax regression is the table of shares."""
    from lodestone.operators import mixed_model

    rows = table(spark, d, "lineitem").select("l_returnflag", F.expr(_BIG).cast("double").alias("big"))
    model = mixed_model.fit(rows, {"big": [], "l_returnflag": ["big"]}, {"big": "number", "l_returnflag": "category"})
    levels = model.levels["l_returnflag"]
    two = mixed_model.probabilities(spark.createDataFrame([(0.0,), (1.0,)], "big double"), model, "l_returnflag")
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.round(f"p_{x}", 4).alias("p")) for x in levels]))
    return two.select("big", each.alias("e")).select("e.level", "big", "e.p")


@query("SELECT l_returnflag AS again, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def abduction_returns_what_was(spark: SparkSession, d: str) -> DataFrame:
    """A flag by quantity, price and status: the noise drawn given each line's flag leads to that flag again."""
    from lodestone.operators import mixed_model

    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", F.xxhash64("l_orderkey", "l_linenumber").alias("id"))
    network = {"l_quantity": [], "l_linestatus": [], "l_extendedprice": ["l_quantity"], "l_returnflag": ["l_quantity", "l_extendedprice", "l_linestatus"]}
    kinds = {"l_quantity": "number", "l_extendedprice": "number", "l_linestatus": "category", "l_returnflag": "category"}
    model = mixed_model.fit(rows, network, kinds, penalty=1e-3)
    return mixed_model.abducted_levels(rows, model, "l_returnflag", ["id"]).groupBy("again", "l_returnflag").agg(F.count("*").alias("n"))


_BAND = "CASE WHEN l_quantity <= 10 OR l_quantity > 40 THEN 'low' WHEN l_quantity <= 20 THEN 'top' ELSE 'medium' END"


@query(f"SELECT {_BAND.replace('l_quantity', '(51 - l_quantity)')} AS band, count(*) AS n, TRUE AS trees_explain_more FROM lineitem GROUP BY 1")
def ordered_mechanism(spark: SparkSession, d: str) -> DataFrame:
    """An ordered level that rises and falls in steps of quantity: what it would be had each line the quantity 51 less its own, decoded."""
    from lodestone.operators import mixed_model

    rows = table(spark, d, "lineitem").select("l_quantity", F.expr(_BAND).alias("band"), F.xxhash64("l_orderkey", "l_linenumber").alias("id"))
    network, kinds = {"l_quantity": [], "band": ["l_quantity"]}, {"l_quantity": "number", "band": "ordered"}
    model = mixed_model.fit(rows, network, kinds)
    line = mixed_model.fit(model.encoded(rows), network, {"l_quantity": "number", "band": "number"})
    equal = rows.groupBy("l_quantity").agg(F.count("*").alias("n"))  # what each becomes depends on its quantity alone
    moved = model.mechanisms["band"].with_mean(equal, lambda n: 51 - F.col(n), "code")
    out = model.decoded(moved, {"code": "band"}).groupBy(F.col("code").alias("band")).agg(F.sum("n").alias("n"))
    return out.withColumn("trees_explain_more", F.lit(model.mechanisms["band"].explained > line.mechanisms["band"].explained + 0.2))


_ASKED = [(1, 10.0, "A"), (2, 25.5, "N"), (3, 49.9, "R"), (4, 500.0, "A")]


@query(f"""WITH q AS (SELECT * FROM (VALUES {", ".join(map(str, _ASKED))}) v(question, quantity, flag)), m AS (SELECT question, l_extendedprice AS y, exp(-0.5 * ((l_quantity - quantity) / 1.5) ** 2) AS w FROM lineitem JOIN q ON l_returnflag = flag AND abs(l_quantity - quantity) <= 9)
SELECT question, round(sum(w * y) / sum(w), 6) AS mean, round(sum(w) ** 2 / sum(w * w), 6) AS ess FROM m GROUP BY 1""")
def kernel_condition(spark: SparkSession, d: str) -> DataFrame:
    """The price of lines near a quantity, by a kernel, and of a flag: for several questions by one join of ranges."""
    from lodestone.operators.ladder import kernel_means

    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), "l_extendedprice")
    asked = spark.createDataFrame(_ASKED, "question int, quantity double, flag string")
    return kernel_means(rows, asked, "l_extendedprice", {"quantity": 1.5}, ("flag",)).select("question", F.round("mean", 6).alias("mean"), F.round("ess", 6).alias("ess"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity) * 20 + regr_intercept(l_extendedprice, l_quantity), 4) AS mean, 'mechanism' AS backend FROM lineitem")
def mechanism_answer(spark: SparkSession, d: str) -> DataFrame:
    """The price given the quantity, which its own mechanism answers: the regression's value and the mean of its noise."""
    from lodestone.operators import ladder, mixed_model

    rows = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    model = mixed_model.fit(rows, {"l_quantity": [], "l_extendedprice": ["l_quantity"]}, {"l_quantity": "number", "l_extendedprice": "number"})
    found = ladder.condition(spark, model, "l_extendedprice", {"l_quantity": 20})["l_extendedprice"]
    return spark.createDataFrame([(round(found.mean, 4), found.backend)], "mean double, backend string")


@query("SELECT l_linenumber, count(*) AS n, round(avg(l_extendedprice + (10 - l_quantity) * p_retailprice), 3) AS price FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def given_mechanism(spark: SparkSession, d: str) -> DataFrame:
    """What lines would have cost had each the quantity 10, if prices are quantity times retail price and what is beyond that stays."""
    from lodestone.operators import mixed_model

    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_linenumber", "l_quantity", "p_retailprice", "l_extendedprice", F.xxhash64("l_orderkey", "l_linenumber").alias("id"))
    network = {"l_quantity": [], "p_retailprice": [], "l_extendedprice": ["l_quantity", "p_retailprice"]}
    model = mixed_model.fit(rows, network, dict.fromkeys(network, "number"), given={"l_extendedprice": "{l_quantity} * {p_retailprice}"})
    out = mixed_model.counterfactual(rows, model, {"l_quantity": 10.0}, targets=["l_extendedprice"])
    return out.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.avg("cf_l_extendedprice"), 3).alias("price"))


_SESSION_SQL = """WITH t AS (SELECT l_linestatus, o_orderpriority, o_orderstatus, o_orderkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), s AS (SELECT DISTINCT o_orderstatus FROM t),
q AS (SELECT 5.0 / (count(DISTINCT l_linestatus) * count(DISTINCT o_orderpriority)) AS each, count(DISTINCT o_orderstatus) AS r FROM t),
n AS (SELECT o_orderpriority, count(*) AS n FROM t WHERE l_linestatus = 'F' GROUP BY 1), c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM t WHERE l_linestatus = 'F' GROUP BY ALL),
own AS (SELECT o_orderpriority, count(*) / sum(count(*)) OVER () AS w FROM t WHERE o_orderkey = (SELECT min(o_orderkey) FROM t) GROUP BY 1)
SELECT s.o_orderstatus AS level, round(sum(w * (coalesce(c.n, 0) + each / r) / (coalesce(n.n, 0) + each)), 9) AS p, 'truncated-factorisation-of-rows' AS backend
FROM own CROSS JOIN s CROSS JOIN q LEFT JOIN n USING (o_orderpriority) LEFT JOIN c ON c.o_orderpriority = own.o_orderpriority AND c.o_orderstatus = s.o_orderstatus GROUP BY 1"""


@query(_SESSION_SQL)
def session_entity_intervention(spark: SparkSession, d: str) -> DataFrame:
    """A session asked what the status of the first order's lines would be, had they been filled."""
    from lodestone.project import Project

    source = MappedSource(spark, d, {c: TABLES[c] for c in ("Lineitem", "Order")})
    p = Project(mapped_schema(source), source)
    wanted = {"Lineitem__l_linestatus", "Order__o_orderpriority", "Order__o_orderstatus"}
    p.exclude(*[n.name for n in p.schema.nodes() if n.kind == "data" and n.name not in wanted])
    p.select([("Lineitem__l_linestatus", "Order__o_orderstatus"), ("Order__o_orderpriority", "Order__o_orderstatus")])
    first = p.join().df.agg(F.min("Order__o_orderkey").cast("string")).first()[0]
    a = p.ask("intervene", "Order__o_orderstatus", {"Lineitem__l_linestatus": "F"}, entity=first)
    return spark.createDataFrame([(k, round(v, 9), a.backend) for k, v in a.distribution.items()], "level string, p double, backend string")


@query("SELECT 'true' AS graph, 0 AS violations, 3 AS claims, 24 AS judged, round(2 / 24, 6) AS p, FALSE AS falsified UNION ALL SELECT 'other', 3, 3, 24, 1.0, TRUE WHERE (SELECT count(*) FROM lineitem) > 0")
def falsification_by_exchange(spark: SparkSession, d: str) -> DataFrame:
    """The graph that made the columns, and one of its shape with other nodes, against all exchanges of their nodes: two of 24 are the graph itself."""
    from lodestone.operators.falsify import falsify

    rows = materialise(_dependent(spark, d).select(*"abcd"), "known")
    graphs = {"true": {"a": [], "b": [], "c": ["a", "b"], "d": ["c"]}, "other": {"c": [], "d": [], "a": ["c", "d"], "b": ["a"]}}
    found = [(k, falsify(rows, g, alpha=0.1, level=1e-4)) for k, g in graphs.items()]
    return spark.createDataFrame([(k, v.violations, v.claims, v.judged, round(v.p, 6), v.falsified) for k, v in found], "graph string, violations int, claims int, judged int, p double, falsified boolean")


_WORLDS = "(SELECT DISTINCT CASE WHEN o_orderpriority LIKE '1%' THEN 'Customer/' || o_custkey END AS entity, CASE WHEN o_orderpriority NOT LIKE '1%' THEN o_orderpriority END AS seen, o_orderstatus AS act FROM orders)"


@query(f"SELECT 'CounterfactualQuery' AS kind, count(*) AS n FROM {_WORLDS} UNION ALL SELECT 'CounterfactualEstimate', count(*) FROM {_WORLDS} UNION ALL SELECT 'Act', count(*) FROM (SELECT DISTINCT entity, act FROM {_WORLDS})")
def worlds_as_triples(spark: SparkSession, d: str) -> DataFrame:
    """Worlds of the customers of urgent orders, and of hypothetical units that have the other priorities, in two runs that overlap: how many resources of each kind."""
    from lodestone.operators.causal_graph import VOCABULARY
    from lodestone.operators.worlds import world_triples

    urgent = F.col("o_orderpriority").startswith("1")
    entity = F.when(urgent, F.concat(F.lit("Customer/"), F.col("o_custkey").cast("string")))
    worlds = table(spark, d, "orders").select(entity.alias("entity"), F.lit("m").alias("model"), F.create_map(F.lit("status"), "o_orderstatus").alias("do"), F.create_map(F.lit("priority"), "o_orderpriority").alias("observed"), F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus").alias("predicted"), F.lit(None).cast("map<string,double>").alias("probability"), F.lit("gumbel-max").alias("coupling"))
    runs = world_triples(worlds.where("entity IS NOT NULL")).unionByName(world_triples(worlds)).distinct()
    return runs.where("p = 'rdf:type'").groupBy(F.regexp_replace("o", VOCABULARY, "").alias("kind")).agg(F.count("*").alias("n"))


_ONTOLOGY = """<http://t.example/v#Nation> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2002/07/owl#Class> .
<http://t.example/v#Region> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2000/01/rdf-schema#Class> .
<http://t.example/v#Region> <http://www.w3.org/2000/01/rdf-schema#label> "Gr\\u00F6\\u00DFe Region" .
<http://t.example/v#inRegion> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2002/07/owl#ObjectProperty> .
<http://t.example/v#inRegion> <http://www.w3.org/2000/01/rdf-schema#domain> <http://t.example/v#Nation> .
<http://t.example/v#inRegion> <http://www.w3.org/2000/01/rdf-schema#range> <http://t.example/v#Region> .
<http://t.example/v#r_name> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2002/07/owl#DatatypeProperty> .
<http://t.example/v#r_name> <http://www.w3.org/2000/01/rdf-schema#domain> <http://t.example/v#Region> .
<http://t.example/v#r_name> <http://www.w3.org/2000/01/rdf-schema#range> <http://www.w3.org/2001/XMLSchema#string> ."""


def _rdf(spark: SparkSession, d: str) -> DataFrame:
    """Nations and regions as N-Triples with an ontology that declares all but n_name, read back as triples of local names; parsed once, as schema and join both read them."""
    from lodestone.sources import ntriples

    v, fact = "http://t.example/v#", "s string, p string, o string, o_kind string"
    iri = lambda kind, key: F.concat(F.lit(f"http://t.example/{kind}/"), F.col(key).cast("string"))
    type_of = lambda cls: F.struct(F.lit(ntriples.RDF_TYPE).alias("p"), F.lit(v + cls).alias("o"), F.lit("iri").alias("o_kind"))
    value = lambda c: F.struct(F.lit(v + c).alias("p"), F.col(c).alias("o"), F.lit("literal").alias("o_kind"))
    link = F.struct(F.lit(v + "inRegion").alias("p"), iri("region", "n_regionkey").alias("o"), F.lit("iri").alias("o_kind"))
    facts = table(spark, d, "nation").select(iri("nation", "n_nationkey").alias("s"), F.explode(F.array(type_of("Nation"), value("n_name"), link)).alias("f"))
    facts = facts.unionByName(table(spark, d, "region").select(iri("region", "r_regionkey").alias("s"), F.explode(F.array(type_of("Region"), value("r_name"))).alias("f"))).select("s", "f.*")
    declared = spark.createDataFrame([(x,) for x in _ONTOLOGY.splitlines()], "value string")
    parsed = materialise(ntriples.parse(ntriples.lines(facts).unionByName(declared)), "parsed")
    return materialise(ntriples.localised(parsed), "triples")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def rdf_flat_join(spark: SparkSession, d: str) -> DataFrame:
    """From N-Triples with full IRIs and a partly declared schema to the flat join."""
    from lodestone.plans.schema import schema_of
    from lodestone.sources.ntriples import TripleSource

    triples = _rdf(spark, d)
    schema = schema_of(triples)
    return flat_join(schema, TripleSource(triples), [n for n in schema.nodes() if n.kind == "data"], show_keys=False).df.toDF("n_name", "r_name")


@query("""SELECT * FROM (VALUES ('inRegion', 'object', 'Nation', 'Region', 'declared'), ('r_name', 'data', 'Region', 'http://www.w3.org/2001/XMLSchema#string', 'declared'), ('n_name', NULL, NULL, NULL, 'undeclared'), (NULL, NULL, 'Region', 'Größe Region', 'label')) t(p, kind, domain, range, what)""")
def declared_schema(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.plans.schema import declared_properties, texts_of, undeclared_predicates

    triples, none = _rdf(spark, d), F.lit(None).cast("string")
    columns = "p", "kind", "domain", "range", "what"
    out = declared_properties(triples).withColumn("what", F.lit("declared")).select(*columns)
    out = out.union(undeclared_predicates(triples).select("p", none, none, none, F.lit("undeclared")))
    return out.union(texts_of(triples).select(none, none, "s", "label", F.lit("label"))).toDF(*columns)


@query("SELECT 0 AS component, n_name AS a, r_name AS b, NULL AS c FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 1, NULL, NULL, p_brand FROM part")
def component_flat_joins(spark: SparkSession, d: str) -> DataFrame:
    """Two groups of classes that nothing links: a join for each, and no product."""
    from lodestone.plans.flat_join import component_joins, main_component

    source = MappedSource(spark, d, {c: TABLES[c] for c in ("Nation", "Region", "Part")})
    schema = mapped_schema(source)
    kept = [n for n in schema.nodes() if n.prop in ("n_name", "r_name", "p_brand")]
    joins = component_joins(schema, source, kept)
    assert main_component(joins) == 0
    none = F.lit(None).cast("string")
    first, second = (j.df for j in joins)
    return first.select(F.lit(0).alias("component"), F.col("Nation__n_name").alias("a"), F.col("Region__r_name").alias("b"), none.alias("c")).unionByName(second.select(F.lit(1).alias("component"), none.alias("a"), none.alias("b"), F.col("Part__p_brand").alias("c")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS child, '{','.join(ps)}' AS parents, round(-0.5 * count(*) * ln({left} / count(*)) - 0.5 * {len(ps) + 1} * ln(count(*)), 2) AS score FROM lineitem" for c, ps, left in (("l_extendedprice", (), "regr_syy(l_extendedprice, l_quantity)"), ("l_extendedprice", ("l_quantity",), "(regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity))"))))
def gauss_local_scores(spark: SparkSession, d: str) -> DataFrame:
    score = discovery.GaussScores(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"])
    rows = [("l_extendedprice", ",".join(ps), round(score("l_extendedprice", frozenset(ps)), 2)) for ps in ((), ("l_quantity",))]
    return spark.createDataFrame(rows, "child string, parents string, score double")


@query("""WITH g AS (SELECT l_linestatus, count(*) AS n, regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity) AS left_over FROM lineitem GROUP BY 1),
f AS (SELECT l_returnflag, count(*) AS n, var_pop(l_quantity) AS v FROM lineitem GROUP BY 1), a AS (SELECT count(*) AS n, var_pop(l_quantity) AS v FROM lineitem)
SELECT 'l_extendedprice' AS child, 'l_linestatus,l_quantity' AS parents, round(sum(-0.5 * n * (ln(2 * pi() * left_over / n) + 1)) - 0.5 * 3 * count(*) * ln(sum(n)), 2) AS score FROM g
UNION ALL SELECT 'l_returnflag', 'l_quantity', round(sum(f.n * ln(f.n / a.n)) - sum(0.5 * f.n * (ln(2 * pi() * f.v) + 1)) + any_value(0.5 * a.n * (ln(2 * pi() * a.v) + 1)) - 0.5 * (count(*) - 1) * 3 * ln(any_value(a.n)), 2) FROM f, a""")
def mixed_local_scores(spark: SparkSession, d: str) -> DataFrame:
    """A numeric child of a number and a flag, and a flag that is the child of a number."""
    from lodestone.operators.mixed_scores import MixedScores

    score = MixedScores(table(spark, d, "lineitem"), ["l_extendedprice", "l_quantity"], ["l_linestatus", "l_returnflag"])
    families = (("l_extendedprice", ("l_linestatus", "l_quantity")), ("l_returnflag", ("l_quantity",)))
    return spark.createDataFrame([(c, ",".join(ps), round(score(c, frozenset(ps)), 2)) for c, ps in families], "child string, parents string, score double")


@query(_truth_sql([("a", "m"), ("m", "e"), ("x", "m")]))
def ges_mixed_structure(spark: SparkSession, d: str) -> DataFrame:
    """Edges among numbers and a flag: m depends on a and x, e on m."""
    from lodestone.operators.mixed_scores import MixedScores

    key = F.col("l_orderkey"), F.col("l_linenumber")
    rows = _dependent(spark, d).withColumn("m", F.col("a") + F.when(F.col("x") == "true", 2.0).otherwise(0.0) + normal(19, *key)).withColumn("e", F.col("m") + normal(23, *key))
    columns = ["a", "e", "m", "x"]
    return _found(spark, discovery.ges(MixedScores(rows, ["a", "e", "m"], ["x"]), columns), columns, "GES")


_BY_DIRECTION = ("GES-B-HL", "GES-M-B", "GES-M-B-Greedy", "GES-M-B-HL", "GES-M-B-MEC")


@query("SELECT method, 'z' AS src, 'w' AS dst FROM (VALUES " + ", ".join(f"('{m}')" for m in _BY_DIRECTION) + ") t(method)")
def prior_methods_structure(spark: SparkSession, d: str) -> DataFrame:
    """z causes w, which rows alone don't tell from the reverse: the prior does, by each method that directs edges by it."""
    columns = ["w", "z"]
    score = cpt.BicScores(_dependent(spark, d).select(*columns), columns)
    pairs = spark.createDataFrame([("z", "w", 0.9, 0.9, 0.9)], "i string, j string, a double, c double, d double")
    rows = ledger.prior_matrices(pairs).collect()
    priors = {k: {(r.i, r.j): r[k] for r in rows} for k in ("m", "b")}
    found = [discovery.edges(spark, discovery.with_priors(m, score, columns, priors), columns, m) for m in _BY_DIRECTION]
    return reduce(DataFrame.unionByName, found).select("method", "src", "dst")


_HELD_OUT = """WITH f AS (SELECT l_orderkey % 5 AS fold, l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), t AS (SELECT l_linestatus, l_returnflag, sum(n) AS total FROM f GROUP BY ALL),
r AS (SELECT k.fold, t.l_linestatus, t.l_returnflag, coalesce(f.n, 0) AS n, total - coalesce(f.n, 0) AS rest FROM t CROSS JOIN (SELECT unnest(range(5)) AS fold) k LEFT JOIN f ON f.fold = k.fold AND f.l_linestatus = t.l_linestatus AND f.l_returnflag = t.l_returnflag),
b AS (SELECT fold, l_linestatus, l_returnflag AS best FROM r WHERE rest > 0 QUALIFY row_number() OVER (PARTITION BY fold, l_linestatus ORDER BY rest DESC, l_returnflag) = 1),
m AS (SELECT fold, l_returnflag AS usual FROM (SELECT fold, l_returnflag, sum(rest) AS rest FROM r GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY fold ORDER BY rest DESC, l_returnflag) = 1),
j AS (SELECT l_returnflag AS actual, coalesce(best, usual) AS predicted, usual, n FROM r LEFT JOIN b USING (fold, l_linestatus) JOIN m USING (fold) WHERE n > 0),
l AS (SELECT level, 2 * sum(tp) / sum(n) AS f1 FROM (SELECT actual AS level, CASE WHEN actual = predicted THEN n ELSE 0 END AS tp, n FROM j UNION ALL SELECT predicted, 0, n FROM j) GROUP BY 1)
SELECT sum(n) FILTER (actual = predicted) / sum(n) AS accuracy, sum(n) FILTER (actual = usual) / sum(n) AS baseline, (SELECT avg(f1) FROM l) AS macro_f1 FROM j"""


@query(f"SELECT round(accuracy, 9) AS accuracy, round(baseline, 9) AS baseline, round(macro_f1, 9) AS macro_f1 FROM ({_HELD_OUT})")
def held_out_report(spark: SparkSession, d: str) -> DataFrame:
    out = cpt.cross_validated(table(spark, d, "lineitem"), "l_returnflag", ["l_linestatus"], F.col("l_orderkey"))
    return out.select(*[F.round(c, 9).alias(c) for c in ("accuracy", "baseline", "macro_f1")])


@query(f"SELECT 1 AS nodes, CASE WHEN accuracy > baseline THEN 0 ELSE 1 END AS failing, round(accuracy - baseline, 9) AS mean_lift, 'l_returnflag' AS worst_node FROM ({_HELD_OUT})")
def evaluation_summary(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators.browse import evaluation_summary as summary
    from lodestone.operators.evaluation import node_report

    report = node_report(table(spark, d, "lineitem"), {"l_linestatus": [], "l_returnflag": ["l_linestatus"]}, F.col("l_orderkey"))
    return summary(report.where("node = 'l_returnflag'")).withColumn("mean_lift", F.round("mean_lift", 9))


_CUSTOMERS = "(SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return _renamed(_joined(spark, d, {"Customer": ["c_name", "c_mktsegment", "c_acctbal"], "Nation": ["n_name"]}, ["Customer", "Nation"], show_keys=False).df)


@query(f"SELECT 'c_name' AS class, c_name AS entity FROM {_CUSTOMERS} WHERE lower(c_name) LIKE '%12%' UNION SELECT 'n_name', n_name FROM {_CUSTOMERS} WHERE contains(lower(n_name), '12')")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators.browse import entity_search as search

    return search(_customers(spark, d), ["c_name", "n_name"], "12")


@query(" UNION ALL ".join(f"SELECT '{c}' AS class, count(DISTINCT {c}) AS n, array_to_string(list_sort(list(DISTINCT {c}))[1:5], ',') AS entities FROM {_CUSTOMERS}" for c in ("c_name", "n_name")))
def entities_per_class(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators.browse import entities_per_class as per_class

    return per_class(_customers(spark, d), ["c_name", "n_name"], most=5).withColumn("entities", F.array_join("entities", ","))


@query("""WITH r AS (SELECT c_mktsegment, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey))
SELECT 'c_mktsegment' AS node, (SELECT c_mktsegment FROM r GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS level, NULL::DOUBLE AS mean UNION ALL SELECT 'c_acctbal', NULL, (SELECT round(avg(c_acctbal), 6) FROM r)""")
def unit_factual_state(spark: SparkSession, d: str) -> DataFrame:
    """What holds for the customers of the first nation by name."""
    from lodestone.operators.browse import factual_state

    flat = _customers(spark, d)
    first = flat.agg(F.min("n_name")).first()[0]
    return factual_state(flat, ["n_name"], first, ["c_mktsegment", "c_acctbal"], ["c_mktsegment"]).withColumn("mean", F.round("mean", 6))


@query("SELECT level, coalesce(p, 0) AS p, place FROM (SELECT o_orderstatus AS level, round(count(*) / sum(count(*)) OVER (), 9) AS p FROM orders GROUP BY 1) FULL JOIN (VALUES ('X', 0), ('P', 1), ('O', 2), ('F', 3)) v(level, place) USING (level)")
def zero_filled_levels(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators.browse import zero_filled

    return zero_filled(profile.distribution(table(spark, d, "orders"), "o_orderstatus").withColumn("p", F.round("p", 9)), ["X", "P", "O", "F"])


@query("SELECT (SELECT count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)) AS only_left, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)) AS only_right")
def frame_differences(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators.browse import differing_rows

    return differing_rows(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query()
def likelihood_weighting(spark: SparkSession, d: str) -> DataFrame:
    drawn = inference.sample(spark, _tables(spark, d), _NETWORK, 20_000, evidence={"o_orderstatus": "P"})
    return inference.weighted_answer(drawn, "l_returnflag")


@query()
def gumbel_counterfactual(spark: SparkSession, d: str) -> DataFrame:
    """What the status of its order would be for each open line, had the line been filled: every line counts, each with draws of its own."""
    from lodestone.operators.counterfactual import answer, counterfactual

    lines = table(spark, d, "lineitem").where("l_linestatus = 'O'").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(*_NETWORK, F.xxhash64("l_orderkey", "l_linenumber").alias("id"))
    return answer(counterfactual(rows, _tables(spark, d), _NETWORK, {"l_linestatus": "F"}, draws=50, targets=["o_orderstatus"]), "o_orderstatus")


@query("""WITH l AS (SELECT 'n_regionkey' AS p, 'Region/' || n_regionkey AS o, 'in region' AS p_label, r_name AS o_label FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3) SELECT * FROM l""")
def one_hop_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from lodestone.operators.neighbourhood import one_hop

    source = MappedSource(spark, d)
    labels = table(spark, d, "region").select(F.concat(F.lit("Region/"), F.col("r_regionkey").cast("string")).alias("s"), F.lit("label").alias("p"), F.col("r_name").alias("o"), F.lit("literal").alias("o_kind"))
    names = spark.createDataFrame([("n_regionkey", "label", "in region", "literal")], "s string, p string, o string, o_kind string")
    return one_hop(source.triples("Nation").unionByName(labels).unionByName(names), "Nation/3")


_PAIR = "(SELECT n_regionkey, min(n_nationkey) AS a, max(n_nationkey) AS b FROM nation GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 1)"


@query(f"SELECT 'shared' AS kind, 'Region/' || n_regionkey AS via, 'n_regionkey' AS p, 'n_regionkey' AS q FROM {_PAIR}")
def relational_path(spark: SparkSession, d: str) -> DataFrame:
    """How the first and the last nation of the first region with several are linked."""
    from lodestone.operators.neighbourhood import relational_path as path

    first = table(spark, d, "nation").groupBy("n_regionkey").agg(F.min("n_nationkey").alias("a"), F.max("n_nationkey").alias("b"), F.count("*").alias("n")).where("n > 1").orderBy("n_regionkey").first()
    return path(MappedSource(spark, d).triples("Nation"), f"Nation/{first.a}", f"Nation/{first.b}")


@query("SELECT o_custkey AS head, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, o_orderkey AS item FROM orders WHERE o_custkey IS NOT NULL")
def list_items(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders as a chain of cells, first and rest, read back in order."""
    from pyspark.sql import Window

    from lodestone.sources.lists import list_items as items

    orders, in_order = table(spark, d, "orders").where("o_custkey IS NOT NULL"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    cell = lambda k: F.concat(F.lit("_:"), F.col("o_custkey"), F.lit("-"), k)
    k = F.row_number().over(in_order)
    cells = orders.select("o_orderkey", cell(k).alias("s"), F.when(F.lead("o_orderkey").over(in_order).isNotNull(), cell(k + 1)).otherwise("rdf:nil").alias("next"))
    facts = F.explode(F.array(F.struct(F.lit("rdf:first").alias("p"), F.col("o_orderkey").cast("string").alias("o")), F.struct(F.lit("rdf:rest").alias("p"), F.col("next").alias("o"))))
    found = items(cells.select("s", facts.alias("t")).select("s", "t.*"))
    return found.select(F.regexp_extract("head", "_:(.*)-", 1).cast("long").alias("head"), "place", F.col("item").cast("long").alias("item"))


@query("SELECT l_orderkey, arg_max(l_returnflag, l_linenumber * 1000 + ascii(l_returnflag)) AS l_returnflag FROM lineitem GROUP BY 1")
def entity_attribution(spark: SparkSession, d: str) -> DataFrame:
    """The last line's flag of each order."""
    from lodestone.operators.neighbourhood import attributed

    return attributed(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_orderkey", "l_returnflag", "l_linenumber")


@query("""WITH w AS (SELECT o_totalprice AS x, sum(o_totalprice * 0 + 1.0::DOUBLE) AS w FROM orders GROUP BY 1), c AS (SELECT x, sum(w) OVER (ORDER BY x) / sum(w) OVER () AS c, lag(x) OVER (ORDER BY x) AS px FROM w),
p AS (SELECT x, c, px, lag(c) OVER (ORDER BY x) AS pc FROM c)
SELECT round((SELECT px + (x - px) * (0.025 - pc) / (c - pc) FROM p WHERE c >= 0.025 ORDER BY c LIMIT 1), 4) AS low, round((SELECT px + (x - px) * (0.975 - pc) / (c - pc) FROM p WHERE c >= 0.975 ORDER BY c LIMIT 1), 4) AS high""")
def weighted_interval(spark: SparkSession, d: str) -> DataFrame:
    out = weighted.interval(table(spark, d, "orders").select("o_totalprice", F.lit(1.0).alias("w")), "o_totalprice", "w")
    return out.select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@query(f"""WITH p AS (SELECT l_linestatus, l_returnflag, count(*) / sum(count(*)) OVER (PARTITION BY l_linestatus) AS p FROM {_LINES} GROUP BY 1, 2)
SELECT coalesce(a.l_returnflag, b.l_returnflag) AS level, round(coalesce(a.p, 0) - coalesce(b.p, 0), 9) AS difference FROM (SELECT * FROM p WHERE l_linestatus = 'F') a FULL JOIN (SELECT * FROM p WHERE l_linestatus = 'O') b ON a.l_returnflag = b.l_returnflag""")
def observed_contrast(spark: SparkSession, d: str) -> DataFrame:
    df = _lines(spark, d)
    one = lambda v: profile.distribution(df.where(F.col("l_linestatus") == v), "l_returnflag")
    return profile.contrast(one("F"), one("O")).withColumn("difference", F.round("difference", 9))


@query()
def falsification(spark: SparkSession, d: str) -> DataFrame:
    """The independences that the example network claims, tested."""
    from lodestone.operators.evaluation import falsification as test

    return test(_lines(spark, d), _NETWORK)


@query()
def clinic_flat_join(spark: SparkSession, d: str) -> DataFrame:
    """The flat join of a simulated clinic of 500 patients from its triples: the one item with a published time."""
    from lodestone.plans.schema import inferred_schema
    from lodestone.sources.ntriples import TripleSource
    from lodestone.sources.simulate import as_triples, clinic

    triples = materialise(as_triples(clinic(spark)), "clinic")
    schema = inferred_schema(triples)
    return flat_join(schema, TripleSource(triples), [n for n in schema.nodes() if n.kind == "data"]).df
