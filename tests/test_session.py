import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import answers as qa
from lodestone.operators import evaluation
from lodestone.operators.causal_graph import CausalGraph, graphs_in, load
from lodestone.plans.flat_join import flat_join
from lodestone.plans.schema import PropertyNode, inferred_schema
from lodestone.project import Project
from lodestone.sources import simulate, turtle
from lodestone.sources.ntriples import TripleSource, parse, lines


@pytest.fixture(scope="module")
def clinic(spark):
    return simulate.clinic(spark, patients=300, hospitals=12).cache()


def test_clinic_does_not_depend_on_partitions(spark, clinic):
    again = simulate.clinic(spark, patients=300, hospitals=12).repartition(3)
    assert sorted(map(tuple, clinic.collect())) == sorted(map(tuple, again.collect()))
    assert len(simulate.truth()) == 11 and clinic.select("patient").distinct().count() == 300


def test_triples_of_the_clinic_join_back_to_its_flat_table(spark, clinic):
    triples = simulate.as_triples(clinic).cache()
    schema = inferred_schema(triples)
    assert schema.summary() == {"classes": 3, "data_properties": 11, "object_properties": 2, "conflicts": 0}
    j = flat_join(schema, TripleSource(triples), [n for n in schema.nodes() if n.kind == "data"])
    wanted = simulate.flat(clinic)
    columns = [c for c in wanted.columns if "__" in c]
    got = j.df.select("Therapy__iri", *columns)
    assert got.exceptAll(wanted.select("Therapy", *columns)).count() == 0 and got.count() == wanted.count()
    assert {r.entity.split("__")[0]: round(r.multiplicity, 6) for r in j.multiplicity().collect()}["Therapy"] == 1.0


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix x: <http://x/> . x:s a x:C ; x:p "v"@en, 1, 2.5, true ; x:q [ x:r <http://y> ] . x:l x:i ( "a" ) .')
    (tmp_path / "b.ttl").write_text("<http://x/s> a <http://x/C> .")
    got = turtle.read(spark, str(tmp_path)).toPandas()
    assert len(got) == 10 and set(got.o_kind) == {"iri", "literal", "bnode"}
    assert sorted(got[got.p == "http://x/p"].o) == ["1", "2.5", "true", "v"]
    for bad in ("<a> <b> .", "x:y <p> <o> .", "<a> <b> <c>", "<a> <b> ' ."):
        with pytest.raises(turtle.TurtleError):
            turtle.parse(bad)


def graph():
    nodes = [PropertyNode("A", "x", "string"), PropertyNode("A", "y", "string"), PropertyNode("B", "z", "int")]
    a = np.array([[0, 1, 0], [0, 0, 1], [0, 0, 0]], bool)
    return CausalGraph(nodes, a, np.where(a, 0.25, 0), {(1, 2): [(("r", "inverse"), ("q", "forward"))]}, "GES", True, "here", {"alpha": 0.05, "n": 3, "flag": True, "none": None, "l": [1]}, {(0, 1)}, ["g0"], "2024-01-01T00:00:00Z")


def test_causal_graph_round_trip(spark):
    g = graph()
    t = g.triples(spark)
    again = load(parse(lines(t.withColumn("p", F.when(F.col("p").startswith("rdf:"), F.lit("rdf:type")).otherwise(F.col("p"))))))
    assert (again.adjacency == g.adjacency).all() and (again.weights == g.weights).all() and again.labels == g.labels
    assert (again.nodes, again.method, again.constrained, again.source, again.parameters, again.manual, again.derived_from, again.created_at) == (g.nodes, "GES", True, "here", g.parameters, g.manual, ["g0"], g.created_at)
    assert again.id == g.id and graphs_in(t).first().n_edges == 2
    with pytest.raises(LookupError):
        load(t, method="PC")
    with pytest.raises(LookupError, match="2 causal graphs"):
        load(t.unionByName(g.subset(["A__x", "A__y"]).triples(spark)))


def test_graph_edits():
    g = graph()
    assert g.subset(["A__y", "B__z"]).labels == {(0, 1): [(("r", "inverse"), ("q", "forward"))]}
    loop = graph()
    loop.adjacency[2, 0], loop.weights[2, 0] = True, 0.1
    with pytest.raises(ValueError):
        loop.acyclic()
    cut = loop.acyclic("weight")
    assert cut.edges() == [(0, 1), (1, 2)] and cut.manual == {(0, 1)} and cut.derived_from[0] == "g0"


def test_queries_have_content_ids(spark):
    a = qa.Query("condition", "m", "t", (qa.Setting("x", "1"), qa.Setting("y", "2")))
    b = qa.Query("condition", "m", "t", (qa.Setting("y", "2"), qa.Setting("x", "1")))
    assert a.id == b.id and a.id != qa.Query("condition", "m", "t", (qa.Setting("x", "1"),)).id
    net = {"x": [], "y": ["x"], "t": ["y"]}
    a.check(net)
    assert a.reaches_target(net)
    for bad in (qa.Query("ask", "m", "t"), qa.Query("condition", "m", "x", (qa.Setting("x", "1"),)), qa.Query("condition", "m", "t", (qa.Setting("x", None),)), qa.Query("counterfactual", "m", "t"), qa.Query("condition", "m", "q")):
        with pytest.raises((ValueError, KeyError)):
            bad.check(net)
    table = qa.query_table(spark, [a])
    assert qa.load_queries(table) == [a]
    answers = qa.answer_table(spark, [qa.Answer(a.id, {"u": 0.5, "v": 0.5}, "exact")])
    t = qa.as_triples(table, answers)
    assert t.where("p = 'urn:lodestone:predicted' AND o = 'u'").count() == 1 and t.where("p = 'urn:lodestone:probability'").count() == 2


def test_tests_of_independence(spark):
    assert abs(evaluation.chi2_tail(3.841459, 1) - 0.05) < 1e-6 and abs(evaluation.chi2_tail(20.0, 10) - 0.029253) < 1e-5
    df = simulate.linear(spark, {"x": {}, "y": {"x": 1.0}, "z": {"y": 1.0}}, 3000)
    right = evaluation.falsification(df, {"x": [], "y": ["x"], "z": ["y"]}, numeric=True, alpha=0.01)
    wrong = evaluation.falsification(df, {"x": [], "y": [], "z": ["y"]}, numeric=True, alpha=0.01)
    assert right.where("violated").count() == 0 and wrong.where("violated").count() > 0
    coded = df.select(*[(F.col(c) > 0).cast("string").alias(c) for c in "xyz"])
    assert evaluation.g_test(coded, "x", "y", [])[2] < 1e-6 and evaluation.g_test(coded, "x", "y", ["y"])[2] > 0.99
    r2, base = evaluation.linear_fit(df, "y", ["x"], F.col("id") % 5)
    assert 0.4 < r2 < 0.6 and base == 0
    report = {r.node: r.lift for r in evaluation.node_report(coded.withColumn("i", F.monotonically_increasing_id()), {"x": [], "y": ["x"]}, F.col("i") % 5).collect()}
    assert report["y"] > 0.15 and abs(report["x"]) < 0.05


def test_project_from_source_to_answer(spark, clinic):
    triples = simulate.as_triples(clinic).cache()
    p = Project(inferred_schema(triples), TripleSource(triples))
    with pytest.raises(ValueError, match="no edges"):
        p.fit()
    columns = ["Patient__tumorStage", "Therapy__dosage", "Therapy__toxicity", "Therapy__drugClass"]
    g = p.discover("GES", columns)
    assert g.adjacency.any() and p.ledger().count() >= len(g.edges())
    p.discover("HC", columns)
    chosen = p.auto_select()
    assert chosen and p.curated().derived_from == [r.id for r in p.runs]
    with pytest.raises(ValueError, match="cycle"):
        p.select([("a", "b"), ("b", "a")])
    p.select([("Patient__tumorStage", "Therapy__dosage"), ("Therapy__dosage", "Therapy__toxicity"), ("Therapy__drugClass", "Therapy__toxicity")])
    low = p.ask("intervene", "Therapy__toxicity", {"Therapy__dosage": "Low"})
    high = p.ask("intervene", "Therapy__toxicity", {"Therapy__dosage": "High"})
    assert high.distribution["High"] > low.distribution["High"] and abs(sum(low.distribution.values()) - 1) < 1e-9
    given = p.ask("condition", "Therapy__toxicity", {"Therapy__dosage": "High", "Therapy__drugClass": "C"})
    assert given.backend == "mechanism" and given.predicted == "High"
    one = p.ask("counterfactual", "Therapy__toxicity", {"Therapy__dosage": "High"}, entity="therapy_0" if qa_has(p, "therapy_0") else None, draws=20)
    assert abs(sum(one.distribution.values()) - 1) < 1e-9 and len(p.answers) == 4
    assert qa.entities_meet(p.join().df, p.join().entities, "patient_0", "hospital_0") in (True, False)
    p.exclude("Therapy__toxicity")
    assert not p.runs and not p.answers and "Therapy__toxicity" not in p.join().columns


def qa_has(p, entity):
    try:
        qa.rows_of(p.join().df, p.join().entities, entity)
    except KeyError:
        return False
    return True


def test_priors_and_tables_are_stored(spark, tmp_path):
    from lodestone.operators import neighbourhood
    from lodestone.sources import export

    priors = spark.createDataFrame([("x", "y", 0.4, float("nan")), ("q", "x", 0.9, 0.9)], "i string, j string, m double, b double")
    export.save_priors(priors, str(tmp_path / "p"))
    got = {(r.i, r.j): (r.m, r.b) for r in export.load_priors(spark, str(tmp_path / "p"), ["x", "y"]).collect()}
    assert got == {("x", "y"): (0.4, 0.5), ("y", "x"): (0.5, 0.5)}
    for kind in ("csv", "json", "parquet"):
        export.save(priors.withColumn("l", F.array(F.lit(1))), str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() >= 2
    with pytest.raises(ValueError, match="unknown format"):
        export.save(priors, str(tmp_path / "x"), "xls")
    weights = spark.createDataFrame([(i, float(1 + i % 3)) for i in range(300)], "i int, w double")
    drawn = neighbourhood.resampled(weights, "w", F.col("i"), 600)
    assert abs(drawn.count() - 600) < 40 and set(drawn.columns) == {"i", "w"}
    assert neighbourhood.informative(spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.7), ("a", "a", 1.0)], "i string, j string, value double")).first().n == 1


def test_session_is_stored_and_read_again(spark, clinic, tmp_path):
    from lodestone.sources import export

    triples = simulate.as_triples(clinic).cache()
    schema = inferred_schema(triples)
    p = Project(schema, TripleSource(triples))
    p.discover("HC", ["Therapy__dosage", "Therapy__toxicity"])
    p.add_edge("Therapy__dosage", "Therapy__toxicity")
    p.select([("Therapy__dosage", "Therapy__toxicity")])
    p.ask("condition", "Therapy__toxicity", {"Therapy__dosage": "High"})
    export.save_project(p, str(tmp_path / "s"))
    q = export.load_project(spark, str(tmp_path / "s"), schema, TripleSource(triples))
    assert q.selected == p.selected and q.manual == p.manual and q.queries == p.queries and [g.id for g in q.runs] == [g.id for g in p.runs]
    assert q.ask("condition", "Therapy__toxicity", {"Therapy__dosage": "High"}).distribution == pytest.approx(p.answers[0].distribution)


def test_sessions_answer_for_entities(spark, clinic, tmp_path):
    from lodestone.sources import export

    triples = simulate.as_triples(clinic).cache()
    p = Project(inferred_schema(triples), TripleSource(triples))
    dose, harm, drug = "Therapy__dosage", "Therapy__toxicity", "Therapy__drugClass"
    p.select([(dose, harm), (drug, harm)])
    unit = p.join().df.select("Therapy__iri", drug).orderBy("Therapy__iri").first()
    got = p.ask("intervene", harm, {dose: "High"}, entity=unit[0])
    own = {r[harm]: r.p for r in p.fit()[harm].where((F.col(dose) == "High") & (F.col(drug) == unit[1])).collect()}
    assert got.distribution.keys() == own.keys() and all(abs(got.distribution[k] - own[k]) < 1e-9 for k in own)
    assert got.reaches and not p.ask("intervene", dose, {harm: "High"}).reaches
    for wrong, error in (({"entity": "nobody"}, KeyError), ({"entity": unit[0], "conditions": {drug: "none"}}, ValueError)):
        with pytest.raises(error):
            p.ask("intervene", harm, {dose: "High"}, **wrong)
        with pytest.raises(error):
            p.ask("counterfactual", harm, {dose: "High"}, draws=2, **wrong)
    with pytest.raises(ValueError, match="population"):
        p.ask("condition", harm, {dose: "High"}, entity=unit[0])
    assert p.fit(5.0) is p.fit() and p.fit(500.0) is not p.fit() and abs(p.fit(500.0)[harm].first().p - p.fit()[harm].first().p) > 1e-6
    few = p.ask("counterfactual", harm, {dose: "High"}, {drug: unit[1]}, entity=unit[0], draws=30)
    assert few.n_samples == 30 and abs(sum(few.distribution.values()) - 1) < 1e-9
    before = {a.query: a.distribution for a in p.answers}
    assert {a.query: a.distribution for a in p.replay()} == before and len(p.answers) == len(before) == len(p.queries)
    assert qa.estimand(p.queries[0]) == f"P({harm} | do({dose} = High); {unit[0]})"
    export.save_project(p, str(tmp_path / "s"))
    again = export.load_project(spark, str(tmp_path / "s"), p.schema, p.source)
    assert {a.query: (a.distribution, a.backend, a.reaches) for a in again.answers} == {a.query: (a.distribution, a.backend, a.reaches) for a in p.answers}
    stored = qa.query_table(spark, p.queries)
    assert qa.matching(stored, "counterfactual").count() == 1 and qa.matching(stored, node=drug, value=unit[1]).count() == 1 and qa.matching(stored, node=dose, value="Low").count() == 0


def test_graphs_as_json():
    g = graph()
    again = CausalGraph.from_json(g.to_json())
    assert again.to_json() == g.to_json() and again.id == g.id and again.labels == g.labels and again.manual == g.manual
    with pytest.raises(ValueError):
        CausalGraph.from_json(g.to_json().replace('"GES"', '"PC"'))


def test_a_property_with_two_ranges(spark):
    """Each range has a column and a join of its own; an entity needs a value in both."""
    rows = [("a1", "rdf:type", "A"), ("a1", "to", "b1"), ("a1", "to", "c1"), ("a2", "rdf:type", "A"), ("a2", "to", "b1"), ("b1", "rdf:type", "B"), ("b1", "x", "1"), ("c1", "rdf:type", "C"), ("c1", "y", "2")]
    triples = spark.createDataFrame([(*r, "literal" if r[1] in "xy" else "iri") for r in rows], "s string, p string, o string, o_kind string").cache()
    schema = inferred_schema(triples)
    schema.objects["to"] = [("A", "B"), ("A", "C")]
    nodes = schema.nodes()
    j = flat_join(schema, TripleSource(triples), [n for n in nodes if n.prop in ("x", "y", "to")], [n for n in nodes if n.prop == "to"])
    assert [r.asDict() for r in j.df.collect()] == [{"A__iri": "a1", "B__iri": "b1", "C__iri": "c1", "A__to": "b1", "A__to_2": "c1", "B__x": "1", "C__y": "2"}]


def test_log_likelihood_of_rows(spark):
    from lodestone.operators import cpt, inference

    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("b", None)], "u string, c string")
    network = {"u": [], "c": ["u"]}
    full = df.dropna()
    got = cpt.row_log_likelihood(df, inference.fit(full, network), network).collect()
    assert sorted(round(float(np.exp(r.log_likelihood)), 6) for r in got if r.c) == [0.25, 0.25, 0.5, 0.5] and [r.log_likelihood for r in got if not r.c] == [None]
    whole = cpt.log_likelihood(full, network).first().log_likelihood
    assert abs(sum(r.log_likelihood for r in got if r.c) - whole) < 1e-9
