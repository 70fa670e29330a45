import numpy as np
import pytest

from lodestone.plans import graphs
from lodestone.plans.constraint import constraint, label_text, parse_label, relation_paths
from lodestone.plans.flat_join import DisconnectedJoin, components, flat_join
from lodestone.plans.schema import PropertyNode, Schema, inferred_schema, unique_names
from lodestone.sources import ntriples
from lodestone.sources.mapped import TABLES, MappedSource


def toy() -> Schema:
    s = Schema({"A", "B", "C"})
    for p, d in (("a1", "A"), ("a2", "A"), ("b1", "B"), ("c1", "C")):
        s.data[p].append((d, "string"))
    s.objects["r"].append(("A", "B"))
    return s


def test_constraint_of_three_classes():
    c = constraint(toy(), [n for n in toy().nodes() if n.kind == "data"])
    assert c.names == ["A__a1", "A__a2", "B__b1", "C__c1"]
    assert c.stats() == {"possible": 12, "allowed": 6, "forbidden": 6, "pruning": 0.5}
    assert [label_text(p) for p in c.labels["B__b1", "A__a1"]] == ["^r"]
    assert len(c.forbidden()) + len(c.white_list()) == 12
    assert parse_label("^r/q") == (("r", "inverse"), ("q", "forward"))
    assert (c.subset(["A__a1", "B__b1"]).allowed == [[False, True], [True, False]]).all()


def test_paths_respect_hops_and_direction():
    s = toy()
    s.objects["q"].append(("B", "C"))
    assert relation_paths(s, "A", "C") == []
    assert relation_paths(s, "A", "C", hops=2) == [(("r", "forward"), ("q", "forward"))]
    assert relation_paths(s, "C", "A", hops=2, inverse=False) == []
    assert relation_paths(s, "A", "A", hops=3) == []


def test_names_are_unique():
    names = unique_names([PropertyNode("A", "p", "x"), PropertyNode("A", "p", "y")])
    assert sorted(names.values()) == ["A__p", "A__p_2"]


def test_groups_without_links_are_refused(spark, sf):
    source = MappedSource(spark, sf, {c: TABLES[c] for c in ("Part", "Region")})
    from lodestone.plans.schema import mapped_schema

    schema = mapped_schema(source)
    nodes = [n for n in schema.nodes() if n.prop in ("p_brand", "r_name")]
    with pytest.raises(DisconnectedJoin):
        flat_join(schema, source, nodes)
    assert flat_join(schema, source, nodes, limit=7).df.count() == 7
    assert components({"A", "B", "C"}, [PropertyNode("A", "r", "B", "object")]) == [{"A", "B"}, {"C"}]


def test_triples_and_tables_give_the_same_join(spark, sf):
    """The same classes read as triples, with the schema inferred from them, join to the same rows."""
    tables = MappedSource(spark, sf, {c: TABLES[c] for c in ("Nation", "Region")})
    triples = tables.triples("Nation").unionByName(tables.triples("Region"))
    schema = inferred_schema(triples)
    assert schema.relations() == [("Nation", "n_regionkey", "Region")]
    nodes = [n for n in schema.nodes() if n.kind == "data"]
    got = flat_join(schema, ntriples.TripleSource(triples), nodes).df.select("Nation__n_name", "Region__r_name").collect()
    from lodestone.plans.schema import mapped_schema

    s = mapped_schema(tables)
    wanted = flat_join(s, tables, [n for n in s.nodes() if n.kind == "data"]).df.select("Nation__n_name", "Region__r_name").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, wanted)) and got


def test_multi_valued_properties_expand_rows(spark):
    rows = [("x", "rdf:type", "A", "iri"), ("x", "v", "1", "literal"), ("x", "v", "2", "literal"), ("x", "w", "3", "literal"), ("y", "rdf:type", "A", "iri"), ("y", "v", "9", "literal")]
    t = spark.createDataFrame(rows, "s string, p string, o string, o_kind string")
    schema = inferred_schema(t)
    nodes = schema.nodes()
    assert sorted(map(tuple, flat_join(schema, ntriples.TripleSource(t), nodes).df.collect())) == [("x", "1", "3"), ("x", "2", "3")]
    assert flat_join(schema, ntriples.TripleSource(t), nodes, optional=True).df.count() == 3


def test_ntriples_round_trip(spark, tmp_path):
    text = ['<http://x/s> <http://x/p> "a \\"q\\" \\\\ line\\n\\u00e9"^^<http://x/t> .', '_:b <http://x/p> "v"@en-GB .', "# note", "", "<http://x/s> <http://x/p> <http://x/o> <http://x/g> .", "<http://x/s> <http://x/p> <http://x/o> <http://x/g> ."]
    lines = spark.createDataFrame([(x,) for x in text], "value string")
    one = ntriples.parse(lines)
    assert one.count() == 3
    ntriples.write(one, str(tmp_path / "t"))
    assert sorted(map(tuple, ntriples.read(spark, str(tmp_path / "t")).collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    with pytest.raises(Exception, match="no triple"):
        ntriples.parse(spark.createDataFrame([("broken",)], "value string")).collect()
    assert ntriples.parse(spark.createDataFrame([("broken",)], "value string"), strict=False).count() == 0


def test_graph_tools():
    chain = np.array([[0, 1, 0], [0, 0, 1], [0, 0, 0]], bool)
    assert graphs.find_cycle(chain) == []
    loop = chain.copy()
    loop[2, 0] = True
    assert sorted(graphs.find_cycle(loop)) == [0, 1, 2]
    with pytest.raises(ValueError, match="cycle"):
        graphs.to_dag(loop)
    assert (graphs.to_dag(loop, np.array([[0, 3, 0], [0, 0, 2], [1, 0, 0]])) == chain).all()
    assert (graphs.dag_to_cpdag(chain) == (chain | chain.T)).all()
    collider = np.array([[0, 0, 1], [0, 0, 1], [0, 0, 0]], bool)
    assert (graphs.dag_to_cpdag(collider) == collider).all()
    assert graphs.reaches(chain, 0, 2) and not graphs.reaches(chain, 2, 0)
    back = graphs.pdag_to_dag(chain | chain.T)
    assert back is not None and (graphs.dag_to_cpdag(back) == (chain | chain.T)).all()
