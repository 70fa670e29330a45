import io
import json

import pytest

from lodestone import experiments
from lodestone.__main__ import main
from lodestone.plans.schema import inferred_schema
from lodestone.project import Project
from lodestone.sources import ntriples, simulate

DOSE, HARM, DRUG = "Therapy__dosage", "Therapy__toxicity", "Therapy__drugClass"


@pytest.fixture(scope="module")
def triples(spark):
    return simulate.as_triples(simulate.clinic(spark, patients=200, hospitals=8)).cache()


def test_methods_are_compared(spark, triples, tmp_path):
    p = Project(inferred_schema(triples), ntriples.TripleSource(triples))
    out = experiments.run(p, ["HC", "GES", "PC"], [DOSE, HARM, DRUG], truth=[(DOSE, HARM), (DRUG, HARM)], folder=str(tmp_path))
    rows = {(r.method, r.constrained): r for r in out.collect()}
    assert len(rows) == 6 and len(p.runs) == sum(r.status == "done" for r in rows.values())
    done = rows["GES", True]
    assert done.status == "done" and done.edges == done.tp + done.fp and done.fn + done.tp == 2 and 0 <= done.validity <= 1 and done.seconds > 0
    graphs = ntriples.parse(spark.read.option("recursiveFileLookup", True).text(str(tmp_path)))
    from lodestone.operators.causal_graph import graphs_in

    assert graphs_in(graphs).select("method").distinct().count() == len({m for (m, _), r in rows.items() if r.status == "done"})
    assert experiments.run(p, ["GES"], [DOSE, "gone"], (True,)).first().status.startswith(("KeyError", "ValueError"))


def test_command_line(spark, triples, tmp_path):
    ntriples.write(triples, str(tmp_path / "t"))
    out = io.StringIO()
    session = str(tmp_path / "s")
    main(["discover", str(tmp_path / "t"), "--session", session, "--method", "GES", "--columns", f"{DOSE},{HARM}"], spark, out)
    found, chosen = map(json.loads, out.getvalue().splitlines())
    assert found["method"] == "GES" and found["status"] == "done" and chosen["selected"]
    (cause, effect), = chosen["selected"][:1]
    out = io.StringIO()
    main(["ask", str(tmp_path / "t"), "--session", session, "--kind", "intervene", "--target", effect, "--set", f"{cause}=High"], spark, out)
    answer = json.loads(out.getvalue())
    assert abs(sum(answer["distribution"].values()) - 1) < 1e-9 and answer["reaches"]
    with pytest.raises(SystemExit):
        main(["ask", str(tmp_path / "t"), "--session", session, "--kind", "intervene", "--target", effect, "--set", "no value"], spark, out)
    out = io.StringIO()
    main(["graphs", f"{session}/runs/0000"], spark, out)
    assert json.loads(out.getvalue())["method"] == "GES"


def test_vocabulary_names_all_that_graphs_use(spark, triples):
    p = Project(inferred_schema(triples), ntriples.TripleSource(triples))
    g = p.discover("HC", [DOSE, HARM])
    known = experiments.vocabulary_triples(spark)
    used = g.triples(spark).where("p NOT LIKE 'rdf:%'").select("p").distinct()
    assert used.join(known.selectExpr("s AS p"), "p", "left_anti").count() == 0 and known.select("s", "p").distinct().count() == known.count()
