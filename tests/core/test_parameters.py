import pytest
from latticework.operators import numeric, symbolic
from latticework.plans.parameters import Parameters
from latticework.plans.solver import Solver
from latticework.sources import generators


def test_settings_are_honoured_or_refused(spark, monkeypatch):
    m = generators.laplacian(spark, 4, 4, alpha=2.0)
    for name in ("Grid", "Personal"):
        with pytest.raises(ValueError):
            Solver(m, Parameters(ordering=name))
        Solver(m, Parameters(ordering=name), order=spark.range(16).selectExpr("id as i", "15 - id as perm"))
    seen, dissection = [], numeric.ordering.nested_dissection
    monkeypatch.setattr(numeric.ordering, "nested_dissection", lambda edges, labels, leaf=24: (seen.append(leaf), dissection(edges, labels, leaf))[1])
    Solver(m, Parameters(leaf=3)).analyze()
    assert seen == [3]


def test_united_columns(spark):
    entries = [(5, 0), (7, 0), (5, 1), (9, 1), (9, 2), (5, 0), (1, 3)]
    nodes = {0: 0, 1: 0, 2: 1, 3: 1}
    got = symbolic.united_columns(spark.createDataFrame(entries, "i long, j long"), spark.createDataFrame(list(nodes.items()), "j long, k long")).collect()
    assert sorted((r.k, r.i) for r in got) == sorted({(nodes[j], i) for i, j in entries})
