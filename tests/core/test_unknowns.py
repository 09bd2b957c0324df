import duckdb
import numpy as np
import pytest
from latticework.operators import algebra, layout, ordering, symbolic
from latticework.plans import catalog, tables  # noqa: F401
from latticework.plans.parameters import Parameters
from latticework.plans.solver import Solver
from latticework.sources import generators
from pyspark.sql import functions as F

from .. import TABLES, TINY
from .test_catalog import rows


def dense(coo, n):
    a = np.zeros((n, n))
    for r in coo.collect():
        a[r.i, r.j] += r.re
    return a


def test_matrix_and_solution_of_uneven_vertices(spark, tmp_path):
    a = generators.laplacian(spark, 4, 3, alpha=2.0)
    dof = [k % 4 for k in range(12)]  # some vertices have no unknown
    dofs = layout.offsets(spark.createDataFrame(list(enumerate(dof)), "i long, dof long")).cache()
    assert [(r.begin, r.end) for r in dofs.orderBy("i").collect()] == [(sum(dof[:k]), sum(dof[: k + 1])) for k in range(12)]
    m = generators.with_variable_dofs(a, dofs)
    keep = [4 * k + t for k in range(12) for t in range(dof[k])]
    b = np.full((4, 4), 1 / 6) + (1 - 1 / 6) * np.eye(4)
    full = np.kron(dense(algebra.full(a), 12), b)[np.ix_(keep, keep)]
    assert m.n == len(keep) and np.allclose(dense(algebra.full(m), m.n), full)
    x0 = np.arange(m.n) + 1.0
    rhs = spark.createDataFrame([(k, 0, float(v), 0.0) for k, v in enumerate(full @ x0)], "i long, k int, re double, im double")
    s = Solver(m, Parameters(factorization="LLT"))
    x = {r.i: r.re for r in s.solve(rhs).collect()}
    assert np.allclose([x[k] for k in range(m.n)], x0)
    # unknowns of a vertex stay together in the order before the tree is numbered
    place = {r.i: r.perm for r in s._vertex_order().collect()}
    assert sorted(place.values()) == list(range(m.n))
    for k in range(12):
        of = [place[u] for u in range(sum(dof[:k]), sum(dof[: k + 1]))]
        assert of == list(range(of[0], of[0] + len(of))) if of else True


def test_many_vertices_are_analysed_by_parts(spark, monkeypatch):
    """No task walks the whole component of unknowns, and supernodes are those of the vertices."""
    a = generators.laplacian(spark, 9, 8, alpha=2.0)
    dofs = layout.offsets(spark.createDataFrame([(k, k % 4) for k in range(72)], "i long, dof long")).cache()
    m = generators.with_variable_dofs(a, dofs)
    monkeypatch.setattr(ordering, "elimination", lambda *a, **k: pytest.fail("the component is one task"))
    x = spark.range(m.n).select(F.col("id").alias("i"), F.lit(0).alias("k"), (F.col("id") % 7 + 1.0).alias("re"), F.lit(0.0).alias("im"))
    s = Solver(m, Parameters(factorization="LLT", share=30, limit=30))
    got = {r.i: r.re for r in s.solve(algebra.spmv(algebra.full(m), x)).collect()}
    assert len(got) == m.n and max(abs(got[i] - (i % 7 + 1.0)) for i in got) < 1e-9
    assert ordering.check(s.analysis.ordering).first() == (m.n, True)


def test_blocks_of_vertices_without_unknowns_vanish(spark):
    dofs = layout.offsets(spark.createDataFrame([(0, 2), (1, 0), (2, 3)], "i long, dof long"))
    blok = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 1, 1), (0, 2, 2, 2)], "k long, first_row long, last_row long, facing long")
    assert sorted(tuple(r) for r in symbolic.expand_blocks_by(blok, dofs).collect()) == [(0, 0, 1, 0), (0, 2, 4, 2)]


@pytest.mark.parametrize("name", ["mesh_unknowns", "mesh_blocks_unknowns", "mesh_solution_unknowns"])
def test_queries(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, TINY)
    got, cur = df.collect(), con.execute(catalog.SQL[name])
    assert rows(df.columns, got) == rows([d[0] for d in cur.description], cur.fetchall())
