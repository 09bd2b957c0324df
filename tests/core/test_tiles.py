import numpy as np
import pytest
from latticework.operators import algebra, multilevel, numeric, ordering, tiles
from latticework.operators.lineage import cut
from latticework.plans.parameters import Parameters
from latticework.plans.solver import Solver
from latticework.schema import GENERAL, HERMITIAN, SYMMETRIC, Matrix
from latticework.sources import generators
from pyspark.sql import functions as F


def random_front(n, kind, seed):
    """A dense matrix whose leading part can be eliminated without pivoting."""
    draw = np.random.RandomState(seed)
    a = draw.randn(n, n) + (1j * draw.randn(n, n) if kind in ("LLH", "LDLH", "LDLT") else 0)
    if kind in ("LLH", "LDLH"):
        a = a @ a.conj().T
    elif kind != "LU":
        a = a + a.T
    return a + 4 * n * np.eye(n)


def rows_of(a, symmetric):
    n = len(a)
    return [(7, i, j, float(a[i, j].real), float(a[i, j].imag)) for i in range(n) for j in range(n) if not symmetric or i >= j]


@pytest.mark.parametrize("kind", ["LLT", "LDLT", "LU", "LLH", "LDLH"])
def test_what_remains_is_the_schur_complement(spark, kind):
    n, w, is_complex = 23, 11, kind in ("LLH", "LDLH", "LDLT")
    a = random_front(n, kind, 3)
    if kind == "LLT":
        a = a.real
    nodes = spark.createDataFrame([(0, 7, 7, 0, w - 1, list(range(w, n)))], "stage int, grp long, k long, first long, last long, rows array<long>")
    at = cut(tiles.places(nodes, 4))
    entries = spark.createDataFrame(rows_of(a, kind != "LU"), "grp long, i long, j long, re double, im double")
    front = tiles.fronts(entries, nodes, at, 4, kind != "LU", is_complex)
    assert front.count() == (36 if kind == "LU" else 21)  # 3 tiles of columns, 3 of rows
    found, rest, corners = tiles.factorize(front, 3, kind, 0.0, is_complex)
    got = np.zeros((n, n), dtype=complex)
    for r in tiles.left_over(rest, corners, at, kind != "LU", is_complex).where("part = 'C'").collect():
        got[r.i, r.j] = r.re + 1j * r.im
    want = a[w:, w:] - a[w:, :w] @ np.linalg.solve(a[:w, :w], a[:w, w:])
    if kind != "LU":
        want = np.tril(want)
    assert np.abs(got[w:, w:] - want).max() < 1e-10
    assert not got[:w].any() and not got[:, :w].any()
    assert found.count() == 6 + 9  # within the columns, and below


def known(spark, a):
    x = spark.range(a.n).select(F.col("id").alias("i"), F.explode(F.array(F.lit(0), F.lit(3))).alias("k"), (F.col("id") % 5 + 1.0 + F.col("k")).alias("re"), F.lit(0.0).alias("im"))
    return x, algebra.spmv(algebra.full(a), x)


def unlike(got, a):
    return max(abs(r.re - (r.i % 5 + 1.0 + r.k)) + abs(r.im) for r in got)


@pytest.mark.parametrize("kind,trans", [("LLT", "NoTrans"), ("LU", "Trans"), ("LDLH", "NoTrans")])
def test_solutions_with_fronts_in_tiles(spark, kind, trans):
    hermitian = kind in ("LLH", "LDLH")
    a = generators.laplacian(spark, 10, 9, alpha=2.0, hermitian=hermitian)
    if kind == "LU":
        full = algebra.full(a)
        a = Matrix(full.withColumn("re", F.col("re") + 0.1 * (F.col("i") < F.col("j")).cast("double")), a.n, GENERAL)
    x, _ = known(spark, a)
    b = algebra.spmv(algebra.operand(a, trans), x)
    s = Solver(a, Parameters(factorization=kind, limit=30, front=12, tile=5, leaf=6))
    got = s.solve(b, trans=trans).collect()
    assert s.factor.tiled is not None and max(s.factor.tiled.steps.values()) > 1
    assert len(got) == 2 * a.n and unlike(got, a) < 1e-9


def test_dense_matrix_is_one_front(spark, tmp_path):
    """A clique under the limit of a group still goes by tiles; its factor can be saved and loaded."""
    n = 30
    full = random_front(n, "plain", 5)
    rows = [(i, j, float(full[i, j]), 0.0) for i in range(n) for j in range(i + 1)]
    a = Matrix(cut(spark.createDataFrame(rows, "i long, j long, re double, im double")), n, SYMMETRIC)
    _, b = known(spark, a)
    s = Solver(a, Parameters(factorization="LDLT", front=20, tile=8))
    assert unlike(s.solve(b).collect(), a) < 1e-9
    tile = s.factor.tiled.tiles.select("a", "b", F.length("low").alias("bytes")).collect()
    assert {(r.a, r.b) for r in tile} == {(x, y) for x in range(4) for y in range(x + 1)}
    assert max(r.bytes for r in tile) == 8 * 8 * 8
    assert s.factor.lower.count() == 0  # nothing of it is in single entries
    s.save(str(tmp_path / "factor"))
    assert unlike(Solver.load(spark, str(tmp_path / "factor")).solve(b).collect(), a) < 1e-9


def test_pivots_are_replaced_in_tiles(spark):
    n = 12
    rows = [(i, j, 1.0 if i == j and i != 7 else 0.0, 0.0) for i in range(n) for j in range(i + 1)]
    rows = [(i, j, re if i != j or i != 7 else 1e-30, im) for i, j, re, im in rows if i == j] + [(i, 0, 1e-3, 0.0) for i in range(1, n)]
    nodes = spark.createDataFrame([(0, 0, 0, 0, n - 1, [])], "stage int, grp long, k long, first long, last long, rows array<long>")
    at = cut(tiles.places(nodes, 5))
    entries = spark.createDataFrame([(0, i, j, re, im) for i, j, re, im in rows if i != 7 or j == 7], "grp long, i long, j long, re double, im double")
    _, rest, corners = tiles.factorize(tiles.fronts(entries, nodes, at, 5, True, False), 3, "LDLT", 1e-8, False)
    assert corners.agg(F.sum("fixed")).first()[0] == 1
    assert rest.count() == 0


@pytest.mark.parametrize("kind", ["LDLT", "LU", "LLH"])
def test_columns_of_tiles_go_together(spark, monkeypatch, kind):
    """Steps are as many as blocks of tiles, and leave the tiles that single columns of tiles leave."""
    monkeypatch.setattr(tiles, "TILE", 12)
    n, w, is_complex = 41, 27, kind == "LLH"
    a = random_front(n, "LLH" if is_complex else "plain", 8)
    nodes = spark.createDataFrame([(0, 7, 7, 0, w - 1, list(range(w, n)))], "stage int, grp long, k long, first long, last long, rows array<long>")
    at = cut(tiles.places(nodes, 4))
    entries = spark.createDataFrame(rows_of(a, kind != "LU"), "grp long, i long, j long, re double, im double")
    front = cut(tiles.fronts(entries, nodes, at, 4, kind != "LU", is_complex))
    assert tiles.together(4) == 3
    made = []
    for together in (1, 3):
        written = []
        with monkeypatch.context() as m:
            m.setattr(tiles, "cut", lambda df, what="cut", written=written: written.append(what) or cut(df, what))
            found, rest, corners = tiles.factorize(front, 7, kind, 0.0, is_complex, together)
        assert written.count("panel") == (7 if together == 1 else 3)
        values = {(r.a, r.b): np.concatenate([np.frombuffer(x) for x in (r.low, r.up) if x is not None]) for r in found.collect()}
        values |= {(-1, r.s): np.frombuffer(r.d) for r in corners.where("d is not null").collect()}
        values |= {(r.i, r.j, "C"): np.array([r.re, r.im]) for r in tiles.left_over(rest, corners, at, kind != "LU", is_complex).where("part = 'C'").collect()}
        made.append(values)
    assert made[0].keys() == made[1].keys() and len(made[0]) > 40
    assert max(np.abs(made[0][x] - made[1][x]).max() for x in made[0]) < 1e-10


@pytest.mark.parametrize("kind", ["LLT", "LDLH", "LU"])
def test_dense_graphs_are_analysed_by_classes(spark, monkeypatch, kind):
    """Cliques that hang on a common vertex: four classes are dissected, whatever their members' number; no task walks a component."""
    monkeypatch.setattr(numeric, "DENSE", 8)
    monkeypatch.setattr(ordering, "elimination", lambda *a, **k: pytest.fail("a component is walked"))
    members = [[v for v in range(60) if v % 3 == c] for c in range(3)]
    pairs = {(max(a, b), min(a, b)) for m in members for a in m for b in m if a != b} | {(60, v) for v in range(0, 60, 3)} | {(60, v) for v in range(1, 60, 3)}
    rows = [(i, j, 1.0 + (i + j) % 3, 0.25 * ((i * j) % 5) if kind == "LDLH" else 0.0) for i, j in sorted(pairs)] + [(v, v, 200.0, 0.0) for v in range(61)]
    a = Matrix(cut(spark.createDataFrame(rows, "i long, j long, re double, im double")), 61, HERMITIAN if kind == "LDLH" else SYMMETRIC)
    if kind == "LU":
        a = Matrix(cut(algebra.full(a).withColumn("re", F.col("re") + 0.5 * (F.col("i") < F.col("j")).cast("double"))), 61, GENERAL)
    seen, whole = [], multilevel.dissection
    monkeypatch.setattr(multilevel, "dissection", lambda edges, vertices, *rest: seen.append(vertices.count()) or whole(edges, vertices, *rest))
    _, b = known(spark, a)
    s = Solver(a, Parameters(factorization=kind))
    assert unlike(s.solve(b).collect(), a) < 1e-9
    assert seen == [4] and ordering.check(s.analysis.ordering).first() == (61, True)
    assert sorted(r["last"] - r["first"] + 1 for r in s.analysis.tree.collect())[-1] >= 20
