import numpy as np
import pytest
from latticework.operators import algebra, kernels, numeric, refine
from latticework.plans.parameters import Parameters
from latticework.plans.solver import Solver
from latticework.schema import GENERAL, HERMITIAN, SYMMETRIC, Matrix
from latticework.sources import generators
from pyspark.sql import functions as F


def dense(df, n, m=None):
    out = np.zeros((n, m or n), dtype=complex)
    for r in df.collect():
        out[r[0], r[1]] += complex(r["re"], r["im"])
    return out


def rhs(spark, b):
    b = np.atleast_2d(b.T).T if b.ndim == 1 else b
    return spark.createDataFrame([(i, k, float(b[i, k].real), float(b[i, k].imag)) for i in range(len(b)) for k in range(b.shape[1])], "i long, k int, re double, im double")


def matrix(spark, a, kind):
    keep = a != 0 if kind == GENERAL else (a != 0) & np.tril(np.ones_like(a, dtype=bool))
    rows = [(int(i), int(j), float(a[i, j].real), float(a[i, j].imag)) for i, j in zip(*np.nonzero(keep))]
    return Matrix(spark.createDataFrame(rows, "i long, j long, re double, im double"), len(a), kind, "Complex64" if np.iscomplexobj(a) else "Double")


def sample(kind, n=24, seed=0):
    r = np.random.RandomState(seed)
    a = (r.rand(n, n) < 0.1) * r.randn(n, n)
    if kind in ("LLH", "LDLH") or kind.endswith("c"):
        a = a + 1j * (r.rand(n, n) < 0.1) * r.randn(n, n)
    if kind == "LU":
        return a + np.diag(np.abs(a).sum(axis=1) + 1) , GENERAL
    if kind in ("LLH", "LDLH"):
        a = a + a.conj().T
        a[np.arange(n), np.arange(n)] = (np.abs(a).sum(axis=1) + 1) * (1 if kind == "LLH" else np.where(np.arange(n) % 3, 1, -1))
        return a, HERMITIAN
    a = a + a.T
    a[np.arange(n), np.arange(n)] = (np.abs(a).sum(axis=1) + 1) * (1 if kind.startswith("LLT") else np.where(np.arange(n) % 3, 1, -1))
    return a, SYMMETRIC


@pytest.mark.parametrize("kind,limit", [("LLT", 1000), ("LLT", 4), ("LDLT", 1000), ("LU", 6), ("LLH", 1000), ("LDLH", 5), ("LDLTc", 1000)])
def test_factorizations(spark, kind, limit):
    a, shape = sample(kind)
    s = Solver(matrix(spark, a, shape), Parameters(factorization=kind.rstrip("c"), limit=limit))
    x0 = np.random.RandomState(1).randn(len(a), 2)
    x = dense(s.solve(rhs(spark, a @ x0)), len(a), 2)
    assert np.abs(x - x0).max() < 1e-9
    assert s.factorize().replaced == 0


def test_transposed(spark):
    a, shape = sample("LU", seed=4)
    s = Solver(matrix(spark, a, shape), Parameters(limit=8))
    x0 = np.arange(len(a), dtype=float)
    assert np.abs(dense(s.solve(rhs(spark, a.T @ x0), trans="Trans"), len(a), 1)[:, 0] - x0).max() < 1e-8


def test_schur(spark):
    a, shape = sample("LLT", seed=2)
    n, listed = len(a), [3, 7, 20, 21]
    s = Solver(matrix(spark, a, shape), Parameters(factorization="LLT"), schur=spark.createDataFrame([(v,) for v in listed], "i long"))
    rest = [v for v in range(n) if v not in listed]
    want = a[np.ix_(listed, listed)] - a[np.ix_(listed, rest)] @ np.linalg.solve(a[np.ix_(rest, rest)], a[np.ix_(rest, listed)])
    got = dense(s.schur(), len(listed))
    assert np.abs(got - want).max() < 1e-10
    x0 = np.random.RandomState(3).randn(n)
    y = s.schur_forward(rhs(spark, a @ x0))
    part = dense(y, n, 1)[:, 0].copy()
    part[listed] = np.linalg.solve(want, part[listed])
    assert np.abs(dense(s.schur_backward(rhs(spark, part)), n, 1)[:, 0] - x0).max() < 1e-9


def test_static_pivots_and_refinement(spark):
    a = np.array([[0.0, 1.0, 0.0], [1.0, 2.0, 1.0], [0.0, 1.0, 3.0]])
    s = Solver(matrix(spark, a, GENERAL), Parameters(ordering="Identity", epsilon=1e-6, refinement="GMRES", amalgamation=0))
    b = rhs(spark, a @ np.ones(3))
    x = s.solve(b, refined=True)
    assert s.factorize().replaced >= 1
    assert np.abs(dense(x, 3, 1)[:, 0] - 1).max() < 1e-9


@pytest.mark.parametrize("method", ["CG", "GMRES", "BiCGSTAB", "SR"])
def test_refinement(spark, method):
    m = generators.laplacian(spark, 4, 4, 2, alpha=2.0)
    a = dense(algebra.full(m), m.n)
    b = rhs(spark, a.real @ np.arange(m.n))
    s = Solver(m, Parameters(refinement=method, refine_epsilon=1e-9, mixed=True), definite=True)
    x = s.solve(b, refined=True)
    assert np.abs(dense(x, m.n, 1)[:, 0] - np.arange(m.n)).max() < 1e-5 and s.log.error < 1e-8


def test_cg_without_preconditioner(spark):
    m = generators.laplacian(spark, 5, 5, alpha=2.0)
    a = dense(algebra.full(m), m.n).real
    b = rhs(spark, a @ np.ones(m.n)).select("i", "re", "im")
    r = refine.cg(refine.matvec(algebra.full(m)), b, eps=1e-8)
    assert r.error <= 1e-8 and r.iterations <= 25


@pytest.mark.parametrize("when,method,kind,limit,tolerance,bound", [("JustInTime", "SVD", "LLT", 10_000, 0.02, 0.5), ("MinimalMemory", "PQRCP", "LU", 60, 1e-5, 1e-2), ("MinimalMemory", "RQRCP", "LDLH", 10_000, 1e-5, 1e-2)])
def test_low_rank_factors(spark, when, method, kind, limit, tolerance, bound):
    m = generators.laplacian(spark, 20, 18, alpha=2.0, hermitian=kind == "LDLH")
    a = dense(algebra.full(m), m.n)
    x0 = np.random.RandomState(1).randn(m.n, 2)
    options = {"factorization": kind, "limit": limit, "compress_method": method, "compress_least_width": 6, "compress_least_height": 4}
    s = Solver(m, Parameters(compress_when=when, compress_tolerance=tolerance, **options))
    error = np.abs(dense(s.solve(rhs(spark, a @ x0)), m.n, 2) - x0).max()
    assert error < bound
    assert any(0 < r["rank"] < min(r.m, r.n) for r in s.factorize().ranks.collect())
    if kind == "LU":
        assert np.abs(dense(s.solve(rhs(spark, a.T @ x0), trans="Trans"), m.n, 2) - x0).max() < bound


def test_vertices_of_several_unknowns_are_ordered_together(spark):
    m = generators.with_dofs(generators.laplacian(spark, 4, 4, alpha=2.0), 3)
    a = dense(algebra.full(m), m.n).real
    s = Solver(m, Parameters(factorization="LLT"))
    x0 = np.arange(m.n, dtype=float)
    assert np.abs(dense(s.solve(rhs(spark, a @ x0)), m.n, 1)[:, 0] - x0).max() < 1e-8


def test_gmres_steps_take_as_many_jobs_whatever_the_basis(spark):
    m = generators.laplacian(spark, 6, 6, alpha=2.0)
    b = rhs(spark, np.arange(36, dtype=float)).select("i", "re", "im")
    a, seen = refine.matvec(algebra.full(m)), []
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("gmres", "steps")

    def counting(v):
        seen.append(len(tracker.getJobIdsForGroup("gmres")))
        return a(v)

    out = refine.gmres(counting, b, eps=1e-8, most=12)
    spark.sparkContext.setJobGroup("other", "")
    steps = np.diff(seen)[1:-1]
    assert out.iterations >= 8 and steps.max() - steps.min() <= 2, steps


def test_tasks_saving_and_isolated_unknowns(spark, tmp_path):
    m = generators.laplacian(spark, 4, 3, alpha=2.0)
    x0, b = generators.right_hand_side(m, 2, 39)
    want = dense(x0, m.n, 2)
    s = Solver(m, Parameters(factorization="LDLT", refinement="SR"), isolate=spark.createDataFrame([(2,), (7,)], "i long"))
    for start, end in (("Solve", "Solve"), ("Refine", "Clean"), ("Analyze", "Ordering")):
        with pytest.raises(ValueError):
            s.run(start, end, b)
    with pytest.raises(ValueError):
        s.run("Init", "Solve")
    assert s.run("Init", "Factorize") is None
    late = {r.i for r in s.analysis.ordering.where("perm >= 10").collect()}
    assert late == {2, 7}
    assert np.abs(dense(s.run("Solve", "Refine", b), m.n, 2) - want).max() < 1e-9
    s.save(str(tmp_path / "solver"))
    assert np.abs(dense(Solver.load(spark, str(tmp_path / "solver")).run("Solve", "Solve", b), m.n, 2) - want).max() < 1e-9
    s.run("Clean", "Clean")
    assert s.factor is None and generators.right_hand_side(m, known=False)[0] is None


def test_segments_of_the_schur_unknowns(spark):
    s = Solver(generators.laplacian(spark, 4, 1, alpha=2.0), schur=spark.createDataFrame([(3,), (1,)], "i long"))
    y = spark.createDataFrame([(i, 0, float(i), 0.0) for i in range(4)], "i long, k int, re double, im double")
    assert sorted((r.i, r.re) for r in s.schur_values(y).collect()) == [(0, 1.0), (1, 3.0)]
    new = spark.createDataFrame([(0, 0, 7.0, 0.0), (1, 0, 8.0, 0.0)], "i long, k int, re double, im double")
    assert sorted((r.i, r.re) for r in s.with_schur_values(y, new).collect()) == [(0, 0.0), (1, 7.0), (2, 2.0), (3, 8.0)]


@pytest.mark.parametrize("seed", range(3))
def test_groups_of_a_cut_tree(seed):
    """Groups are connected, hold no more than they may, and come after those below them; a chain of small fronts is one."""
    draw = np.random.RandomState(seed)
    n, limit, room = 300, 12, 400
    parent = [min(n - 1, k + 1 + int(draw.exponential(6))) for k in range(n)]
    width, entries = draw.randint(1, 5, n).tolist(), draw.randint(1, 200, n).tolist()
    top, stage = kernels.cut_tree(parent, width, entries, limit, room)
    for k in range(n):
        assert top[k] == k or (top[parent[k]] == top[k] and stage[parent[k]] == stage[k])
        assert top[k] != k or parent[k] == k or stage[parent[k]] > stage[k]
    for t in set(top):
        of = [k for k in range(n) if top[k] == t]
        assert len(of) == 1 or sum(width[k] for k in of) <= limit and (stage[t] == 0 or sum(entries[k] for k in of) <= room)
    chain = [*range(1, 50), 49]
    assert max(kernels.cut_tree(chain, [30] + [1] * 49, [1] * 50, 29, 100)[1]) == 3


@pytest.mark.parametrize("nodes", [0, 1_000_000])
def test_solution_with_groups_above_the_subtrees(spark, monkeypatch, nodes):
    monkeypatch.setattr(numeric, "NODES", nodes)
    a = generators.laplacian(spark, 14, 12, alpha=2.0)
    x = spark.range(a.n).select(F.col("id").alias("i"), F.lit(0).alias("k"), (F.col("id") % 5 + 1.0).alias("re"), F.lit(0.0).alias("im"))
    s = Solver(a, Parameters(factorization="LLT", limit=20, amalgamation=0.0))
    got = {r.i: r.re for r in s.solve(algebra.spmv(algebra.full(a), x)).collect()}
    assert max(abs(got[i] - (i % 5 + 1.0)) for i in range(a.n)) < 1e-9
    assert s.analysis.stages > 1 and (s.analysis.stages <= 5 or not nodes)


def test_steps_send_only_small_tables_through_the_driver(spark, monkeypatch):
    key, seen = "spark.sql.autoBroadcastJoinThreshold", []
    before = spark.conf.get(key)
    monkeypatch.setattr(numeric, "analyze", lambda *a: seen.append(spark.conf.get(key)))
    monkeypatch.setattr(numeric, "factorize", lambda *a: seen.append(spark.conf.get(key)))
    s = Solver(generators.laplacian(spark, 3, 3))
    try:
        for allowed, want in ((before, "262144"), ("10m", "262144"), ("100k", "100k"), ("-1", "-1")):
            spark.conf.set(key, allowed)
            s.analysis = s.factor = None
            s.factorize()
            assert seen == [want] * 2 and spark.conf.get(key) == allowed
            seen.clear()
    finally:
        spark.conf.set(key, before)
