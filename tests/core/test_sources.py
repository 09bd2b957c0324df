import numpy as np
import pytest
from latticework.operators import algebra, graph, kernels, ordering
from latticework.plans.parameters import Parameters, name_of, parse
from latticework.schema import GENERAL, HERMITIAN, SYMMETRIC
from latticework.sources import files, generators


def entries(m):
    return sorted((r.i, r.j, r.re, r.im) for r in m.coo.collect())


def test_matrix_market(spark, tmp_path):
    path = tmp_path / "a.mtx"
    path.write_text("%%MatrixMarket matrix coordinate complex Hermitian\n% a comment\n3 3 4\n1 1 2.5 0\n2 1 -.5 1e+00\n 3 2  .25 -2\n3 3 1 0\n")
    m = files.read(spark, "mm", str(path))
    assert (m.n, m.kind, m.arithmetic) == (3, HERMITIAN, "Complex64")
    assert entries(m) == [(0, 0, 2.5, 0.0), (1, 0, -0.5, 1.0), (2, 1, 0.25, -2.0), (2, 2, 1.0, 0.0)]
    full = {(r.i, r.j): complex(r.re, r.im) for r in algebra.full(m).collect()}
    assert full[0, 1] == full[1, 0].conjugate()
    path.write_text("%%MatrixMarket matrix coordinate pattern symmetric\n2 2 2\n1 1\n2 1\n")
    p = files.read(spark, "mm", str(path))
    assert p.arithmetic == "Pattern" and [(r.i, r.j) for r in p.coo.orderBy("i").collect()] == [(0, 0), (1, 0)]
    path.write_text("%%MatrixMarket matrix coordinate integer general\n3 3 4\n1 1 5\n3 3 4\n3 3 4\n2 1 7\n")
    assert entries(files.read(spark, "mm", str(path))) == [(0, 0, 5.0, 0.0), (1, 0, 7.0, 0.0), (2, 2, 4.0, 0.0), (2, 2, 4.0, 0.0)]
    path.write_text("nothing\n")
    with pytest.raises(ValueError):
        files.read(spark, "mm", str(path))


def test_harwell_boeing(spark, tmp_path):
    lines = ["title".ljust(72) + "key", "".join(f"{x:14d}" for x in (3, 1, 1, 1, 0)), "RUA".ljust(14) + "".join(f"{x:14d}" for x in (3, 3, 4, 0)), "(10I8)".ljust(16) + "(10I8)".ljust(16) + "(1P5E16.8)".ljust(20)]
    lines += ["".join(f"{x:8d}" for x in (1, 3, 4, 5)), "".join(f"{x:8d}" for x in (1, 3, 2, 3)), "".join(f"{x:16.8E}" for x in (1.5, -2, 3, 4))]
    path = tmp_path / "a.rua"
    path.write_text("\n".join(lines) + "\n")
    m = files.read(spark, "hb", str(path))
    assert (m.n, m.kind, m.arithmetic) == (3, GENERAL, "Double")
    assert entries(m) == [(0, 0, 1.5, 0.0), (1, 1, 3.0, 0.0), (2, 0, -2.0, 0.0), (2, 2, 4.0, 0.0)]


def test_ijv_graph_and_matrix_round_trip(spark, tmp_path):
    (tmp_path / "a.ijv").write_text("1 1 2.0\n2 1 3.0\n2 1 1.0\n")
    m = files.read(spark, "ijv", str(tmp_path / "a.ijv"), n=2)
    fixed = files.check_and_correct(m)
    assert entries(fixed) == [(0, 0, 2.0, 0.0), (0, 1, 0.0, 0.0), (1, 0, 4.0, 0.0)]
    files.save(fixed.coo, str(tmp_path / "m"))
    assert entries(files.read(spark, "spm", str(tmp_path / "m"), n=2)) == entries(fixed)
    files.save(graph.pattern(fixed.coo), str(tmp_path / "g"))
    assert files.read(spark, "graph", str(tmp_path / "g")).n == 2
    files.save_csv(Parameters().table(spark), str(tmp_path / "p"))
    assert dict(map(tuple, spark.read.option("header", True).csv(str(tmp_path / "p")).collect()))["restart"] == "25"
    tree = spark.createDataFrame([(0, 1), (1, 1)], "k long, parent long")
    assert [r.value for r in files.tree_dot(tree).collect()] == ['"1" -> "0"']


def test_grid_texts(spark):
    assert files.parse_grid("d:10:10:10:4.:.5:5") == {"nx": 10, "ny": 10, "nz": 10, "alpha": 4.0, "beta": 0.5, "dof": 5, "arithmetic": "Double"}
    assert files.read(spark, "laplacian", "4:3").n == 12
    assert files.read(spark, "xlaplacian", "d:4:3").kind == SYMMETRIC
    x = files.read(spark, "xlaplacian", "z:3:3:3:2")
    assert (x.kind, x.arithmetic, x.n) == (HERMITIAN, "Complex64", 27)
    full = {(r.i, r.j): complex(r.re, r.im) for r in algebra.full(x).collect()}
    assert sum(i == 13 for i, _ in full) == 27 and full[13, 0] == full[0, 13].conjugate() and full[13, 13] == 52 and full[13, 0].imag
    d = files.read(spark, "laplacian", "d:3:3:3:4.:.5:5")
    assert (d.n, d.dof) == (135, 5)
    a = np.zeros((135, 135))
    for r in algebra.full(d).collect():
        a[r.i, r.j] += r.re
    small = np.zeros((27, 27))
    for r in algebra.full(files.read(spark, "laplacian", "d:3:3:3:4.:.5")).collect():
        small[r.i, r.j] += r.re
    assert np.allclose(a, np.kron(small, np.full((5, 5), 0.1) + 0.9 * np.eye(5))) and np.linalg.eigvalsh(a)[0] > 0


def test_written_files_are_read_back(spark, tmp_path):
    for a in (generators.laplacian(spark, 4, 3, hermitian=True), generators.laplacian(spark, 3, 3)):
        files.write_matrix_market(a, str(tmp_path / f"{a.kind}.mm"))
        b = files.read(spark, "mm", str(tmp_path / f"{a.kind}.mm"))
        assert (b.n, b.kind, b.arithmetic, entries(b)) == (a.n, a.kind, a.arithmetic, entries(a))
    order = ordering.grid(spark, 4, 3, 1, 3)
    files.write_ordering(order, str(tmp_path / "order"))
    assert sorted(map(tuple, files.read_ordering(spark, str(tmp_path / "order")).collect())) == sorted(map(tuple, order.collect()))


def test_random_vector_does_not_depend_on_layout(spark):
    a = {(r.i, r.k): r.re for r in generators.random_vector(spark, 50, 39, 2).collect()}
    b = {(r.i, r.k): r.re for r in generators.random_vector(spark, 50, 39, 2).repartition(7).collect()}
    state, want = 39, []
    for _ in range(100):
        want.append(0.5 - state * 5.4210108624275222e-20)
        state = (state * 6364136223846793005 + 1) % 2**64
    assert a == b and np.allclose([a[i % 50, i // 50] for i in range(100)], want, atol=1e-12)


def test_grid_order_puts_separators_last():
    def brute(box, base, leaf, out):
        size = [q - p for p, q in box]
        if min(size) <= 0:
            return
        cells = [(x, y, z) for z in range(*box[2]) for y in range(*box[1]) for x in range(*box[0])]
        if len(cells) < leaf:
            out.update({c: base + n for n, c in enumerate(cells)})
            return
        axis = size.index(max(size))
        cut = box[axis][0] + size[axis] // 2
        left, middle, right = ([*box[:axis], part, *box[axis + 1 :]] for part in ((box[axis][0], cut), (cut, cut + 1), (cut + 1, box[axis][1])))
        count = lambda b: int(np.prod([q - p for p, q in b]))
        brute(left, base, leaf, out)
        brute(right, base + count(left), leaf, out)
        brute(middle, base + count(left) + count(right), 10**9, out)

    for nx, ny, nz, leaf in ((9, 9, 1, 15), (7, 5, 3, 15), (4, 6, 5, 1), (1, 1, 1, 15), (2, 2, 2, 100)):
        want: dict = {}
        brute([(0, nx), (0, ny), (0, nz)], 0, leaf, want)
        i = np.arange(nx * ny * nz)
        assert list(kernels.grid_places(i, nx, ny, nz, leaf)) == [want[v % nx, v // nx % ny, v // (nx * ny)] for v in i]
    perm = kernels.grid_places(np.arange(81), 9, 9, 1)
    assert sorted(perm) == list(range(81))
    assert sorted(perm[np.arange(81) % 9 == 4]) == list(range(72, 81))


def test_trees_against_dense_elimination():
    r = np.random.RandomState(3)
    for n in (1, 7, 25):
        a = (r.rand(n, n) < 0.15) | (r.rand(n, n) < 0.05).T
        a = a | a.T
        np.fill_diagonal(a, False)
        i, j = np.nonzero(a)
        starts, targets = graph.neighbours(i, j, n)
        parent = kernels.elimination_tree(starts, targets)
        low = a.copy()
        for k in range(n):
            rows = np.flatnonzero(low[:, k] & (np.arange(n) > k))
            low[np.ix_(rows, rows)] = True
        want = [min([x for x in range(k + 1, n) if low[x, k]], default=k) for k in range(n)]
        assert list(parent) == want
        assert [list(b) for b in kernels.structures(starts, targets, parent)] == [[x for x in range(k + 1, n) if low[x, k]] for k in range(n)]
        post = kernels.postorder(parent)
        assert sorted(post) == list(range(n)) and all(parent[v] == v or post[v] < post[parent[v]] for v in range(n))


def test_orders_cut_fill(spark):
    e = graph.prepare(generators.laplacian(spark, 10, 10).coo)
    labels = spark.range(100).selectExpr("id as i", "0L as component")
    natural = sum(len(r["rows"]) for r in ordering.elimination(e, labels).collect())
    from latticework.operators.layout import permute

    order = ordering.nested_dissection(e, labels, 4)
    assert sum(len(r["rows"]) for r in ordering.elimination(permute(e, order), labels).collect()) < 0.8 * natural


def test_amalgamation_against_all_orders_of_merging():
    """A chain of sons: those that add no zeros merge, others until the budget is spent."""
    rows = [np.arange(k + 1, 6) for k in range(5)] + [np.zeros(0, dtype=np.int64)]
    assert kernels.amalgamate(list(range(6)), [1] * 6, rows, [1, 2, 3, 4, 5, 5], 0.0) == [5] * 6
    apart = [np.array([k + 1]) for k in range(5)] + [np.zeros(0, dtype=np.int64)]
    assert len(set(kernels.amalgamate(list(range(6)), [1] * 6, apart, [1, 2, 3, 4, 5, 5], 0.0))) == 5
    assert len(set(kernels.amalgamate(list(range(6)), [1] * 6, apart, [1, 2, 3, 4, 5, 5], 100.0))) == 1


@pytest.mark.parametrize("kind", ["LLT", "LLH", "LDLT", "LDLH", "LU", "LLTc"])
def test_panels_eliminate_as_single_columns_do(kind):
    r = np.random.RandomState(1)
    n, p = 150, 110
    a = r.randn(n, n) + (1j * r.randn(n, n) if kind in ("LLH", "LDLH", "LLTc") else 0)
    kind = kind.rstrip("c")
    if kind in ("LLH", "LDLH"):
        a = a @ a.conj().T + n * np.eye(n)
    elif kind != "LU":
        a = a @ a.T + n * np.eye(n)
    low, up, rest, fixed = kernels.factor_front(a, p, kind, 1e-12)
    assert fixed == 0
    mirror = np.conj if kind in ("LLH", "LDLH") else np.asarray
    right = up[:, :] if kind == "LU" else mirror(low).T if kind in ("LLT", "LLH") else up[:, None] * mirror(low).T
    gap = a - low @ right
    assert np.abs(gap[:p]).max() < 1e-8 and np.abs(gap[:, :p]).max() < 1e-8
    assert np.abs(gap[p:, p:] - rest).max() < 1e-8


def test_norms_of_large_and_small_entries(spark):
    for size in (1e200, 1.0, 1e-200):
        e = spark.createDataFrame([(0, 0, 3.0 * size, 0.0), (1, 0, 0.0, 4.0 * size)], "i long, j long, re double, im double")
        n = algebra.norms(e).first()
        assert np.isclose(n.norm_fro / size, 5) and np.isclose(n.norm_one / size, 7)


def test_names():
    assert parse("factorization", "lu") == 2 and name_of("factorization", 2) == "LU"
    assert Parameters(refinement="bicgstab").refinement == "BiCGSTAB"
    for bad in ({"factorization": "QR"}, {"leaf": 0}, {"compress_tolerance": -1.0}):
        with pytest.raises(ValueError):
            Parameters(**bad)
