import numpy as np
import pytest
from latticework.operators import algebra, graph, incomplete, kernels, layout, lineage, multilevel, ordering, refine, subtrees, symbolic
from latticework.operators.lineage import cut
from latticework.plans import catalog, tables
from latticework.plans.parameters import Parameters
from latticework.plans.solver import Solver
from latticework.schema import GENERAL, Matrix
from latticework.sources import generators
from pyspark.sql import functions as F

from .. import TINY


def frame(spark, pairs):
    return spark.createDataFrame(sorted({(a, b) for p in pairs for a, b in (p, p[::-1]) if a != b}), "i long, j long")


def odd_graph():
    """A grid, a star, a clique, a path and vertices without edges."""
    grid = [(14 * y + x, 14 * (y + dy) + x + dx) for y in range(10) for x in range(14) for dx, dy in ((1, 0), (0, 1)) if x + dx < 14 and y + dy < 10]
    star = [(140, 141 + k) for k in range(60)]
    clique = [(201 + a, 201 + b) for a in range(9) for b in range(a)]
    path = [(210 + k, 211 + k) for k in range(40)]
    return grid + star + clique + path, 270


def structure(columns):
    return {r.i: (r.parent, tuple(r.rows)) for r in columns.collect()}


def test_dissection_of_an_odd_graph(spark):
    pairs, n = odd_graph()
    e, v = cut(frame(spark, pairs)), cut(spark.range(n).select(F.col("id").alias("i")))
    order = cut(multilevel.dissection(e, v, share=70, leaf=8))
    assert ordering.check(order).first() == (n, True)
    assert multilevel.crossing(e, order).count() == 0
    tied = {x for p in pairs for x in p}
    sizes = {}
    for r in order.collect():
        if r.i in tied and not r.region.endswith("2"):
            sizes[r.region] = sizes.get(r.region, 0) + 1
    assert len(sizes) > 2
    # the tree and the structures are those of the walk over whole components
    labels = graph.components(e, v)
    want = structure(ordering.elimination(layout.permute(e, order), layout.apply_order(labels, order)))
    nodes = cut(subtrees.tree(e, order))
    assert structure(subtrees.columns(nodes)) == want
    assert subtrees.entries(nodes).first()[0] == sum(len(rows) for _, rows in want.values())
    assert {r.k: r.parent for r in nodes.collect()} == {k: by.k for k, by in parents(nodes.collect()).items()}


def parents(nodes):
    of = {j: r for r in nodes for j in range(r.first, r.last + 1)}
    return {r.k: of[r.rows[0]] if r.rows else r for r in nodes}


def test_no_group_is_larger_than_the_share(spark):
    a = generators.laplacian(spark, 24, 20)
    e = cut(graph.prepare(a.coo))
    order = multilevel.dissection(e, spark.range(480).select(F.col("id").alias("i")), share=150, leaf=8)
    sizes = {r.region: r["count"] for r in order.groupBy("region").count().collect()}
    assert max(sizes.values()) <= 150
    assert sizes["2"] <= 40  # a line across the grid has 20


def test_a_pass_goes_through_several_levels(spark, monkeypatch):
    """As many passes as the levels over those of a pass, and the order is a dissection still."""
    passes, pieces = [], multilevel.pieces
    monkeypatch.setattr(multilevel, "pieces", lambda *a: passes.append(1) or pieces(*a))
    a = generators.laplacian(spark, 40, 32)
    e = cut(graph.prepare(a.coo))
    order = cut(multilevel.dissection(e, spark.range(1280).select(F.col("id").alias("i")), share=200, leaf=8))
    sizes = {r.region: r["count"] for r in order.groupBy("region").count().collect()}
    assert max(n for r, n in sizes.items() if not r.endswith("2")) <= 200
    assert max(len(r.rstrip("2")) for r in sizes) > len(passes) and len(passes) <= 2
    assert ordering.check(order).first() == (1280, True)
    assert multilevel.crossing(e, order).count() == 0
    assert sizes["2"] <= 64 and sum(n for r, n in sizes.items() if r.endswith("2")) <= 400  # lines across have 32, 20, 20 and so on


def test_coarsening_takes_few_rounds(spark, monkeypatch):
    """What stays single joins a pair, so a round leaves about a third of the vertices."""
    rounds, contracted = [], multilevel.contracted
    monkeypatch.setattr(multilevel, "contracted", lambda *a: rounds.append(1) or contracted(*a))
    a = generators.laplacian(spark, 32, 32)
    e = cut(graph.prepare(a.coo))
    v = spark.range(1024).select(F.col("id").alias("i"), F.lit("").alias("region"))
    side = multilevel.pieces(v, e.withColumn("region", F.lit("")), 110)
    assert len(rounds) <= 3
    parts = {r.side: r["count"] for r in side.groupBy("side").count().collect()}
    assert sum(parts.values()) == 1024 and max(n for s, n in parts.items() if not s.endswith("2")) <= 0.6 * 1024


def test_a_coarse_vertex_weighs_no_more_than_it_may(spark):
    """A star's centre takes its leaves only as long as the weight allows."""
    e = cut(frame(spark, [(0, k) for k in range(1, 90)]).withColumns({"region": F.lit(""), "w": F.lit(1).cast("long")}))
    for most in (7.0, 200.0):
        v = cut(spark.range(90).select(F.col("id").alias("i"), F.lit("").alias("region"), F.lit(1).cast("long").alias("w"), F.lit(most).alias("most")))
        sizes = [r["count"] for r in multilevel.matching(v, e).groupBy("c").count().collect()]
        assert sum(sizes) == 90 and max(sizes) <= most
        assert len(sizes) == (1 if most > 90 else 45)


def test_a_large_grid_is_dissected_and_counted_by_parts(spark, monkeypatch):
    """No task holds the whole component, and the row is that of the smaller way."""
    want = catalog.QUERIES["nested_dissection"](spark, TINY).collect()
    monkeypatch.setattr(multilevel, "SHARE", 70)
    whole = lambda *a, **k: pytest.fail("the component is one task")
    monkeypatch.setattr(ordering, "nested_dissection", whole)
    monkeypatch.setattr(ordering, "elimination", whole)
    assert catalog.QUERIES["nested_dissection"](spark, TINY).collect() == want == [(150, True, True)]


def test_empty_graph(spark):
    none = spark.createDataFrame([], "i long, j long")
    assert multilevel.dissection(none, none.select("i")).count() == 0
    only = spark.range(5).select(F.col("id").alias("i"))
    order = cut(multilevel.dissection(none, only, share=2))
    assert ordering.check(order).first() == (5, True)
    assert subtrees.tree(none, order).count() == 5


@pytest.mark.parametrize("seed", range(4))
def test_runs_hold_the_columns_structures(seed):
    draw = np.random.RandomState(seed)
    n = 40
    a, b = draw.randint(0, n, 70), draw.randint(0, n, 70)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    a, b = a[a != b], b[a != b]
    starts, targets = graph.neighbours(a, b, n)
    parent = kernels.elimination_tree(starts, targets)
    want = kernels.structures(starts, targets, parent)
    low = np.maximum(a, b), np.minimum(a, b)
    out = kernels.column_runs(np.concatenate([low[1], np.arange(n)]), np.concatenate([low[0], np.arange(n)]))
    got = {}
    for first, last, rows, passed in out:
        assert passed is None
        for j in range(first, last + 1):
            got[j] = [*range(j + 1, last + 1), *rows.tolist()]
    assert got == {j: want[j].tolist() for j in range(n)}


def test_halves_are_balanced_and_their_cut_is_short():
    n = 30
    at = np.arange(n * n).reshape(n, n)
    a = np.concatenate([at[:, :-1].ravel(), at[:-1].ravel()])
    b = np.concatenate([at[:, 1:].ravel(), at[1:].ravel()])
    starts, targets = graph.neighbours(np.concatenate([a, b]), np.concatenate([b, a]), n * n)
    side = kernels.bisect(np.ones(n * n, dtype=np.int64), starts, targets, np.ones(len(targets), dtype=np.int64), 0.55)
    assert 0.45 * n * n <= side.sum() <= 0.55 * n * n
    assert (side[a] != side[b]).sum() <= 45


@pytest.mark.parametrize("kind", ["LU", "LLT"])
def test_solver_beyond_one_share(spark, kind):
    a = generators.laplacian(spark, 16, 14, alpha=2.0)
    if kind == "LU":
        full = algebra.full(a)
        a = Matrix(full.withColumn("re", F.col("re") + 0.1 * (F.col("i") < F.col("j")).cast("double")), a.n, GENERAL)
    x = spark.range(a.n).select(F.col("id").alias("i"), F.lit(0).alias("k"), (F.col("id") % 5 + 1.0).alias("re"), F.lit(0.0).alias("im"))
    b = algebra.spmv(algebra.full(a), x)
    s = Solver(a, Parameters(factorization=kind, share=100, limit=60))
    got = {r.i: r.re for r in s.solve(b).collect()}
    assert s.analysis.stages > 1
    assert max(abs(got[i] - (i % 5 + 1.0)) for i in range(a.n)) < 1e-9


def dense(df, n):
    out = np.zeros((n, n), dtype=complex)
    for r in df.collect():
        out[r.i, r.j] += r.re + 1j * r.im
    return out


def by_elimination(a, keep):
    """Incomplete elimination, entry by entry."""
    n = len(a)
    a = np.where(keep, a, 0)
    for i in range(n):
        for p in range(i):
            if keep[i, p]:
                a[i, p] /= a[p, p]
                for j in range(p + 1, n):
                    if keep[i, j] and keep[p, j]:
                        a[i, j] -= a[i, p] * a[p, j]
    return a


@pytest.mark.parametrize("level,hermitian", [(0, False), (1, False), (1, True)])
def test_incomplete_factors(spark, level, hermitian):
    m = generators.laplacian(spark, 6, 5, alpha=2.0, hermitian=hermitian)
    full = cut(algebra.full(m))
    f = incomplete.factorize(full, level)
    keep = np.zeros((30, 30), dtype=bool)
    for r in incomplete.pattern(full, level).collect():
        keep[r.i, r.j] = True
    want = by_elimination(dense(full, 30), keep)
    assert np.abs(dense(f.lower.unionByName(f.upper), 30) - want).max() < 1e-12
    assert f.change <= incomplete.EPS
    assert keep.sum() > (full.count() if level else 0)


@pytest.mark.parametrize("n,alone", [(40, 0), (150, 100)])
def test_incomplete_rows_without_sweeps(spark, n, alone):
    """Rows whose numbers are in no order are finished in rounds without a sweep; of a long chain those that do not wait."""
    at = np.random.RandomState(4).permutation(n) if not alone else np.arange(n)
    a = np.diag(np.arange(n + alone) % 3 + 5.0)
    for i in range(n - 1):
        a[at[i], at[i + 1]], a[at[i + 1], at[i]] = -1.0, -1.5
    i, j = np.nonzero(a)
    f = incomplete.factorize(spark.createDataFrame([(int(x), int(y), float(a[x, y]), 0.0) for x, y in zip(i, j, strict=True)], "i long, j long, re double, im double"))
    assert (f.sweeps == 0) == (not alone)
    assert np.abs(dense(f.lower.unionByName(f.upper), n + alone) - by_elimination(a, a != 0)).max() < 1e-12


def test_incomplete_factors_make_gmres_shorter(spark):
    a, p = tables.matrix(spark, TINY)
    b = cut(tables.known(p, a).select("i", "re", "im"))
    full = cut(algebra.full(a))
    by = refine.matvec(full)
    plain = refine.gmres(by, b, eps=1e-6)
    better = refine.gmres(by, b, m=incomplete.factorize(full, 1).preconditioner(), eps=1e-6)
    assert better.iterations < plain.iterations
    prices = {r.i: r.v for r in p.collect()}
    assert all(abs(r.re - prices[r.i]) < 0.1 for r in better.x.collect())


def test_pivots_far_from_one(spark):
    """Neither the square of a small pivot nor that of a large one spoils a factor."""
    for size in (1e-180, 1e180):
        rows = [(0, 0, 2 * size, 0.0), (0, 1, size, 0.0), (1, 0, size, 0.0), (1, 1, 3 * size, 0.0)]
        f = incomplete.factorize(spark.createDataFrame(rows, "i long, j long, re double, im double"))
        assert abs(f.lower.first().re - 0.5) < 1e-12


def test_costs_of_blocks_add_up_to_those_of_supernodes(spark):
    pairs, n = odd_graph()
    e, v = cut(frame(spark, pairs)), cut(spark.range(n).select(F.col("id").alias("i")))
    blok = cut(symbolic.blocks(subtrees.tree(e, cut(multilevel.dissection(e, v, share=70, leaf=8)))))
    for kind in ("LLT", "LDLT", "LU"):
        for complex_ in (False, True):
            per = symbolic.block_costs(blok, kind, complex_).groupBy("k").agg(F.sum("cost").alias("cost"), F.count("*").alias("c"))
            want = symbolic.heights(blok).select("k", symbolic.flops(kind, F.col("width"), F.col("below"), complex_).alias("whole"), "bloks")
            rows = per.join(want, "k").collect()
            assert rows and max(r.c for r in rows) > 2 and all(r.c == r.bloks and abs(r.cost - r.whole) <= 1e-9 * max(1, r.whole) for r in rows)


def test_structure_takes_memory_by_spans():
    """A band of 3,000 rows: each column has 3,000 rows, but few spans."""
    n, wide = 9_000, 3_000
    i = np.arange(n)
    columns = np.concatenate([i, i[:-1], i[:-wide]])
    rows = np.concatenate([i, i[:-1] + 1, i[:-wide] + wide])
    out = kernels.column_spans(columns, rows, rows)
    assert sum(len(r[3]) for r in out) <= 4 * n
    # column c holds rows c + 1 to c + wide once it has met the column wide before it
    heights = {r[0]: r[2] for r in out if r[0] == r[1]}
    assert heights[wide + 5] == wide and heights[5] == 7


def _merged_by_rounds(nodes, ratio):
    """Merging round by round, from the definition."""
    left = int(ratio * sum((z - a + 1) * (z - a + 2) // 2 + (z - a + 1) * h for a, z, h, _ in nodes))
    rounds = 0
    while True:
        keys = []
        for (a, z, h, head), (b, y, g, _) in zip(nodes, nodes[1:], strict=False):
            keys.append(((z - a + 1) * (y - b + 1 + g - h), b) if head is not None and head <= y else None)
        at = [n for n, k in enumerate(keys) if k and all(o is None or k < o for o in (keys[n - 1] if n else None, keys[n + 1] if n + 1 < len(keys) else None))]
        taken = set()
        for n in sorted(at, key=keys.__getitem__):
            if keys[n][0] > left:
                break
            left -= keys[n][0]
            taken.add(n)
        if not taken:
            return [(a, z, h) for a, z, h, _ in nodes], rounds
        rounds += 1
        new, first = [], None
        for n, (a, z, h, head) in enumerate(nodes):
            first = a if first is None else first
            if n not in taken:
                new.append((first, z, h, head))
                first = None
        nodes = new


def test_merging_in_one_task_or_by_segments(spark, monkeypatch):
    monkeypatch.setattr(subtrees, "JUMP", 2)
    draw = np.random.RandomState(3)
    nodes = [(2 * n, 2 * n + 1, int(h), 2 * n + 2 + int(g) if h else None) for n, (h, g) in enumerate(zip(draw.randint(0, 6, 80), draw.randint(0, 5, 80), strict=True))]
    table = spark.createDataFrame(nodes, "first long, last long, height long, head long")
    for ratio in (0.1, 0.5):
        monkeypatch.setattr(subtrees, "NODES", 50_000)
        whole = sorted(map(tuple, subtrees.merged(table, ratio).collect()))
        monkeypatch.setattr(subtrees, "NODES", 0)
        assert whole == sorted(map(tuple, subtrees.merged(table, ratio).collect()))
        assert [r[1:] for r in whole] == _merged_by_rounds(nodes, ratio)[0]


@pytest.mark.parametrize("jump", [2, 1_000])
def test_merging_takes_few_jobs_for_many_rounds(spark, monkeypatch, jump):
    """Strips of a grid, whose chains merge two supernodes a round; segments of any size give the same."""
    monkeypatch.setattr(subtrees, "JUMP", jump)
    wide, high = 30, 9
    cells = [(x, y) for x in range(high) for y in range(wide)]
    cells.sort(key=lambda c: (c[0] % 4 == 3, c))
    place = {c: n for n, c in enumerate(cells)}
    below = [set() for _ in cells]
    for (x, y), n in place.items():
        for c in ((x + 1, y), (x, y + 1), (x - 1, y), (x, y - 1)):
            if place.get(c, -1) > n:
                below[n].add(place[c])
    for rows in below:
        if rows:
            below[min(rows)] |= rows - {min(rows)}
    nodes = [(n, n, len(rows), min(rows, default=None)) for n, rows in enumerate(below)]
    want, rounds = _merged_by_rounds(nodes, 0.3)
    table = spark.createDataFrame(nodes, "first long, last long, height long, head long")
    assert sorted(tuple(r)[1:] for r in subtrees.merged(table, 0.3).collect()) == want
    assert rounds > 20
    # the rounds themselves, where the budget never ends
    want, _ = _merged_by_rounds(nodes, 1e6)
    gone = {at for at, _, _ in kernels.merge_rounds(*([-1 if x is None else x for x in c] for c in zip(*nodes, strict=True)), 10**9)}
    assert [z for _, z, _, _ in nodes if z not in gone] == [z for _, z, _ in want]


def odd_supernodes(spark):
    pairs, n = odd_graph()
    e, v = cut(frame(spark, pairs)), cut(spark.range(n).select(F.col("id").alias("i")))
    nodes = cut(subtrees.fundamental(cut(subtrees.spans(e, cut(multilevel.dissection(e, v, share=70, leaf=8))))))
    return nodes, cut(subtrees.blocks(nodes)), n


def plan_above_the_blocks(df):
    """The plan of a table from its end to the join that makes the blocks."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[: plan.index("SortMergeJoin")]


@pytest.mark.parametrize("kind", ["LLT", "LU"])
def test_costs_of_blocks_are_made_without_moving_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(subtrees, "BUCKET", 16)
    nodes, blok, _ = odd_supernodes(spark)
    found = subtrees.block_costs(nodes, kind)
    above = plan_above_the_blocks(found)
    assert "Window" not in above and "Exchange" not in above
    got = {(r.k, r.first_row, r.last_row): (r.facing, r.head, r.cost) for r in found.collect()}
    heads = {r.k: r.first for r in nodes.collect()}
    want = {(r.k, r.first_row, r.last_row): (r.facing, heads[r.k], pytest.approx(r.cost)) for r in symbolic.block_costs(blok, kind).collect()}
    assert len(got) > 100 and got == want


def test_queries_on_the_mesh_send_small_tables_alone(spark, monkeypatch):
    seen, key = [], "spark.sql.autoBroadcastJoinThreshold"

    def places(spark, sf):
        seen.append(int(spark.conf.get(key).rstrip("b")))
        return whole(spark, sf)

    before, whole = spark.conf.get(key), tables.places
    monkeypatch.setattr(tables, "places", places)
    assert catalog.QUERIES["mesh_product"](spark, TINY).count() == 200
    assert seen and max(seen) <= lineage.SMALL and spark.conf.get(key) == before


def test_blocks_of_unknowns_are_made_without_moving_blocks(spark, monkeypatch):
    monkeypatch.setattr(subtrees, "BUCKET", 16)
    nodes, blok, n = odd_supernodes(spark)
    dofs = cut(layout.offsets(spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 3).alias("dof"))))
    found = subtrees.blocks_by(nodes, dofs)
    assert "Exchange" not in plan_above_the_blocks(found)
    got = sorted((r.k, r.first_row, r.last_row, r.facing) for r in found.collect())
    assert len(got) > 100 and got == sorted(map(tuple, symbolic.expand_blocks_by(blok, dofs).collect()))


def test_a_large_grids_geometric_order_is_counted_by_parts(spark, monkeypatch):
    """No task holds the whole grid; parts and separators are those of the order, and their columns are those of the walk over the component."""
    want = catalog.QUERIES["grid_ordering"](spark, TINY).collect()
    e, labels = cut(graph.prepare(generators.laplacian(spark, 9, 7, 3).coo)), spark.range(189).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("component"))
    order = cut(ordering.grid(spark, 9, 7, 3, share=40))
    assert sorted(map(tuple, order.select("i", "perm").collect())) == sorted(map(tuple, ordering.grid(spark, 9, 7, 3).collect()))
    assert multilevel.crossing(e, order).count() == 0
    sizes = order.where("region not like '%2'").groupBy("region").count().collect()
    assert len(sizes) == 4 and max(r["count"] for r in sizes) <= 40
    whole = ordering.elimination(layout.permute(e, order), layout.apply_order(labels, order))
    assert structure(subtrees.columns(subtrees.listed(subtrees.spans(e, order)))) == structure(whole)
    monkeypatch.setattr(multilevel, "SHARE", 70)
    monkeypatch.setattr(ordering, "elimination", lambda *a, **k: pytest.fail("the component is one task"))
    assert catalog.QUERIES["grid_ordering"](spark, TINY).collect() == want == [(150, True, True)]
