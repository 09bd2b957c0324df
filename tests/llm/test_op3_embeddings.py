import numpy as np
from latticework.llm import op3_embeddings as m

from .helpers import oracle, of


def test_table(spark):
    d = "/root/testdata/sf0.001"
    assert of(m.op3_embeddings(spark, d)) == oracle(m.SQL, d)


def test_odd_and_large_buckets(spark):
    r = np.random.RandomState(0)
    center = r.randn(16)
    rows = [(i, [float(x) for x in center + 0.09 * r.randn(16)], 1) for i in range(700)]
    rows += [(1000 + i, [float(x) for x in center], 1) for i in range(40)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, [None] + [1.0] * 15, 1), (2005, [float(x) for x in center], None), (2006, [float(x) for x in center], 2)]
    rows += [(2007, [float(x) for x in center[:8]], 1), (2008, [1e200] * 16, 3), (2009, [2e200] * 16, 3), (None, [5.0] * 16, 3), (2010, [float("inf")] + [0.0] * 15, 3)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "vec_id long, embedding array<double>, label int, component int")
    got = {x.vec_id: x for x in m.near_duplicates(df).collect()}
    x = np.array([v for _, v, _ in rows[:740]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.98
    assert 10_000 < near.sum() < near.size
    label = np.arange(740)
    while True:
        new = np.array([label[near[i]].min() for i in range(740)])
        if (new == label).all():
            break
        label = new
    # a pair just over the threshold is missed by all tables once in 70,000
    assert sum(abs(got[v].n_links - (near[i].sum() - 1)) for i, (v, _, _) in enumerate(rows[:740])) <= 6
    for i, (vec_id, _, _) in enumerate(rows[:740]):
        assert got[vec_id].n_links < near[i].sum()
        assert got[vec_id].component_id == rows[label[i]][0]
        assert got[vec_id].kept == (label[i] == i)
    for v in (2000, 2001, 2002, 2003, 2004, 2005, 2006, 2007, 2010):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (0, v, True)
    assert got[2008].n_links == 2 and got[None].component_id == 2008 and not got[None].kept
    assert m.near_duplicates(df.limit(0)).count() == 0


def test_parallel_vectors_of_any_size_are_linked(spark):
    """Components near the largest and the smallest doubles have the signs of those near one."""
    r = np.random.RandomState(2)
    rows = []
    for k in range(12):
        v = r.uniform(0.1, 1.0, 32) * r.choice([-1.0, 1.0], 32)
        rows += [(10 * k + n, [float(x) for x in v * size], k) for n, size in enumerate((1.0, 1e308, 1e-300))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = m.near_duplicates(df).collect()
    assert {(x.n_links, x.component_id) for x in got} == {(2, 10 * k) for k in range(12)}
