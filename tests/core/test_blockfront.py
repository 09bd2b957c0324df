import duckdb
import numpy as np
import pytest
from latticework.operators import blockfront, kernels, lowrank
from latticework.operators.numeric import Compression
from latticework.plans import catalog, tables  # noqa: F401

from .. import TINY
from .test_catalog import rows

M, PIVOTS = 230, 50


def smooth(kind, n=M, seed=0):
    """A matrix whose blocks off the diagonal have low rank, with a dominant diagonal."""
    x = np.arange(n) / n
    a = 1 / (1 + 3 * np.abs(x[:, None] - x[None, :])) + 30 * np.eye(n)
    if kind in ("LLH", "LDLH"):
        return a + 1j * np.sin(x[:, None] - x[None, :])
    return a + 0.3 * np.cos(x[:, None] + 2 * x[None, :]) if kind == "LU" else a


def loaded(kind, c, a, index):
    """A front that takes its pivots' columns as entries, and the rest as two contributions of other rows."""
    symmetric = kind != "LU"
    f = blockfront.Front(index, PIVOTS, kind, c, a.dtype.type)
    i, j = np.meshgrid(np.arange(M), np.arange(M), indexing="ij")
    on = (np.minimum(i, j) < PIVOTS) & ((i >= j) | (not symmetric))
    f.enter(index[i[on]], index[j[on]], a[on])
    rest = a[PIVOTS:, PIVOTS:]
    f.receive(blockfront.Piece(index[PIVOTS:], index[PIVOTS:], lowrank.Block(-1, 0.5 * rest, None)))
    # the other half as pieces of its own cuts, low-rank where they are off the diagonal
    at = np.array([PIVOTS, 83, 84, 171, M])
    for k, (b, e) in enumerate(zip(at, at[1:])):
        for k2, (b2, e2) in enumerate(zip(at, at[1:])):
            if symmetric and k2 > k:
                continue
            block = 0.5 * a[b:e, b2:e2]
            piece = lowrank.compress(block, 1e-12, "SVD", relative=True, most=min(block.shape)) if k != k2 else lowrank.Block(-1, block, None)
            f.receive(blockfront.Piece(index[b:e], index[b2:e2], piece))
    return f


@pytest.mark.parametrize("kind", ["LLT", "LDLT", "LU", "LLH", "LDLH"])
@pytest.mark.parametrize("width", [8, 1000])
def test_a_grid_of_blocks_equals_the_dense_front(kind, width):
    c = Compression("MinimalMemory", "SVD", 1e-11, least_width=width, least_height=6, rows=40)
    a, index = smooth(kind), np.arange(M) * 3 + 7
    f = loaded(kind, c, a, index)
    want_low, want_up, want_rest, _ = kernels.factor_front(a, PIVOTS, kind, 1e-14)
    low, up, below, pieces, fixed = f.eliminate(1e-14)
    assert fixed == 0 and np.allclose(low, want_low[:PIVOTS], atol=1e-9)
    if kind != "LLT" and kind != "LLH":
        assert np.allclose(up, want_up[:, :PIVOTS] if kind == "LU" else want_up, atol=1e-9)
    got = np.vstack([x.dense() for _, x, _ in below])
    assert np.allclose(got, want_low[PIVOTS:], atol=1e-8) and [at for at, _, _ in below] == list(range(PIVOTS, M, 40))
    if kind == "LU":
        assert np.allclose(np.vstack([y.dense() for _, _, y in below]), want_up[:, PIVOTS:].T, atol=1e-8)
    rest = np.zeros((M - PIVOTS, M - PIVOTS), dtype=a.dtype)
    for piece in pieces:
        blockfront.spread(piece, index[PIVOTS:], rest)
    some = np.ones_like(rest, dtype=bool) if kind == "LU" else np.tril(np.ones_like(rest, dtype=bool))
    assert np.allclose(rest[some], want_rest[some], atol=1e-8)
    assert any(0 < p.block.rank for p in pieces) and (width > 8) == all(x.rank < 0 for _, x, _ in below)


@pytest.mark.parametrize("method", lowrank.METHODS)
def test_held_bytes_stay_below_a_dense_front(method):
    c = Compression("MinimalMemory", method, 1e-3, least_width=8, least_height=6, rows=40)
    f = loaded("LDLT", c, smooth("LDLT"), np.arange(M))
    f.eliminate(1e-14)
    assert 0 < f.peak < 0.6 * M * M * 8


def test_a_front_without_entries_is_null_below():
    c = Compression("MinimalMemory", "SVD", 1e-3, least_width=2, least_height=2, rows=4)
    f = blockfront.Front(np.arange(10), 3, "LU", c, float)
    f.enter(np.arange(3), np.arange(3), np.ones(3))
    low, up, below, pieces, _ = f.eliminate(1e-14)
    assert np.allclose(low, np.eye(3)) and np.allclose(up, np.eye(3)) and all(x.rank == 0 and y.rank == 0 for _, x, y in below)
    assert all(not p.block.dense().any() for p in pieces)


@pytest.mark.parametrize("name", ["mesh_solution_low_rank", "mesh_low_rank_memory"])
def test_low_rank_queries(spark, name):
    """On a table whose separators are long enough to have a rank."""
    sf = TINY.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{sf}/part.parquet'")
    cur = con.execute(catalog.SQL[name])
    df = catalog.QUERIES[name](spark, sf)
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())
