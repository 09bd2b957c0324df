import numpy as np
import pytest
from latticework.operators import lowrank as m


def decaying(rows, columns, rank, seed=0):
    r = np.random.RandomState(seed)
    u, v = np.linalg.qr(r.randn(rows, rows))[0], np.linalg.qr(r.randn(columns, columns))[0]
    s = 0.5 ** np.arange(min(rows, columns)) * (np.arange(min(rows, columns)) < rank)
    return (u[:, : len(s)] * s) @ v[:, : len(s)].T


@pytest.mark.parametrize("method", m.METHODS)
@pytest.mark.parametrize("relative", [False, True])
def test_compress(method, relative):
    for shape, rank, tol in (((60, 40), 30, 1e-4), ((40, 60), 5, 1e-9), ((30, 30), 3, 1e-3)):
        a = decaying(*shape, rank)
        c = m.compress(a, tol, method, relative)
        bound = tol * (np.linalg.norm(a) if relative else 1)
        assert np.linalg.norm(a - c.dense()) <= 10 * bound * max(1, c.rank)
        assert 0 < c.rank <= rank + 8
    assert m.compress(np.zeros((4, 3)), 1e-8, method).rank == 0
    assert m.compress(np.random.RandomState(0).randn(20, 20), 1e-8, method).rank == -1


@pytest.mark.parametrize("method", ["CGS", "QR", "PartialQR"])
def test_orthogonalize(method):
    r = np.random.RandomState(1)
    u, v = r.randn(30, 8), r.randn(20, 8)
    u[:, :3] = np.linalg.qr(u[:, :3])[0]
    q, w = m.orthogonalize(u, v, method, 3)
    assert np.allclose(q.T @ q, np.eye(8), atol=1e-10) and np.allclose(q @ w.T, u @ v.T)


@pytest.mark.parametrize("method", m.METHODS)
def test_add_and_multiply(method):
    a, b = m.compress(decaying(20, 15, 4), 1e-10, method), m.compress(decaying(50, 40, 6, 1), 1e-10, method)
    assert a.rank > 0 and b.rank > 0
    want = b.dense().copy()
    want[5:25, 9:24] += -3.48 * a.dense()
    got = m.add(-3.48, a, b, (5, 9), (50, 40), 1e-8, method)
    assert np.linalg.norm(got.dense() - want) < 1e-6
    dense = m.Block(-1, decaying(12, 15, 9, 2), None)
    for x, y in ((a, dense), (dense, a), (a, a), (dense, dense), (m._null(3, 15), a)):
        assert np.linalg.norm(m.multiply(x, y, 1e-10, method).dense() - x.dense() @ y.dense().T) < 1e-7
    assert m.multiply_add(2.0, m._null(3, 15), a, b, (0, 0), (50, 40), 1e-8) is b
