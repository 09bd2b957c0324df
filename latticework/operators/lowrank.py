"""Low-rank blocks: compression, recompression, products; numpy kernels and their grouped use.

A block is dense (rank -1), null (rank 0) or U V^T (rank > 0). Tolerances are on the Frobenius norm of
what is dropped, absolute or relative to the block's norm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("SVD", "PQRCP", "RQRCP", "TQRCP", "RQRRT")


@dataclass(frozen=True)
class Block:
    """rank -1: u is the dense block and v is None."""

    rank: int
    u: np.ndarray
    v: np.ndarray | None

    def dense(self) -> np.ndarray:
        return self.u if self.rank < 0 else self.u @ self.v.T


def rank_limit(m: int, n: int, strategy: str = "MinimalMemory", ratio: float = 1.0) -> int:
    if strategy == "JustInTime":
        return int(ratio * min(m, n) // 4)
    if strategy == "MinimalMemory":
        return int(ratio * m * n // (m + n))
    return min(m, n)


def rank_limit_column(m: Column, n: Column, strategy: str = "MinimalMemory", ratio: float = 1.0) -> Column:
    r = F.lit(float(ratio))
    if strategy == "JustInTime":
        return F.floor(r * F.least(m, n) / 4)
    if strategy == "MinimalMemory":
        return F.floor(r * m * n / (m + n))
    return F.least(m, n)


def _null(m: int, n: int, kind=float) -> Block:
    return Block(0, np.zeros((m, 0), kind), np.zeros((n, 0), kind))


def _pivoted_qr(a: np.ndarray, tol: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Column-pivoted QR stopped once what remains is below tol: Q, R, columns, whether it got there within most steps."""
    a = a.copy()
    m, n = a.shape
    columns = np.arange(n)
    left = (np.abs(a) ** 2).sum(axis=0)
    q, r = np.zeros((m, 0), a.dtype), np.zeros((0, n), a.dtype)
    for k in range(min(m, n) + 1):
        if np.sqrt(max(0.0, left.sum())) < tol or k == min(m, n):
            return q, r, columns, True
        if k >= most:
            return q, r, columns, False
        p = int(np.argmax(left))
        if left[p] <= 0:
            return q, r, columns, True
        w = a[:, p] - q @ (q.conj().T @ a[:, p])
        norm = np.linalg.norm(w)
        if norm == 0:
            left[p] = 0
            continue
        w = (w / norm)[:, None]
        row = w.conj().T @ a
        q, r = np.hstack([q, w]), np.vstack([r, row])
        a -= w @ row
        left = (np.abs(a) ** 2).sum(axis=0)
    return q, r, columns, True


def compress(a: np.ndarray, tol: float, method: str = "SVD", relative: bool = False, most: int | None = None, seed: int = 0) -> Block:
    """The block with the smallest rank the method finds within the tolerance; dense if that exceeds most."""
    m, n = a.shape
    norm = np.linalg.norm(a)
    bound = tol * norm if relative else tol
    most = rank_limit(m, n) if most is None else most
    if norm <= bound or min(m, n) == 0:
        return _null(m, n, a.dtype)
    if most == 0:
        return Block(-1, a, None)
    if method == "SVD":
        u, s, vt = np.linalg.svd(a, full_matrices=False)
        tail = np.sqrt(np.cumsum(s[::-1] ** 2))[::-1]
        k = int((tail >= bound).sum())
        return Block(k, u[:, :k] * s[:k], vt[:k].T) if k <= most else Block(-1, a, None)
    if method == "PQRCP":
        q, r, _, done = _pivoted_qr(a, bound, most)
        return Block(q.shape[1], q, r.T) if done else Block(-1, a, None)
    factors = {"RQRCP": _sketched_qr, "TQRCP": partial(_sketched_qr, update=False), "RQRRT": _rotated_qr}[method](a, bound, most, np.random.RandomState(seed))
    return Block(-1, a, None) if factors is None else Block(factors[0].shape[1], *factors)


#: Columns that are taken from one sketch, and rows that a sketch has beyond them.
_STEP, _MORE = 8, 8


def _gaussian(random: np.random.RandomState, m: int, n: int, kind: np.dtype) -> np.ndarray:
    g = random.standard_normal((m, n))
    return g + 1j * random.standard_normal((m, n)) if np.issubdtype(kind, np.complexfloating) else g


def _sketched_qr(a: np.ndarray, bound: float, most: int, random: np.random.RandomState, update: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
    """QR whose pivot columns are those of a pivoted QR of a small random sketch, which is updated with the matrix.

    With update the rest of the matrix follows each step; without it a column is reduced when it
    is chosen, and the size of the rest follows from that of the rows found. Returns Q and R^T, or None beyond `most`.
    """
    m, n = a.shape
    rest, left = (a.copy() if update else a), np.linalg.norm(a) ** 2
    omega = _gaussian(random, min(m, _STEP + _MORE), m, a.dtype)
    sketch = omega @ a
    q, r = np.zeros((m, 0), a.dtype), np.zeros((0, n), a.dtype)
    while q.shape[1] < min(m, n):
        small, taken = sketch.copy(), 0
        for _ in range(min(_STEP, len(sketch))):
            p = int(np.argmax((np.abs(small) ** 2).sum(axis=0)))
            size = np.linalg.norm(small[:, p])
            if size <= 1e-14 * np.linalg.norm(a):
                break
            d = small[:, p] / size
            small -= np.outer(d, d.conj() @ small)
            w = rest[:, p] - q @ (q.conj().T @ rest[:, p])
            w = w - q @ (q.conj().T @ w)
            if np.linalg.norm(w) <= 1e-14 * np.linalg.norm(a):
                continue
            w = (w / np.linalg.norm(w))[:, None]
            row = w.conj().T @ a
            q, r, taken = np.hstack([q, w]), np.vstack([r, row]), taken + 1
            sketch = sketch - (omega @ w) @ row
            if update:
                rest = rest - w @ row
            left -= np.linalg.norm(row) ** 2
            # near the end the difference of squares is not told from rounding, so the rest itself is taken
            if left < 4 * bound**2 and np.linalg.norm(rest if update else a - q @ r) < bound:
                return q, r.T
            if q.shape[1] >= most:
                return None
        if not taken:
            break
    return (q, r.T) if np.linalg.norm(a - q @ r) <= max(bound, 1e-12 * np.linalg.norm(a)) else None


def _rotated_qr(a: np.ndarray, bound: float, most: int, random: np.random.RandomState) -> tuple[np.ndarray, np.ndarray] | None:
    """QR of the matrix in rotated columns: an orthonormal basis of a random sketch's rows comes first, a block at a time. Returns Q R and the basis."""
    m, n = a.shape
    rest = a.copy()
    u, v = np.zeros((m, 0), a.dtype), np.zeros((n, 0), a.dtype)
    while True:
        basis = (_gaussian(random, min(_STEP, n), m, a.dtype) @ rest).conj().T
        basis = basis - v @ (v.conj().T @ basis)
        basis, t = np.linalg.qr(basis)
        basis = basis[:, np.abs(np.diag(t)) > 1e-14 * np.linalg.norm(a)]
        if not basis.shape[1]:
            break
        turned = rest @ basis
        # the rotated columns of a block in order of size, so that the last ones can be left out
        q, t = np.linalg.qr(turned)
        left, s, right = np.linalg.svd(t)
        basis, turned = basis @ right.conj().T, (q @ left) * s
        for k in range(basis.shape[1]):
            rest = rest - np.outer(turned[:, k], basis[:, k].conj())
            u, v = np.hstack([u, turned[:, k : k + 1]]), np.hstack([v, basis[:, k : k + 1]])
            if np.linalg.norm(rest) < bound:
                return u, v.conj()
            if u.shape[1] >= min(most, m, n):
                return None if np.linalg.norm(rest) > max(bound, 1e-12 * np.linalg.norm(a)) else (u, v.conj())
    return (u, v.conj()) if np.linalg.norm(rest) <= max(bound, 1e-12 * np.linalg.norm(a)) else None


def orthogonalize(u: np.ndarray, v: np.ndarray, method: str = "QR", have: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """U with orthonormal columns and V changed so that U V^T stays. have: columns already orthonormal."""
    if method == "QR":
        q, r = np.linalg.qr(u)
        return q, v @ r.T
    u, v = u.copy(), v.copy()
    q = u[:, :have]
    if method == "PartialQR":
        w = q.conj().T @ u[:, have:]
        new, r = np.linalg.qr(u[:, have:] - q @ w)
        top = np.hstack([np.eye(have, dtype=u.dtype), w])
        low = np.hstack([np.zeros((r.shape[0], have), u.dtype), r])
        return np.hstack([q, new]), v @ np.vstack([top, low]).T
    for k in range(have, u.shape[1]):  # classical Gram-Schmidt, twice
        for _ in range(2):
            w = u[:, :k].conj().T @ u[:, k]
            u[:, k] -= u[:, :k] @ w
            v[:, :k] += np.outer(v[:, k], w)
        norm = np.linalg.norm(u[:, k])
        if norm > 0:
            u[:, k] /= norm
            v[:, k] *= norm
    return u, v


def add(alpha: complex, a: Block, b: Block, at: tuple[int, int], shape: tuple[int, int], tol: float, method: str = "SVD", relative: bool = False) -> Block:
    """B + alpha * A, A placed at an offset in B's shape; low-rank operands are recompressed without forming the sum."""
    m, n = shape
    i, j = at
    if a.rank == 0:
        return b
    if a.rank < 0 or b.rank < 0:
        out = (b.dense() if b.rank else np.zeros(shape, a.u.dtype)).copy()
        out[i : i + a.u.shape[0], j : j + (a.u.shape[1] if a.rank < 0 else a.v.shape[0])] += alpha * a.dense()
        return Block(-1, out, None) if b.rank < 0 else compress(out, tol, method, relative)
    u, v = np.zeros((m, a.rank), a.u.dtype), np.zeros((n, a.rank), a.v.dtype)
    u[i : i + a.u.shape[0]], v[j : j + a.v.shape[0]] = alpha * a.u, a.v
    q, r = orthogonalize(np.hstack([b.u, u]), np.hstack([b.v, v]))
    most = rank_limit(m, n)
    core = compress(r.T, tol, "PQRCP" if method == "RQRRT" else method, relative, most=min(r.shape))
    if core.rank < 0:
        core = Block(r.shape[1], np.eye(r.shape[1], dtype=r.dtype), r)
    return Block(core.rank, q @ core.u, core.v) if core.rank <= most else Block(-1, (q @ core.u) @ core.v.T, None)


def multiply(a: Block, b: Block, tol: float, method: str = "SVD") -> Block:
    """A B^T of dense or low-rank operands, low-rank if one of them is."""
    m = a.u.shape[0]
    n = b.u.shape[0]
    if a.rank == 0 or b.rank == 0:
        return _null(m, n)
    if a.rank < 0 and b.rank < 0:
        return Block(-1, a.u @ b.u.T, None)
    if a.rank < 0:
        return Block(b.rank, a.u @ b.v, b.u)
    if b.rank < 0:
        return Block(a.rank, a.u, b.u @ a.v)
    core = compress(a.v.T @ b.v, tol, method, most=min(a.rank, b.rank))
    if core.rank < 0:
        return Block(a.rank, a.u, b.u @ (a.v.T @ b.v).T)
    return Block(core.rank, a.u @ core.u, b.u @ core.v)


def multiply_add(alpha: complex, a: Block, b: Block, c: Block, at: tuple[int, int], shape: tuple[int, int], tol: float, method: str = "SVD") -> Block:
    """C + alpha * A B^T at an offset; a null operand leaves C."""
    return c if a.rank == 0 or b.rank == 0 else add(alpha, multiply(a, b, tol, method), c, at, shape, tol, method)


def compressed(blocks: DataFrame, tol: float, method: str = "SVD", relative: bool = False, least_width: int = 0, least_height: int = 0) -> DataFrame:
    """blocks (b, m, n, data array<double> by columns) as b, m, n, rank, u, v, gain; small blocks stay dense."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for b, m, n, data in zip(pdf["b"], pdf["m"], pdf["n"], pdf["data"], strict=True):
                a = np.asarray(data, dtype=float).reshape(n, m).T
                c = compress(a, tol, method, relative) if n >= least_width and m >= least_height else Block(-1, a, None)
                gain = 0 if c.rank < 0 else m * n - (m + n) * c.rank
                out.append((b, m, n, c.rank, c.u.T.ravel(), None if c.v is None else c.v.T.ravel(), gain))
            yield pd.DataFrame(out, columns=["b", "m", "n", "rank", "u", "v", "gain"])

    return blocks.select("b", "m", "n", "data").mapInPandas(run, "b long, m int, n int, rank int, u array<double>, v array<double>, gain long")


def memory(blocks: DataFrame, bytes_: int = 8) -> DataFrame:
    """Bytes of dense and low-rank blocks, in all and by class: rank class, blocks, dense_bytes, used_bytes."""
    kind = F.when(F.col("rank") < 0, "dense").when(F.col("rank") == 0, "null").otherwise("low-rank")
    full = F.col("m").cast("long") * F.col("n") * bytes_
    used = F.when(F.col("rank") < 0, full).otherwise((F.col("m") + F.col("n")).cast("long") * F.col("rank") * bytes_)
    return blocks.groupBy(kind.alias("class")).agg(F.count("*").alias("blocks"), F.sum(full).alias("dense_bytes"), F.sum(used).alias("used_bytes"))
