"""A front as a grid of blocks: contributions are added to compressed blocks, the whole is never dense.

Place (0, 0) holds the pivots, the rows below are cut into runs. Blocks on the diagonal and small ones are dense, all others
U V^T where that is smaller. What a column eliminates is subtracted from such a block by recompression
of the joined U and V, so a task holds one dense block at a time besides those that have no low rank.
A piece is a block with its rows and columns in the numbering of the matrix; that is how a front leaves what remains.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import lowrank
from .kernels import factor_front
from .lowrank import Block


@dataclass(frozen=True)
class Piece:
    """A block of contributions. Of a symmetric or Hermitian matrix only what is on or below the diagonal counts."""

    rows: np.ndarray
    cols: np.ndarray
    block: Block


def _bytes(block: Block) -> int:
    return block.u.nbytes + (0 if block.v is None else block.v.nbytes)


def _turned(block: Block) -> Block:
    return Block(-1, block.u.T, None) if block.rank < 0 else Block(block.rank, block.v, block.u)


class Front:
    """index: numbers of the front's rows, of which the first `pivots` are eliminated. c: how to compress (see numeric.Compression)."""

    def __init__(self, index: np.ndarray, pivots: int, kind: str, c, dtype: type):
        self.index, self.pivots, self.kind, self.c, self.dtype = index, pivots, kind, c, np.dtype(dtype)
        self.starts = np.concatenate([[0], np.arange(pivots, len(index), c.rows)]).astype(np.int64)
        self.ends = np.append(self.starts[1:], len(index))
        self.blocks: dict[tuple[int, int], Block] = {}
        self.held = self.peak = 0

    @property
    def general(self) -> bool:
        return self.kind == "LU"

    def _shape(self, a: int, b: int) -> tuple[int, int]:
        return int(self.ends[a] - self.starts[a]), int(self.ends[b] - self.starts[b])

    def _is_dense(self, a: int, b: int) -> bool:
        """Blocks on the diagonal and those with a side under the least one stay dense. The least width is that of the columns."""
        m, n = self._shape(max(a, b), min(a, b))
        least = self.c.least_width if min(a, b) == 0 else self.c.least_height
        return a == b or n < least or m < self.c.least_height

    def _get(self, a: int, b: int) -> Block:
        if (a, b) not in self.blocks:
            m, n = self._shape(a, b)
            self._set(a, b, Block(-1, np.zeros((m, n), self.dtype), None) if self._is_dense(a, b) else Block(0, np.zeros((m, 0), self.dtype), np.zeros((n, 0), self.dtype)))
        return self.blocks[a, b]

    def _set(self, a: int, b: int, block: Block) -> None:
        if (a, b) in self.blocks:
            self._dropped(self.blocks[a, b])
        self.blocks[a, b] = block
        self._kept(block)

    def _kept(self, block: Block) -> None:
        self.held += _bytes(block)
        self.peak = max(self.peak, self.held)

    def _dropped(self, block: Block) -> None:
        self.held -= _bytes(block)

    def _plus(self, a: int, b: int, new: Block, factor: float = 1.0) -> None:
        """Adds to a block; new has the block's shape."""
        if new.rank == 0:
            return
        old = self._get(a, b)
        if self._is_dense(a, b):
            old.u[...] += factor * new.dense()
        else:
            c = self.c
            self._set(a, b, lowrank.add(factor, new, old, (0, 0), self._shape(a, b), c.tolerance, c.method, relative=True))

    def enter(self, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
        """Entries of the matrix in the pivots' columns and rows, a block at a time."""
        p, q = np.searchsorted(self.index, i), np.searchsorted(self.index, j)
        a, b = (np.searchsorted(self.starts, x, "right") - 1 for x in (p, q))
        place = a * len(self.starts) + b
        for key in np.unique(place):
            on = place == key
            at = int(key) // len(self.starts), int(key) % len(self.starts)
            dense = np.zeros(self._shape(*at), self.dtype)
            np.add.at(dense, (p[on] - self.starts[at[0]], q[on] - self.starts[at[1]]), value[on])
            self._plus(*at, Block(-1, dense, None))

    def receive(self, piece: Piece) -> None:
        """A contribution: its rows and columns are those of this front, at places of their own."""
        p, q = np.searchsorted(self.index, piece.rows), np.searchsorted(self.index, piece.cols)
        of_p, of_q = (np.searchsorted(self.starts, x, "right") - 1 for x in (p, q))
        for a in np.unique(of_p):
            for b in np.unique(of_q):
                if a < b and not self.general:
                    continue
                rows, cols = of_p == a, of_q == b
                m, n = self._shape(a, b)
                r, s = p[rows] - self.starts[a], q[cols] - self.starts[b]
                if piece.block.rank < 0:
                    dense = np.zeros((m, n), self.dtype)
                    dense[np.ix_(r, s)] = piece.block.u[np.ix_(rows, cols)]
                    new = Block(-1, dense, None)
                else:
                    u, v = np.zeros((m, piece.block.rank), self.dtype), np.zeros((n, piece.block.rank), self.dtype)
                    u[r], v[s] = piece.block.u[rows], piece.block.v[cols]
                    new = Block(piece.block.rank, u, v)
                self._plus(int(a), int(b), new)

    def _product(self, x: Block, y: Block) -> Block:
        """x y^T; of two dense blocks with few columns it is low-rank as well."""
        if x.rank < 0 and y.rank < 0 and 0 < x.u.shape[1] <= lowrank.rank_limit(len(x.u), len(y.u)):
            return Block(x.u.shape[1], x.u, y.u)
        return lowrank.multiply(x, y, 0.0, self.c.method)

    def eliminate(self, criterion: float) -> tuple[np.ndarray, np.ndarray, list, list[Piece], int]:
        """L of the pivots, D or U of them, blocks below (first row, L, U^T or None), what remains, pivots replaced."""
        low, up, _, fixed = factor_front(self._get(0, 0).u, self.pivots, self.kind, criterion)
        hermitian = self.kind in ("LLH", "LDLH")
        d = up if self.kind in ("LDLT", "LDLH") else np.ones(self.pivots, dtype=self.dtype)
        right = up if self.general else d[:, None] * (low.conj() if hermitian else low).T

        def solved(x: Block, by: np.ndarray) -> Block:
            # B becomes B R^-1, which changes V of U V^T alone
            return Block(-1, np.linalg.solve(by.T, x.u.T).T, None) if x.rank < 0 else Block(x.rank, x.u, np.linalg.solve(by.T, x.v))

        count = len(self.starts)
        lower, upper = {}, {}
        for a in range(1, count):
            lower[a] = solved(self._get(a, 0), right)
            self._kept(lower[a])
            self._dropped(self.blocks.pop((a, 0)))
            if self.general:
                upper[a] = solved(_turned(self._get(0, a)), low.T)
                self._kept(upper[a])
                self._dropped(self.blocks.pop((0, a)))

        def other(b: int) -> Block:
            if self.general:
                return upper[b]
            x = lower[b]
            u, v = (x.u.conj(), None if x.v is None else x.v.conj()) if hermitian else (x.u, x.v)
            return Block(-1, u * d, None) if x.rank < 0 else Block(x.rank, u, d[:, None] * v)

        pieces = []
        for b in range(1, count):
            by = other(b)
            for a in range(1 if self.general else b, count):
                self._plus(a, b, self._product(lower[a], by), -1.0)
                pieces.append(Piece(self.index[self.starts[a] : self.ends[a]], self.index[self.starts[b] : self.ends[b]], self._get(a, b)))
        below = [(int(self.starts[a]), lower[a], upper.get(a)) for a in range(1, count)]
        return low, up, below, pieces, fixed


def spread(piece: Piece, index: np.ndarray, front: np.ndarray) -> None:
    """Adds a piece to a dense front."""
    front[np.ix_(np.searchsorted(index, piece.rows), np.searchsorted(index, piece.cols))] += piece.block.dense()
