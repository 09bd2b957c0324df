"""Words and shingles of Arrow text columns as numpy arrays of 64-bit hashes.

Texts are handled as UTF-8 bytes. The separators are ASCII, so a split of bytes is the split
of code points. A word's hash is a difference of prefix sums of a polynomial over its bytes,
so the cost is a few vector operations for each byte and no Python object for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SEED = np.random.RandomState(20240229)
_BYTE = _SEED.randint(1, 1 << 62, 256).astype(U) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 1 << 20


@lru_cache(2)
def _powers(log: int, base: int) -> np.ndarray:
    out = np.ones(1 << log, dtype=U)
    with np.errstate(over="ignore"):
        for i in range(log):
            out[1 << i : 2 << i] = out[: 1 << i] * U(pow(base, 1 << i, 1 << 64))
    return out


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser that spreads every bit of x over 64 bits."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & ((1 << 64) - 1))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, a longer row alone."""
    n = len(texts)
    if not n:
        return
    sizes = np.asarray(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
        yield at, to
        at = to


class Words:
    """The words of the rows of a text column. Null rows have none.

    begin, end: byte ranges in data, hash: 64-bit hashes, first: the number of the first word
    of each row, with the total number of words at the end.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[lo:hi] if raw is not None and hi > lo else np.zeros(0, np.uint8)
        offsets = offsets - lo
        data = _LOWER[data] if lower else data
        gap = _GAP[data]
        word = np.ones(len(data) + 2, dtype=bool)
        word[0] = word[-1] = False
        word[1:-1] = ~gap
        start = word[1:] & ~word[:-1]  # at i: a word begins at byte i
        stop = word[:-1] & ~word[1:]  # at i: a word ends before byte i
        cuts = offsets[1:-1]
        inner = cuts[(cuts > 0) & (cuts < len(data))]  # a row's edge separates words too
        inner = inner[word[inner] & word[inner + 1]]
        start[inner] = True
        stop[inner] = True
        self.data, self.offsets = data, offsets
        self.begin, self.end = np.flatnonzero(start), np.flatnonzero(stop)
        self.first = np.searchsorted(self.begin, offsets)
        with np.errstate(over="ignore"):
            log = max(12, int(len(data) + 1).bit_length())
            total = np.zeros(len(data) + 1, dtype=U)
            np.cumsum(_BYTE[data] * _powers(log, _BASE)[: len(data)], out=total[1:])
            self.hash = mix((total[self.end] - total[self.begin]) * _powers(log, _INVERSE)[self.begin], 1)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words; fewer words are one run; none gives none."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < size:
            out = U(len(words))
            for w in words:
                out = out * U(0xD6E8FEB86659FD93) + w
            return mix(np.array([out], dtype=U), 2)
        out = np.zeros(len(words) - size + 1, dtype=U)
        for i in range(size):
            out = out * U(0xD6E8FEB86659FD93) + words[i : len(words) - size + 1 + i]
        return mix(out, 3)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles."""
    out = []
    for at, to in slices(texts):
        w = Words(texts.slice(at, to - at))
        for i in range(to - at):
            out.append(np.unique(shingle_hashes(w.hash[w.first[i] : w.first[i + 1]], size)))
    return out
