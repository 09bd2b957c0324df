"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Words are runs of non-space characters with A-Z lower-cased; features are five-word shingles with
their numbers of occurrences as weights (an item of fewer words is a single shingle). A document
matches an item if one of its windows of as many words as the item has a weighted Jaccard
similarity of at least `least` with it: the sum of the smaller weights over that of the larger ones.

1. The items' fingerprints of 256 bits are cut into 16 blocks of 16 bits. Each block's table holds
   every value within 3 bits of an item's block. Two fingerprints within 63 bits differ by at most
   3 bits in one block at least, so the tables find all of them.
2. Every shingle of every document is looked up among the items' shingles. A window without any
   has similarity 0 with all items, so only windows that cover one are fingerprinted, at every word.
3. Pairs of windows and items within the radius are checked by their exact similarity.

A bit differs between a window and an item of similarity s with probability acos(2s / (1 + s)) / pi, 0.152 at 0.8. So
a window at the threshold lies beyond the radius with probability 3e-5, at 0.82 with 2e-7. Nothing else is missed.

The index is sent to all tasks, so its size is fixed: items go in rounds of about CHUNK, and of
CHARS characters, at most, each of which reads the documents once; a benchmark of that size takes one. Documents never
shuffle; a document's result is made where its text is read.

The window that is returned for a document and an item is the most similar one, the first of equals.

Cases: null or empty texts have no windows; a document shorter than an item is one window, whole;
items without words are matched by nothing; repeated items and documents each give their own
rows; null ids are passed through; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .words import U, Words, mix, shingle_hashes, slices

SIZE, LEAST = 5, 0.8
BLOCKS, WIDTH, NEAR = 16, 16, 3
RADIUS = BLOCKS * (NEAR + 1) - 1
BITS = BLOCKS * WIDTH
#: Items in one index, 16 tables of 697 entries for each, 45 MB, and characters of their texts.
CHUNK, CHARS = 1000, 8_000_000
_GATE = 20
#: Words of a document whose windows are fingerprinted at once, 4 MB of counters.
SPAN = 4096


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """BITS signs (+1 or -1) for each hash."""
    words = np.stack([mix(hashes, 21 + i) for i in range(BITS // 64)], axis=1)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int16) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """Rows of BITS sums as blocks of 16 bits."""
    return np.packbits(sums > 0, axis=-1).view(np.uint16)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingles."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both)


class Index:
    """Fingerprints of items and tables of their blocks' neighbourhoods."""

    def __init__(self, ids: pa.Array, texts: list[str]):
        rows, self.lengths, self.shingles = [], [], []
        for row, text in enumerate(texts):
            words = Words(pa.array([text], pa.string())).hash
            if len(words):
                rows.append(row)
                self.lengths.append(len(words))
                self.shingles.append(_runs(words, min(SIZE, len(words))))
        self.ids = ids.take(pa.array(rows, pa.int64()))
        self.lengths = np.array(self.lengths, dtype=np.int64)
        self.prints = np.array([fingerprint(bits_of(s).sum(axis=0)) for s in self.shingles], dtype=np.uint16).reshape(-1, BLOCKS)
        flips = [0, *(sum(1 << b for b in c) for k in range(1, NEAR + 1) for c in combinations(range(WIDTH), k))]
        self.tables = []
        for b in range(BLOCKS):
            keys = (self.prints[:, b][:, None] ^ np.array(flips, dtype=np.uint16)).ravel()
            order = np.argsort(keys, kind="stable")
            self.tables.append((np.searchsorted(keys[order], np.arange((1 << WIDTH) + 1)).astype(np.int32), (order // len(flips)).astype(np.int32)))
        # for each shingle size: its hashes, the lengths of the items that have them, and a bit map before the search
        self.gates = {}
        for size in {min(SIZE, int(n)) for n in self.lengths}:
            own = [i for i, n in enumerate(self.lengths) if min(SIZE, n) == size]
            pairs = np.unique(np.concatenate([np.stack([self.shingles[i], np.full(len(self.shingles[i]), self.lengths[i], dtype=U)], axis=1) for i in own]), axis=0)
            seen = np.zeros(1 << _GATE, dtype=bool)
            seen[pairs[:, 0] >> U(64 - _GATE)] = True
            self.gates[size] = (seen, np.unique(pairs[:, 0]), pairs)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) within the radius."""
        out = []
        for b, (starts, items) in enumerate(self.tables):
            lo, hi = starts[prints[:, b]], starts[prints[:, b].astype(np.int64) + 1]
            n = hi - lo
            w = np.repeat(np.arange(len(prints)), n)
            at = np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            out.append(w * len(self.ids) + items[at])
        w, i = np.divmod(np.unique(np.concatenate(out)), len(self.ids))
        good = np.bitwise_count(prints[w] ^ self.prints[i]).sum(axis=1) <= RADIUS
        return w[good], i[good]


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    return shingle_hashes(words, size) if len(words) >= size else words[:0]


def _match(index: Index, words: np.ndarray, hits: dict[int, np.ndarray], least: float) -> list[tuple]:
    """Best window of each item in a document. hits: by shingle size, positions of known shingles."""
    best: dict[int, tuple] = {}
    n = len(words)
    for size, at in hits.items():
        all_ = _runs(words, size)
        _, _, pairs = index.gates[size]
        lo, hi = np.searchsorted(pairs[:, 0], all_[at], "left"), np.searchsorted(pairs[:, 0], all_[at], "right")
        wanted: dict[int, set] = {}
        for p, i, j in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True):
            for length in pairs[i:j, 1].tolist():
                wanted.setdefault(length, set()).add(p)
        for length, points in wanted.items():
            window = min(length, n)
            # windows that cover a known shingle
            points = np.array(sorted(points))
            mark = np.zeros(n - window + 2, dtype=np.int64)
            np.add.at(mark, np.maximum(0, np.minimum(points - (window - size), n - window)), 1)
            np.add.at(mark, np.minimum(points, n - window) + 1, -1)
            starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            per = window - size + 1
            # a stretch of SPAN words at a time, however far apart the windows are
            for part in np.split(starts, np.flatnonzero(np.diff(starts // SPAN)) + 1):
                first, last = int(part[0]), int(part[-1]) + per
                sums = np.zeros((last - first + 1, BITS), dtype=np.int32)
                np.cumsum(bits_of(all_[first:last]), axis=0, out=sums[1:])
                sums = sums[part - first + per] - sums[part - first]
                for w, i in zip(*index.near(fingerprint(sums)), strict=True):
                    if index.lengths[i] != length:
                        continue
                    start = int(part[w])
                    sim = similarity(all_[start : start + per], index.shingles[i])
                    if sim >= least and (sim, -start) > best.get(int(i), (0.0, 1))[:2]:
                        best[int(i)] = (sim, -start, window)
    return [(i, sim, -start, window) for i, (sim, start, window) in sorted(best.items())]


def found_in(index: Index, texts: pa.Array, least: float) -> list[tuple]:
    """(row, item, similarity, start_word, n_words) of the best windows."""
    out = []
    for at, to in slices(texts):
        w = Words(texts.slice(at, to - at))
        hits: dict[int, dict[int, np.ndarray]] = {}
        for size, (seen, known, _) in index.gates.items():
            runs = _runs(w.hash, size)
            maybe = np.flatnonzero(seen[runs >> U(64 - _GATE)])
            if not len(maybe):
                continue
            k = np.searchsorted(known, runs[maybe])
            maybe = maybe[known[np.minimum(k, len(known) - 1)] == runs[maybe]]
            row = np.searchsorted(w.first, maybe, "right") - 1
            inside = maybe + size <= w.first[row + 1]
            maybe, row = maybe[inside], row[inside]
            edges = np.flatnonzero(np.diff(row)) + 1
            for points, r in zip(np.split(maybe, edges), row[np.concatenate([[0], edges])] if len(row) else [], strict=False):
                hits.setdefault(int(r), {})[size] = points - w.first[r]
        for r, sizes in sorted(hits.items()):
            out += [(at + r, *x) for x in _match(index, w.hash[w.first[r] : w.first[r + 1]], sizes, least)]
    return out


def _search(held, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            if out := found_in(index, batch.column("text"), least):
                row, item, *rest = zip(*out, strict=True)
                ids = batch.column("doc_id").take(pa.array(row, pa.int64())), index.ids.take(pa.array(item, pa.int64()))
                numbers = (pa.array(x, t) for x, t in zip(rest, (pa.float64(), pa.int64(), pa.int64()), strict=True))
                yield pa.RecordBatch.from_arrays([*ids, *numbers], names=["doc_id", "item_id", "similarity", "start_word", "n_words"])

    return run


def _without(held, least: float, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = np.ones(batch.num_rows, dtype=bool)
            for r, *_ in found_in(held.value, batch.column(text_at), least):
                stay[r] = False
            yield batch.filter(pa.array(stay))

    return run


def _indexes(items: DataFrame, chunk: int) -> Iterator[Index]:
    items = items.select("item_id", "text").where("text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    rounds = max(1, -(-n // chunk), -(-chars // CHARS))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds))
    for r in range(rounds):
        # about `chunk` items at a time come to the driver
        rows = items.where(part == r).orderBy("item_id", "text").toArrow().combine_chunks()
        index = Index(pa.concat_arrays(rows.column("item_id").chunks), rows.column("text").to_pylist()) if rows.num_rows else None
        if index and len(index.ids):
            yield index


def contaminated(docs: DataFrame, items: DataFrame, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Per document and item that it holds: doc_id, item_id, similarity, start_word, n_words of the best window. Ids are of any type."""
    spark = docs.sparkSession
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, similarity double, start_word long, n_words long"
    out = spark.createDataFrame([], schema)
    for index in _indexes(items, chunk):
        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(_search(spark.sparkContext.broadcast(index), least), schema))
    return out


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST, chunk: int = CHUNK) -> DataFrame:
    """docs without the rows that hold a benchmark item. Rows go by their texts, so null and repeated ids do no harm."""
    names = docs.columns
    for index in _indexes(items, chunk):
        plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
        kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
        docs = plain.mapInArrow(_without(docs.sparkSession.sparkContext.broadcast(index), least, names.index("text")), kinds).toDF(*names)
    return docs


def op7_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
