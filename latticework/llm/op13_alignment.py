"""Alignment of two tokenizers: which tokens overlap, and where both end.

A is a byte-level BPE, B a sentencepiece BPE with byte fallback. Both encode the same bytes, a space and the text. In each
batch the tokens' start bytes are matched with pandas.merge_asof, keyed by document: a start of A
finds the token of B that covers it and the other way round. A pair overlaps exactly if the start of one lies in the
other, so the union of both directions holds all links; pairs with equal starts are found twice and kept once.
Where tokens of both end at the same byte a group ends.

Both tokenizers cut before a single space between two other characters (no entry of A or B has a
space after another character), so a text is split there, and a worker keeps the tokens of chunks it has
seen, up to KEPT bytes. Equality with the whole text's tokens is tested. A is encoded by tiktoken with the ranks of
the file's own entries if its merges stand in the order of their ids, else by the file's library.

A document's distinct id pairs and their numbers are kept in a table, and beside it the number of documents of each pair in
each slice of SLICE bytes; counts of the corpus are sums of the latter. At most SENT pairs, the most
frequent, are sent to tasks with their counts; the others are joined. A pair that is not sent has at most
2 / SENT of all occurrences, so no key of that join is hot.

Cases: null and empty texts, and texts whose joined bytes differ from space and text in A or B (B's
mark of a space inside the text, say) have no tokens: zeros and an empty string. Strings of special tokens are
plain text. Repeated rows and null ids are documents of their own. An empty table gives an empty result; other
columns are not read. Vocabulary files are parameters; their paths must be readable on all executors.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join, table
from .words import slices

A_FILE = "/opt/tokenizers/byte_bpe_50k.json"
B_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: The pre-token pattern of byte-level files that name none.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose tokens are matched at once, bytes of chunks that a worker keeps, and pairs that are sent to all tasks.
SLICE, KEPT, SENT = 1 << 19, 1 << 23, 1 << 18
#: Where texts are split.
CUT = re.compile(r" (?=\S)(?<=\S )")
COLUMNS = "number long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>, slice_pairs array<long>, slice_docs array<int>"


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level entries write bytes: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """A tokenizer: encode gives the ids of chunks that begin with a space; size, data and first the bytes of each id."""

    def __init__(self, entries: list[bytes], encode):
        self.encode = encode
        self.size = np.array([len(e) for e in entries], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.data = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_ragged(self.first[ids], self.size[ids])]


def side_a(path: str) -> Side:
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    own = {x["id"] for x in model["added_tokens"]}
    alphabet = byte_alphabet()
    vocabulary = model["model"]["vocab"]
    entries = [b""] * (1 + max([*vocabulary.values(), *own]))
    for entry, i in vocabulary.items():
        if i not in own:
            entries[i] = bytes(alphabet[c] for c in entry)
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
    made = [vocabulary["".join(m)] for m in pairs]
    if made == sorted(made) and model["pre_tokenizer"].get("use_regex", True) and not model["normalizer"]:
        import tiktoken

        ranks = {entries[i]: i for i in vocabulary.values() if i not in own}
        coded = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Side(entries, lambda chunks: [coded.encode_ordinary(c) for c in chunks])
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return Side(entries, lambda chunks: [x.ids for x in whole.encode_batch_fast(chunks, add_special_tokens=False)])


def side_b(path: str) -> Side:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    entries = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    # the model adds the space itself
    return Side(entries, lambda chunks: model.encode([c[1:] for c in chunks], num_threads=1))


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... of size[i] each, one after another."""
    if not len(size):
        return np.zeros(0, np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1]) + np.repeat(first - ends + size, size)


class Both:
    """Tokens of chunks in both tokenizers, kept from slice to slice."""

    def __init__(self, a_file: str, b_file: str):
        self.sides = (side_a(a_file), side_b(b_file))
        width = [len(s.size) for s in self.sides]
        # decimal ids with what may stand before them: nothing, a comma, a bar, a semicolon
        self.text = [lead + str(i) for lead in ("", ",", "|", ";") for i in range(max(width))]
        self.width, self.b_width = max(width), width[1]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int32) for _ in self.sides]
        self.size = [np.zeros(0, np.int64) for _ in self.sides]
        self.first = [np.zeros(0, np.int64) for _ in self.sides]
        self.same = np.zeros(0, bool)  # whether both sides' bytes are the chunk's
        self.kept = 0

    def _same(self, n: int, whole: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of the last n chunks, whose bytes are whole."""
        out = np.ones(n, bool)
        for k, s in enumerate(self.sides):
            ids, size = self.tokens(k, np.arange(len(self.size[k]) - n, len(self.size[k])))
            got = np.bincount(np.repeat(np.arange(n), size), s.size[ids], n).astype(np.int64)
            out &= got == length
            fit = np.repeat(out, size)
            differs = s.joined(ids[fit]) != whole[np.repeat(out, length)]
            out[np.repeat(np.arange(n), length)[np.repeat(out, length)][differs]] = False
        return out

    def chunks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' chunks, and how many each text has."""
        if self.kept > KEPT:
            self.clear()
        split = [CUT.split(t) for t in texts]
        known = self.known
        flat = [p for parts in split for p in parts]
        found = list(map(known.get, flat))
        if None in found:
            lost = [i for i, x in enumerate(found) if x is None]
            new = dict.fromkeys([flat[i] for i in lost])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            fresh = [" " + p for p in new]
            self.kept += sum(map(len, fresh))
            for k, s in enumerate(self.sides):
                ids = s.encode(fresh)
                size = np.fromiter(map(len, ids), np.int64, len(ids))
                self.first[k] = np.concatenate([self.first[k], len(self.ids[k]) + np.cumsum(size) - size])
                self.size[k] = np.concatenate([self.size[k], size])
                self.ids[k] = np.concatenate([self.ids[k], np.fromiter(chain.from_iterable(ids), np.int32, int(size.sum()))])
            whole = "".join(fresh).encode()
            length = np.fromiter((len(p.encode()) for p in fresh), np.int64, len(fresh))
            self.same = np.concatenate([self.same, self._same(len(fresh), np.frombuffer(whole, np.uint8), length)])
            for i in lost:
                found[i] = known[flat[i]]
        return np.array(found, dtype=np.int64), np.fromiter(map(len, split), np.int64, len(split))

    def tokens(self, k: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Side k: the ids of chunks, one after another, and how many each has."""
        size = self.size[k][numbers]
        return self.ids[k][_ragged(self.first[k][numbers], size)], size


@lru_cache(2)
def both(a_file: str, b_file: str) -> Both:
    return Both(a_file, b_file)


def covering(starts: np.ndarray, docs: np.ndarray, other: np.ndarray, other_docs: np.ndarray) -> np.ndarray:
    """For each start the number of the other side's last token of the same document that starts there or before."""
    left = pd.DataFrame({"at": starts, "doc": docs})
    right = pd.DataFrame({"at": other, "doc": other_docs, "found": np.arange(len(other))})
    return pd.merge_asof(left, right, on="at", by="doc")["found"].to_numpy().astype(np.int64)


def align(texts: list[str], by: Both) -> tuple[dict[str, np.ndarray], list[str], list[np.ndarray], list[np.ndarray]]:
    """Per text: counts by name, groups as text (the empty one without tokens), distinct pairs a * width of B + b and their numbers."""
    n = len(texts)
    numbers, parts = by.chunks(texts)
    of = np.repeat(np.arange(n), parts)
    length = np.fromiter((len(t.encode()) + 1 for t in texts), np.int64, n)
    base = np.cumsum(length) - length
    good = np.fromiter((bool(t) for t in texts), bool, n)
    for i in np.unique(of[~by.same[numbers]]):  # a chunk differs, so the text does unless shifts make up for it
        mine = numbers[of == i]
        whole = np.frombuffer(b" " + texts[i].encode(), np.uint8)
        good[i] &= all(np.array_equal(s.joined(by.tokens(k, mine)[0]), whole) for k, s in enumerate(by.sides))
    keep = good[of]
    numbers, of = numbers[keep], of[keep]
    sides = []
    for k, s in enumerate(by.sides):
        ids, count = by.tokens(k, numbers)
        doc = np.repeat(of, count)
        size = s.size[ids]
        held = np.where(good, length, 0)
        start = np.cumsum(size) - size + (base - (np.cumsum(held) - held))[doc]
        sides.append((ids.astype(np.int64), doc, start))
    (a, a_doc, a_start), (b, b_doc, b_start) = sides
    b_of_a = covering(a_start, a_doc, b_start, b_doc)
    a_of_b = covering(b_start, b_doc, a_start, a_doc)
    a_first, b_first = b_start[b_of_a] == a_start, a_start[a_of_b] == b_start  # both start, so both ended before: a group begins
    once = ~b_first
    link_doc = np.concatenate([a_doc, b_doc[once]])
    pair = np.concatenate([a * by.b_width + b[b_of_a], a[a_of_b[once]] * by.b_width + b[once]])
    span = by.width * by.b_width
    key, times = np.unique(link_doc * span + pair, return_counts=True)
    edges = np.searchsorted(key, np.arange(1, n) * span)
    # in the groups' text a group's tokens of A stand before those of B
    a_group, b_group = np.cumsum(a_first) - 1, np.cumsum(b_first) - 1
    a_upto, b_upto = np.cumsum(np.bincount(a_group)), np.cumsum(np.bincount(b_group))
    a_at = np.arange(len(a)) + np.concatenate([[0], b_upto])[a_group]
    b_at = np.arange(len(b)) + a_upto[b_group]
    code, doc = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    lead = np.where(a_first, 3, 1)
    lead[np.flatnonzero(np.diff(a_doc, prepend=-1))] = 0
    code[a_at] = lead * by.width + a
    code[b_at] = np.where(np.diff(b_group, prepend=-1) > 0, 2, 1) * by.width + b
    doc[a_at], doc[b_at] = a_doc, b_doc
    opens = np.searchsorted(doc, np.arange(n + 1)).tolist()
    text = by.text
    groups = ["".join([text[x] for x in code[i:j].tolist()]) for i, j in zip(opens, opens[1:])]
    n_groups = np.bincount(a_doc[a_first], minlength=n)
    counts = {"n_a": np.bincount(a_doc, minlength=n), "n_b": np.bincount(b_doc, minlength=n), "n_groups": n_groups, "n_links": np.bincount(link_doc, minlength=n)}
    return counts, groups, np.split(key % span, edges), np.split(times, edges)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0), kind))


def _aligned(a_file: str, b_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = both(a_file, b_file)
        for batch in batches:
            for at, to in slices(batch.column("text"), SLICE):
                part, n = batch.slice(at, to - at), to - at
                texts = [t or "" for t in part.column("text").to_pylist()]
                counts, groups, pairs, times = align(texts, by)
                seen, docs = np.unique(np.concatenate(pairs), return_counts=True)
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                nothing = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("number"),
                        part.column("doc_id"),
                        *(pa.array(counts[c].astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")),
                        pa.array(digests, pa.string()),
                        _lists(pairs, pa.int64()),
                        _lists(times, pa.int32()),
                        # the slice's own counts stand in its first row
                        _lists([seen, *[nothing] * (n - 1)], pa.int64()),
                        _lists([docs, *[nothing] * (n - 1)], pa.int32()),
                    ],
                    names=[c.split()[0] for c in COLUMNS.split(", ")],
                )

    return run


def aligned(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Per row of docs: COLUMNS; number is the row's own. The last two are of a slice of rows and stand in its first."""
    rows = docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_aligned(a_file, b_file), COLUMNS)


def pair_counts(made: DataFrame, b_width: int) -> DataFrame:
    """Of aligned rows: pair, n (documents that hold it), best (whether n is the highest of its A id)."""
    each = made.select(F.explode(F.arrays_zip("slice_pairs", "slice_docs")).alias("x")).select(F.col("x.slice_pairs").alias("pair"), F.col("x.slice_docs").alias("d"))
    counts = cut(each.groupBy("pair").agg(F.sum("d").alias("n")).withColumn("a", F.expr(f"pair div {b_width}")), "counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"), F.count("*").alias("size"))
    return spread_join(counts, most, ["a"], "size", F.col("pair")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def totals(made: DataFrame, counts: DataFrame, sent: int = SENT) -> DataFrame:
    """Per number with links: n_best, count_sum."""
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("pairs"))
    least, held = 1 << 62, 0
    for level, pairs in sorted((tuple(r) for r in levels.collect()), reverse=True):  # one row for each power of two
        held += pairs
        if held > sent:
            break
        least = 1 << level
    links = made.select("number", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("number", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    known = links.join(F.broadcast(counts.where(F.col("n") >= least)), "pair", "left")
    sums = lambda df: df.groupBy("number").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    if held <= sent:
        return sums(known)
    rest = cut(known.where("n is null").select("number", "pair", "times"), "rest").join(counts.where(F.col("n") < least), "pair")
    return _added(sums(known.where("n is not null")), sums(rest))


def _added(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.unionByName(y).groupBy("number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, sent: int = SENT) -> DataFrame:
    """Per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    made = cut(aligned(docs, a_file, b_file), "aligned")
    counts = cut(pair_counts(made, both(a_file, b_file).b_width), "pairs")
    sums = totals(made, counts, sent)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return made.select("number", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "number", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13_alignment(spark, sf_dir):
    return alignment(table(spark, sf_dir, "documents"))
