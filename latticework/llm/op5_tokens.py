"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A byte-level BPE never merges across pre-tokens, and the pre-token pattern looks ahead only, by
one character beyond a match's last and a run of white space. So a document's count is the sum of
its pre-tokens' counts, and an edit changes only pre-tokens near it. A document's pre-tokens lie in
segments of FAN, the leaves of a tree whose nodes hold sums of characters and tokens. An edit

1. descends to the last pre-token that ends two characters before the edit or earlier,
2. scans the new text from there until it reaches an old boundary behind the edit, from where on
   both scans agree, and encodes only the pre-tokens scanned,
3. replaces them in their segment and renews the sums on the paths above.

A segment that grows to more than GROW times FAN has the tree rebuilt from its leaves, without encoding.
Edits of a document apply in order, each to the text that the ones before it left.

Trees are rows of a table that is kept: build() makes it, one row for each document with its text, its pre-tokens'
lengths and counts, the segments' sizes and the nodes' sums. edited() takes rows with edits and gives the rows as they
are after them, encoding nothing but the touched regions. write() stores a table in buckets of
doc_id; update() applies a batch of edits to it: it reads and rewrites only buckets with an edit, and of these only edited documents
pass through Python.

The vocabulary is a parameter: a file of base64 ranks, by default one of the public vocabularies
installed with the tools; its path must be readable on all executors. A worker keeps the counts of
up to CACHE pre-tokens of at most LONGEST characters.

Cases: null text counts as empty; positions beyond the text's end are cut to it; a null insert is
empty; null edits and null start or stop do nothing; edits of equal seq go by start, stop and insert; strings of
special tokens are ordinary text; repeated rows are edited alike, and rows with a null id by no batch; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, table
from .words import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FAN, GROW, CACHE, LONGEST = 32, 4, 200_000, 64
#: Bytes of texts whose trees a worker holds at once; a longer text is handled alone.
SLICE = 1 << 18
EDITS = "array<struct<start:int,stop:int,insert:string>>"
#: Of a stored table: buckets, and tasks that write one of them.
BUCKETS, SPREAD = 256, 8
ARRAYS = ("lengths", "counts", "sizes", "chars", "tokens")
TREE = "text string, " + ", ".join(f"{a} array<int>" for a in ARRAYS) + ", n_tokens long"


class Counter:
    """Pre-tokens of a text and their numbers of tokens."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.cache: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= LONGEST:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.cache
        out = [known.get(p) for p in pieces]
        return [self.count(p) if n is None else n for n, p in zip(out, pieces, strict=True)] if None in out else out


@lru_cache(2)
def counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


class Tree:
    """A text, its pre-tokens in segments, and sums over them."""

    def __init__(self, text: str, by: Counter):
        self.by, self.text = by, text
        pieces = by.pattern.findall(text)
        self.encoded = 0  # characters encoded by edits
        self._build(list(map(len, pieces)), by.counts(pieces))

    @classmethod
    def stored(cls, row: tuple, by: Counter) -> Tree:
        """A tree from its row: text and ARRAYS."""
        tree = cls.__new__(cls)
        tree.by, tree.encoded = by, 0
        tree.text, lengths, counts, sizes, tree.chars, tree.tokens = row
        tree.base, tree.lengths, tree.counts, at = len(tree.chars) // 2, [], [], 0
        for n in sizes:
            tree.lengths.append(lengths[at : at + n])
            tree.counts.append(counts[at : at + n])
            at += n
        return tree

    def row(self) -> tuple:
        return self.text, [x for s in self.lengths for x in s], [x for s in self.counts for x in s], list(map(len, self.lengths)), self.chars, self.tokens

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        self.lengths = [lengths[i : i + FAN] for i in range(0, len(lengths), FAN)] or [[]]
        self.counts = [counts[i : i + FAN] for i in range(0, len(counts), FAN)] or [[]]
        self.base = 1 << (len(self.lengths) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for k, (a, b) in enumerate(zip(self.lengths, self.counts, strict=True)):
            self.chars[self.base + k], self.tokens[self.base + k] = sum(a), sum(b)
        for k in range(self.base - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The segment that holds character at (the last one for the text's end), and where it begins."""
        k, begin = 1, 0
        while k < self.base:
            k *= 2
            if at >= begin + self.chars[k] and self.chars[k + 1]:
                begin += self.chars[k]
                k += 1
        return k - self.base, begin

    def edit(self, start: int, stop: int, insert: str) -> None:
        n = len(self.text)
        start = min(max(0, start), n)
        stop = min(max(start, stop), n)
        self.text = self.text[:start] + insert + self.text[stop:]
        shift = len(insert) - (stop - start)
        # the last boundary two characters before the edit or earlier
        first, here = self._leaf(max(0, start - 2))
        keep = 0
        while keep < len(self.lengths[first]) and here + self.lengths[first][keep] <= start - 2:
            here += self.lengths[first][keep]
            keep += 1
        # old boundaries from there on, and new pre-tokens until both meet behind the edit
        last, k, old = first, keep, here
        lengths: list[int] = []
        pieces: list[str] = []
        new = here
        if not (old >= stop and new >= start + len(insert)):
            for hit in self.by.pattern.finditer(self.text, here):
                pieces.append(hit[0])
                lengths.append(hit.end() - hit.start())
                new = hit.end()
                if new < start + len(insert):
                    continue
                while old < max(stop, new - shift):
                    while k >= len(self.lengths[last]):
                        last, k = last + 1, 0
                    old += self.lengths[last][k]
                    k += 1
                if old == new - shift:
                    break
            else:
                last, k = len(self.lengths) - 1, len(self.lengths[-1])
        counts = self.by.counts(pieces)
        self.encoded += sum(lengths)
        if first == last:
            self.lengths[first][keep:k], self.counts[first][keep:k] = lengths, counts
        else:
            self.lengths[first][keep:], self.counts[first][keep:] = lengths, counts
            for i in range(first + 1, last):
                self.lengths[i], self.counts[i] = [], []
            del self.lengths[last][:k], self.counts[last][:k]
        if len(self.lengths[first]) > GROW * FAN:
            self._build([x for s in self.lengths for x in s], [x for s in self.counts for x in s])
            return
        low, high = self.base + first, self.base + last
        for i in range(first, last + 1):
            self.chars[self.base + i], self.tokens[self.base + i] = sum(self.lengths[i]), sum(self.counts[i])
        while low > 1:
            low, high = low // 2, high // 2
            for i in range(low, high + 1):
                self._sum(i)


def _batch(first: list[pa.Array], rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Columns `first`, then the trees' and the numbers that follow them."""
    types = [pa.string(), *[pa.list_(pa.int32())] * len(ARRAYS)]
    types += [pa.int64()] * (len(names) - len(first) - len(types))
    return pa.RecordBatch.from_arrays([*first, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)


def _built(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counter(vocabulary)
        for batch in batches:
            for at, to in slices(batch.column("text"), SLICE):
                part = batch.slice(at, to - at)
                trees = [Tree(t or "", by) for t in part.column("text").to_pylist()]
                yield _batch([part.column("doc_id")], [(*t.row(), t.total) for t in trees], ["doc_id", "text", *ARRAYS, "n_tokens"])

    return run


def _lists(column: pa.Array) -> list[list[int]]:
    flat, ends = column.flatten().to_numpy().tolist(), [0, *column.value_lengths().to_numpy().cumsum().tolist()]
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _edited(vocabulary: str, more: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = counter(vocabulary)
        for batch in batches:
            for at, to in slices(batch.column("text"), SLICE):
                part = batch.slice(at, to - at)
                out = []
                columns = [part.column("text").to_pylist(), *(_lists(part.column(a)) for a in ARRAYS)]
                for edits, *row in zip(part.column("edits").to_pylist(), *columns, strict=True):
                    tree, n = Tree.stored(row, by), 0
                    for e in edits or ():
                        if e and e["start"] is not None and e["stop"] is not None:
                            tree.edit(e["start"], e["stop"], e["insert"] or "")
                            n += 1
                    out.append((*tree.row(), tree.total, n, tree.encoded))
                first = ["doc_id", *more]
                yield _batch([part.column(c) for c in first], out, [*first, "text", *ARRAYS, "n_tokens", "n_edits", "encoded_chars"])

    return run


def build(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Trees of docs (doc_id, text): doc_id and TREE."""
    return docs.select("doc_id", "text").mapInArrow(_built(vocabulary), f"doc_id {dict(docs.dtypes)['doc_id']}, {TREE}")


def edited(trees: DataFrame, vocabulary: str = VOCABULARY, more: tuple[str, ...] = ()) -> DataFrame:
    """Trees after their edits, of rows of trees with a column of EDITS: doc_id, the columns `more`, TREE, n_edits and encoded_chars, the characters encoded for them."""
    plain = trees.select("doc_id", *more, F.col("edits").cast(EDITS), "text", *ARRAYS)
    kinds = dict(trees.dtypes)
    first = ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", *more))
    return plain.mapInArrow(_edited(vocabulary, more), f"{first}, {TREE}, n_edits long, encoded_chars long")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows of trees with an edit (doc_id, seq, start, stop, insert), with their edits as an array in order of seq."""
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "insert"))).alias("edits"))
    lists = lists.select("doc_id", F.transform("edits", lambda e: F.struct(e["start"], e["stop"], e["insert"])).cast(EDITS).alias("edits"))
    return trees.join(lists, "doc_id")


def bucket(doc_id: Column, text: Column | None = None) -> Column:
    """The bucket of a document; those without an id, which no edit can name, go by their texts."""
    number = F.xxhash64(doc_id) if text is None else F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id))
    return F.pmod(number, F.lit(BUCKETS)).cast("int")


def write(trees: DataFrame, path: str, overwrite: bool = False) -> None:
    """Stores trees in buckets; with overwrite only in place of the buckets that it has rows of."""
    rows = trees.withColumn("bucket", bucket(F.col("doc_id"), F.col("text"))).repartition("bucket", F.pmod(F.xxhash64("text"), F.lit(SPREAD)))
    to = rows.write.partitionBy("bucket")
    (to.mode("overwrite").option("partitionOverwriteMode", "dynamic") if overwrite else to).parquet(path)


def update(spark: SparkSession, path: str, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Applies a batch of edits to stored trees; returns doc_id, n_edits, n_tokens and encoded_chars of the edited documents."""
    # at most BUCKETS numbers
    touched = [r[0] for r in edits.where("doc_id is not null").select(bucket(F.col("doc_id"))).distinct().collect()]
    trees = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
    changed = cut(edited(with_edits(trees, edits), vocabulary), "edited")
    kept = trees.join(edits.select("doc_id").distinct(), "doc_id", "left_anti")
    whole = cut(kept.unionByName(changed.select(*kept.columns)), "trees")
    write(whole, path, overwrite=True)
    drop(whole)
    return changed.select("doc_id", "n_edits", "n_tokens", "encoded_chars")


def op5_tokens(spark, sf_dir):
    """Keeps the trees of all documents and applies two batches of edits to each.

    First an insertion at a third, a replacement in the middle and a deletion at two thirds, then an insertion in the middle.
    """
    put = lambda a, b, s: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), F.lit(s).alias("insert"))
    n = F.length("text")
    third, half, two = F.floor(n / 3), F.floor(n / 2), F.floor(2 * n / 3)
    trees = cut(build(table(spark, sf_dir, "documents")), "trees", compression="zstd").withColumn("before", F.col("n_tokens"))
    one = edited(trees.withColumn("edits", F.array(put(third, third, " (revised 2024)\n"), put(half, half + 9, "it's "), put(two, two + 14, ""))), more=("before",))
    one = one.withColumns({"after": F.col("n_tokens"), "length_1": n.cast("long"), "edits_1": F.col("n_edits"), "encoded_1": F.col("encoded_chars")})
    two_ = edited(one.withColumn("edits", F.array(put(half, half, " once more"))), more=("before", "after", "length_1", "edits_1", "encoded_1"))
    names = {"before": "n_tokens", "edits_1": "n_edits", "after": "n_tokens_after", "length_1": "n_chars_after", "encoded_1": "encoded_chars"}
    return two_.select("doc_id", *(F.col(c).alias(a) for c, a in names.items()), F.col("n_tokens").alias("n_tokens_second"), F.col("encoded_chars").alias("encoded_second"))
