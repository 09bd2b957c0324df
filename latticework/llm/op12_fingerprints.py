"""Document fingerprints by one-permutation MinHash, with DataFrame functions alone.

A text's words (lower-cased) give shingles of SIZE words, fewer words one shingle. A shingle is hashed once, to 64
bits: the high eight name one of BINS bins, the others are its value there, and a bin keeps its
smallest value. The hashes are sorted together with one mark for each bin, the bin's largest number, so the first
of a bin in that order is its minimum, or the mark if the bin is empty.

Empty bins are filled by optimal densification: a bin has its own random order of the bins, in which it takes
the value of the first that is not empty. The order is a universal hash of bin and attempt for TRIES attempts, then that of a hash of
both bins, so it ends for any text. The fingerprint is the low eight bits of each bin as hex digits.

Likeness of fingerprints is the share s of equal bins, corrected for values that agree in their low bits by
chance, one in 256: (s - 1/256) / (1 - 1/256), at least 0.

A document's next one follows in the order of doc_id (null last), then digest of the text. Rows are cut into blocks of that
order whose bounds are rows of a light table of ids; a row that opens a block goes to the block before as well, so a window in a
block sees every neighbour and texts are shuffled once. A block has about ROWS rows, more where there are over BLOCKS blocks.

Cases: null text is empty; rows of equal doc_id and text follow each other; a text without words has the empty
fingerprint, which is like itself (1) and nothing else (0). A single document is its own next. An empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ordered, table

SIZE, BINS, TRIES = 5, 256, 12
#: The value of a bin's mark.
MARK = (1 << 56) - 1
#: Rows of a block, and blocks at most.
ROWS, BLOCKS = 2_000, 16_384
#: What separates words, as in WORD.
SPACE = r"[\x20\x09-\x0D]+"
#: The universal hash of bin i (from 0) at attempt t: ((i + 1) * (STEP * t + 1) + SHIFT * t) mod PRIME mod BINS.
STEP, SHIFT, PRIME = 40_503, 25_717, 65_537


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value made once for each row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")


def _hashes(w: Column) -> Column:
    last = F.size(w) - SIZE
    many = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SIZE))))
    return F.when(last >= 0, many).when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array().cast("array<long>"))


def _fixed(values: list, kind: str) -> Column:
    """A literal array."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def attempt(i: int, t: int) -> int:
    """The bin that bin i tries at attempt t."""
    return ((i + 1) * (STEP * t + 1) + SHIFT * t) % PRIME % BINS


def _filled(low: Column) -> Column:
    """The bins' low bits as hex digits, with those of empty bins (null) filled. low is a variable, so that it is not made again."""
    full = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: low[b].isNotNull())
    tries = [_fixed([attempt(i, t) for i in range(BINS)], "int") for t in range(1, TRIES + 1)]
    digits = _fixed([f"{x:02x}" for x in range(256)], "string")

    def fill(full: Column) -> Column:
        rank = lambda i, b: ((i * BINS + b + 1) * SHIFT) % PRIME
        best = lambda i: F.array_min(F.transform(full, lambda b: F.struct(rank(i, b).alias("r"), low[b].alias("v"))))["v"]
        each = lambda x, i: F.get(digits, F.coalesce(x, *(low[F.get(p, i)] for p in tries), best(i)))
        return F.when(F.size(full) > 0, F.array_join(F.transform(low, each), "")).otherwise(F.lit(""))

    return _let(full, fill)


def fingerprint(text: Column) -> Column:
    """Hex digits, two for each bin; empty for a text without words."""
    marks = _fixed([(b << 56) | MARK for b in range(-128, 128)], "long")
    name = lambda h: F.shiftright(h, 56)
    firsts = lambda s: F.filter(s, lambda h, i: (i == 0) | (name(h) != name(F.get(s, F.greatest(i - 1, F.lit(0))))))
    low = lambda s: F.transform(firsts(s), lambda h: F.when(h.bitwiseAND(MARK) != MARK, h.bitwiseAND(255).cast("int")))
    of = lambda w: _let(F.array_sort(F.concat(_hashes(w), marks)), lambda s: _let(low(s), _filled))
    return _let(words(text), of)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingles of two texts, from their fingerprints."""
    one = 1.0 / 256
    equal = _let(
        F.struct(F.unhex(a).alias("a"), F.unhex(b).alias("b")),
        lambda x: F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(x["a"], i, F.lit(1)) == F.substring(x["b"], i, F.lit(1)))),
    )
    share = equal / float(BINS)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (share - one) / (1 - one)))


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, text, print (its fingerprint), next_text, next_print."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kept = cut(kept.withColumn("digest", F.md5("text")).withColumn("number", F.monotonically_increasing_id()), "texts", compression="zstd")
    order = ["doc_id is null", "doc_id", "digest", "number"]
    place = F.struct(*(F.expr(x).alias(f"o{i}") for i, x in enumerate(order)))
    ranks = cut(ordered(kept.select(place.alias("o")), [F.col("o")], "rank"), "ranks")
    n = ranks.count()
    per = max(rows, -(-n // BLOCKS))
    opens = ranks.where((F.col("rank") - 1) % per == 0).orderBy("rank").select("o")
    # a row for each block: at most BLOCKS
    held = json.dumps([json.loads(r[0]) for r in opens.select(F.to_json("o")).collect()])
    bounds = F.from_json(F.lit(held), f"array<{ranks.schema['o'].dataType.simpleString()}>")
    blocks = -(-n // per) if n else 1
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(blocks.bit_length()))))
    # the last bound that is not behind the row, by halving
    at = F.aggregate(steps, F.lit(0), lambda at, p: F.when((at + p < blocks) & (F.get(bounds, at + p) <= place), at + p).otherwise(at))
    dealt = kept.withColumn("o", place).withColumn("block", at)
    first = F.col("o") == F.get(bounds, F.col("block"))
    before = F.pmod(F.col("block") - 1, F.lit(blocks))
    copies = F.when(first, F.array(F.struct("block", F.lit(0).alias("tail")), F.struct(before.alias("block"), F.lit(1).alias("tail")))).otherwise(F.array(F.struct("block", F.lit(0).alias("tail"))))
    dealt = dealt.select("doc_id", "text", "o", F.explode(copies).alias("c")).select("doc_id", "text", "o", "c.block", "c.tail")
    # dealt by block first: the window needs no other shuffle, and fingerprints are made after it
    printed = dealt.repartition("block").withColumn("print", fingerprint(F.col("text")))
    line = Window.partitionBy("block").orderBy("tail", "o")
    return printed.withColumns({"next_text": F.lead("text").over(line), "next_print": F.lead("print").over(line)}).where("tail = 0")


def fingerprints(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    half = F.expr("length(text) div 2").cast("int")
    made = with_next(docs, rows).withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    made = made.withColumn("edited_print", fingerprint(F.col("edited")))
    return made.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("edited_print").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )


def op12_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))

