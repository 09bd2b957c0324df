import hashlib
import re

import pytest
import xxhash

from latticework.llm import op12_fingerprints as op

from .helpers import TINY

SCHEMA = "doc_id long, text string, block string"


def shingle_hashes(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if 0 < len(words) < op.SIZE:
        runs = [[" ".join(words)]]
    else:
        runs = [words[i : i + op.SIZE] for i in range(len(words) - op.SIZE + 1)]
    out = set()
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        out.add(h if h < 1 << 63 else h - (1 << 64))
    return out


def brute_print(text):
    """Bins one by one, empty ones by attempts one by one."""
    bins = {}
    for h in shingle_hashes(text):
        b = (h >> 56) + 128
        bins[b] = min(h, bins.get(b, h))
    if not bins:
        return ""
    out = []
    for i in range(op.BINS):
        b = i
        t = 0
        while b not in bins and t < op.TRIES:
            t += 1
            b = op.attempt(i, t)
        if b not in bins:
            b = min(bins, key=lambda o: (((i * op.BINS + o + 1) * op.SHIFT) % op.PRIME, bins[o] & 255))
        out.append(f"{bins[b] & 255:02x}")
    return "".join(out)


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    texts = [r[1] or "" for r in rows]
    prints = [brute_print(t) for t in texts]
    out = []
    for k, t in enumerate(texts):
        n = (k + 1) % len(rows)
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[n][:half]
        p = brute_print(edited)

        def near(a, b):
            if a == b or not a or not b:
                return float(a == b)
            s = sum(a[2 * i : 2 * i + 2] == b[2 * i : 2 * i + 2] for i in range(op.BINS)) / op.BINS
            return max(0.0, (s - 1 / 256) / (1 - 1 / 256))

        out.append((rows[k][0], len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[k], p, round(near(prints[k], p), 12), round(near(prints[k], prints[n]), 12)))
    return sorted(out, key=repr)


def of(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 12), round(r.near_next, 12)) for r in df.collect()), key=repr)


ODD = [
    (-5, "", "x"),
    (-4, None, "x"),
    (-3, "one", None),
    (-2, "𝄞 two  words\n", "x"),
    (-1, "ONE", "x"),
    (10_000_001, "a b c d e f g " * 3000, "x"),
    (10_000_001, "a b c d e f g " * 3000, "x"),
    (10_000_002, "same words here and there", "x"),
    (10_000_003, "same words here and there", "x"),
    (None, "no id", "x"),
    (None, "no id either", "x"),
]


@pytest.mark.parametrize("rows_of_block", [op.ROWS, 7])
def test_against_brute_force(spark, rows_of_block):
    docs = [(r.doc_id, r.text, "x") for r in spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").collect()] + ODD
    assert of(op.fingerprints(spark.createDataFrame(docs, SCHEMA), rows_of_block)) == brute(docs)


def test_few_rows(spark):
    for docs in ([], [(1, "a single text of some words", "x")], [(None, None, None)]):
        assert of(op.fingerprints(spark.createDataFrame(docs, SCHEMA))) == brute(docs)


def test_one_hot_id_lies_in_many_blocks(spark):
    docs = [(7, "copy of a text with more than five words", "x")] * 300 + [(k, f"text {k} is a document of its own kind", "x") for k in range(20)]
    frame = spark.createDataFrame(docs, SCHEMA)
    assert of(op.fingerprints(frame, 10)) == brute(docs)


def test_likeness_estimates_the_similarity_of_shingles(spark):
    base = [f"w{i}" for i in range(1200)]
    docs, truth = [], {}
    for k, cut in enumerate((0, 100, 300, 600, 900, 1200)):
        other = base[cut:] + [f"x{k}_{i}" for i in range(cut)]
        docs += [(2 * k, " ".join(base), "x"), (2 * k + 1, " ".join(other), "x")]
        a, b = shingle_hashes(" ".join(base)), shingle_hashes(" ".join(other))
        truth[2 * k] = len(a & b) / len(a | b)
    for r in op.fingerprints(spark.createDataFrame(docs, SCHEMA)).collect():
        if r.doc_id in truth:
            assert abs(r.near_next - truth[r.doc_id]) < 0.11
