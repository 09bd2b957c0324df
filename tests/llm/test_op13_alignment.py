import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from latticework.llm import op13_alignment as op

from .helpers import TINY

SCHEMA = "doc_id long, text string, n_a string"
ODD = [
    (900001, "", "x"),
    (900002, None, None),
    (900003, "a▁b c", "x"),
    (900004, "  two  spaces \n\n and\ttabs ", "x"),
    (900005, "<|endoftext|> <s> \x00 é 𝄞   a\x1cb don't　x", "x"),
    (900006, "\n", "x"),
    (900007, " ", "x"),
    (900008, "word " * 4000, "x"),
    (900009, "same text", "x"),
    (900009, "same text", "x"),
    (None, "same text too", "x"),
]


def brute(texts):
    """From the definition, whole texts, byte by byte."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(op.A_FILE)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=op.B_FILE)
    by = op.both(op.A_FILE, op.B_FILE)
    entry = [[s.data[f : f + n].tobytes() for f, n in zip(s.first, s.size)] for s in by.sides]
    docs = []
    for t in texts:
        ids = [a_model.encode(" " + (t or ""), add_special_tokens=False).ids, b_model.encode(t or "")]
        if not t or any(b"".join(entry[k][i] for i in ids[k]) != b" " + t.encode() for k in (0, 1)):
            docs.append(None)
            continue
        at = [[0], [0]]
        for k in (0, 1):
            for i in ids[k]:
                at[k].append(at[k][-1] + len(entry[k][i]))
        links, i, j = [], 0, 0
        while i < len(ids[0]) and j < len(ids[1]):
            links.append((ids[0][i], ids[1][j]))
            e, f = at[0][i + 1], at[1][j + 1]
            i, j = i + (e <= f), j + (f <= e)
        ends = sorted(set(at[0][1:]) & set(at[1][1:]))
        shown, low = [], 0
        for e in ends:
            shown.append("|".join(",".join(str(x) for x, z in zip(ids[k], at[k][1:]) if low < z <= e) for k in (0, 1)))
            low = e
        docs.append((len(ids[0]), len(ids[1]), len(ends), links, ";".join(shown)))
    count = Counter(p for d in docs if d for p in set(d[3]))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        na, nb, ng, links, shown = d
        out.append((na, nb, ng, len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(shown.encode()).hexdigest()))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("sent", [op.SENT, 300, 0])
def test_against_brute_force(spark, sent):
    some = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text").where(F.length("text") < 4000).collect()
    rows = [(r.doc_id, r.text, "x") for r in some] + ODD
    got = op.alignment(spark.createDataFrame(rows, SCHEMA), sent=sent).collect()
    want = brute([r[1] for r in rows])
    assert sorted(((r.doc_id, *(r[c] for c in NAMES)) for r in got), key=repr) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    zero = {r.doc_id for r in got if not r.n_a}
    assert zero == {900001, 900002, 900003}


def test_empty_table(spark):
    assert op.alignment(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chunks_give_the_tokens_of_whole_texts():
    import random

    import sentencepiece
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(op.A_FILE)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=op.B_FILE)
    draw = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "Zug", "'s", "12", "é", "漢", "▁x", ".", " ", " ", "\x1f", "the", "𝄞", "́"]
    texts = ["".join(draw.choices(parts, k=draw.randint(1, 40))) for _ in range(1500)]
    by = op.both(op.A_FILE, op.B_FILE)
    numbers, many = by.chunks(texts)
    for k, encode in ((0, lambda t: whole.encode(" " + t, add_special_tokens=False).ids), (1, pieces.encode)):
        at = 0
        for t, n in zip(texts, many):
            if k == 0 or "▁" not in t:  # a mark of a space in the text leaves the document without tokens
                assert by.tokens(k, numbers[at : at + n])[0].tolist() == list(encode(t)), t
            at += n
