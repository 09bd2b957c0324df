import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from latticework.llm import op5_tokens as m
from latticework.llm.common import new_path

BY = m.counter(m.VOCABULARY)
PIECES = st.text(alphabet=st.sampled_from(list("ab'st ve\n\t  1é!?中😀<|>")), max_size=40)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB' s\n\t 12é!.中")), max_size=700), st.lists(st.tuples(st.integers(0, 700), st.integers(0, 60), PIECES), max_size=12))
def test_edits_equal_a_full_count(text, edits):
    tree = m.Tree(text, BY)
    assert tree.total == len(BY.encoding.encode_ordinary(text))
    for start, size, insert in edits:
        begin = min(start, len(text))
        text = text[:begin] + insert + text[min(len(text), begin + size) :]
        tree.edit(start, start + size, insert)
        assert tree.text == text
        assert tree.total == len(BY.encoding.encode_ordinary(text))
        assert tree.chars[1] == len(text)
        encoded = tree.encoded
        tree = m.Tree.stored(tree.row(), BY)
        tree.encoded = encoded
        assert [len(p) for p in BY.pattern.findall(text)] == [x for s in tree.lengths for x in s]


def test_only_the_surroundings_are_encoded():
    text = "some words of prose, " * 20_000
    tree = m.Tree(text, BY)
    for i in range(50):
        tree.edit(7000 * i, 7000 * i + 3, "new text")
    assert tree.encoded < 50 * 60
    assert tree.total == len(BY.encoding.encode_ordinary(tree.text))


def test_table(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = m.op5_tokens(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        n = len(t)
        assert r.n_tokens == len(BY.encoding.encode_ordinary(t))
        for a, b, s in ((n // 3, n // 3, " (revised 2024)\n"), (n // 2, n // 2 + 9, "it's "), (2 * n // 3, 2 * n // 3 + 14, "")):
            t = t[:a] + s + t[b:]
        assert (r.n_tokens_after, r.n_chars_after, r.n_edits) == (len(BY.encoding.encode_ordinary(t)), len(t), 3)
        half = len(t) // 2
        t = t[:half] + " once more" + t[half:]
        assert r.n_tokens_second == len(BY.encoding.encode_ordinary(t))


EDIT = "doc_id long, seq int, start int, stop int, insert string"


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<|endoftext|> a", "x"), (None, "a b", "x")], "doc_id long, text string, edits string").drop("edits")
    edits = spark.createDataFrame([(1, 2, 0, 9, "b"), (1, 1, 0, 0, "a a"), (3, 1, None, 2, "x"), (3, 2, 99, 100, None), (None, 1, 0, 0, "x")], EDIT)
    trees = m.build(docs)
    n = len(BY.encoding.encode_ordinary("<|endoftext|> a"))
    assert {r.doc_id: r.n_tokens for r in trees.collect()} == {1: 0, 2: 0, 3: n, None: 2}
    got = {r.doc_id: (r.n_edits, r.n_tokens) for r in m.edited(m.with_edits(trees, edits)).collect()}
    assert got == {1: (2, 1), 3: (1, n)}
    assert m.edited(m.with_edits(m.build(docs.limit(0)), edits)).count() == 0
    assert m.edited(m.with_edits(trees, edits.limit(0))).count() == 0


def test_trees_are_kept_over_batches_of_edits(spark):
    """Two batches on a stored table: only what they touch is encoded, and buckets without an edit are not rewritten."""
    texts = {i: f"document {i}: " + "some words of prose, it's long. " * 300 for i in range(60)}
    path = new_path(spark, "stored")
    m.write(m.build(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), path)
    files = lambda: {f for f in spark.read.parquet(path).inputFiles()}
    for batch in ([(3, 1, 100, 105, "new"), (3, 2, 0, 0, "start "), (7, 1, 4000, 4000, " middle ")], [(3, 1, 9000, 9004, ""), (7, 1, 4003, 4003, "x"), (55, 1, 10**6, 10**6, " end")]):
        before = files()
        done = {r.doc_id: r for r in m.update(spark, path, spark.createDataFrame(batch, EDIT)).collect()}
        for d, _, start, stop, insert in batch:
            t = texts[d]
            texts[d] = t[:start] + insert + t[stop:]
        stored = {r.doc_id: r for r in spark.read.parquet(path).collect()}
        assert {d: r.text for d, r in stored.items()} == texts
        assert all(r.n_tokens == len(BY.encoding.encode_ordinary(texts[d])) == r.tokens[1] for d, r in stored.items())
        assert set(done) == {x[0] for x in batch} and all(r.encoded_chars < 60 * r.n_edits for r in done.values())
        buckets = {stored[d].bucket for d in done}
        assert {f for f in before if not any(f"bucket={b}/" in f for b in buckets)} == before & files()


if __name__ == "__main__":
    pytest.main([__file__, "-x", "-q"])
