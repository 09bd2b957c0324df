from itertools import product

import numpy as np
import pytest
from latticework.llm import op2_language as m


def test_forward_backward_against_all_paths():
    r = np.random.RandomState(2)
    score, move = r.randn(3, 5, 3), r.randn(3, 3)
    live = np.arange(5)[None, :] < np.array([5, 3, 1])[:, None]
    post, moves, logz = m.forward_backward(score, live, move)
    expected = np.zeros((3, 3))
    for c in range(3):
        n = live[c].sum()
        paths = list(product(range(3), repeat=n))
        value = np.array([sum(score[c, i, y] for i, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths])
        p = np.exp(value - value.max())
        assert np.isclose(logz[c], np.log(p.sum()) + value.max())
        p /= p.sum()
        for i in range(n):
            assert np.allclose(post[c, i], [sum(q for q, path in zip(p, paths) if path[i] == y) for y in range(3)])
        for q, path in zip(p, paths):
            for a, b in zip(path, path[1:]):
                expected[a, b] += q
    assert np.allclose(moves, expected)


def test_pieces_give_the_posteriors_of_whole_chains():
    """Chains of 1 to 300 words with strong transitions, cut into pieces of 7, against one forward-backward over each."""
    r = np.random.RandomState(4)
    for k in (1, 2, 4):
        sizes, move = [1, 7, 8, 300, 14, 3, 61], 6 * r.randn(k, k)
        scores = [9 * r.randn(n, k) for n in sizes]
        pieces = np.array([-(-n // 7) for n in sizes])
        grid, live = np.zeros((pieces.sum(), 7, k)), np.zeros((pieces.sum(), 7), dtype=bool)
        for s, begin in zip(scores, np.cumsum(pieces) - pieces):
            place = np.arange(len(s))
            grid[begin + place // 7, place % 7] = s
            live[begin + place // 7, place % 7] = True
        got = m.whole_chains(grid, live, pieces, move)
        for s, begin in zip(scores, np.cumsum(pieces) - pieces):
            want = m.forward_backward(s[None], np.ones((1, len(s)), dtype=bool), move)[0][0]
            place = np.arange(len(s))
            assert np.allclose(got[begin + place // 7, place % 7], want)


def test_labels_do_not_depend_on_the_size_of_pieces(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = m.learn(docs, sample=100)
    text = " ".join(r.text for r in docs.orderBy("doc_id").limit(12).collect())
    whole = m.word_labels(model, text)
    monkeypatch.setattr(m, "CHAIN", 5)
    again = m.word_labels(model, text)
    assert [x[:2] for x in whole] == [x[:2] for x in again] and np.allclose([x[2] for x in whole], [x[2] for x in again])


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = m.op2_language(spark, d).toPandas().merge(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert len(out) == 1000 and 150 < len(held) < 250
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()


def test_code_switching_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = m.learn(docs, sample=200)
    texts = {r.lang: r.text for r in docs.where("length(text) between 300 and 900").collect()}
    both = " ".join(texts["en"].split()[:30] + texts["fr"].split()[:30])
    labels = [x for _, x, _ in m.word_labels(model, both)]
    assert labels[:30].count("en") > 24 and labels[30:].count("fr") > 24
    odd = spark.createDataFrame([(1, None, None, 1), (2, "", None, 2), (3, "12 34 !!", None, 3), (None, texts["en"], "en", 4), (4, texts["en"] * 60, None, 5), (4, texts["en"] * 60, None, 5)], "doc_id long, text string, lang string, score int")
    rows = m.predicted(odd, model).toPandas()
    assert list(rows.lang_pred) == ["und", "und", "und", "en", "en", "en"] and list(rows.score[:3]) == [0, 0, 0]
    kept = m.accepted(odd)
    assert kept.columns == odd.columns and kept.count() in (0, 3)
    none = m.predicted(odd, m.learn(odd.where("doc_id = 1")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert m.predicted(odd.limit(0), model).count() == 0


if __name__ == "__main__":
    pytest.main([__file__, "-x", "-q"])
