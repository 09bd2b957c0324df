import re

import numpy as np
from latticework.llm import op10_minhash as m

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sets(rows, k):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, k, percent):
    s = sets(rows, k)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and 100 * min(len(s[i]), len(s[j])) >= percent * max(len(s[i]), len(s[j])):
                both = len(s[i] & s[j])
                if 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                    label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 1 << 60), d)
    return {rows[i][0]: (len(s[i]), low[find(i)]) for i in range(len(rows))}


def near(rows, spark, k, percent):
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, source string, h1 int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in m.membership(df, k, percent).collect()}
    assert got == brute(rows, k, percent)
    kept = m.keep_one(df, k, percent)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (n, c) in got.items() if n == 0 or d == c)


def made():
    r = np.random.RandomState(5)
    words = [f"w{i}" for i in range(400)]
    rows, base = [], list(r.choice(words, 120))
    for i in range(330):  # a large group of near copies, some beyond the threshold of each other
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randint(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    passage = " ".join(r.choice(words, 80))
    rows += [(1000 + i, passage + " " + " ".join(r.choice(words, 60))) for i in range(60)]
    rows += [(2000 + i, "Same  text here again\n") for i in range(50)]
    rows += [(3000, None), (3001, ""), (3002, " \t\n"), (3003, "one"), (3004, "ONE"), (3005, "one two"), (3006, "é " * 5), (3007, "z " * 20_000)]
    return rows


def test_groups(spark):
    near(made(), spark, 3, 85)


def test_table_at_five_words(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    near(rows, spark, 5, 80)


def test_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t"), (None, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in m.membership(df).collect() if r.doc_id is not None)
    assert got == [(1, 1), (1, 1)]
    assert sorted(str(r.text) for r in m.keep_one(df).collect()) == ["None", "a b c d", "q r s t"]
    assert m.membership(df.limit(0)).count() == 0 and m.keep_one(df.limit(0)).count() == 0


def prose(seed, n=80):
    r = np.random.RandomState(seed)
    return [f"v{x}" for x in r.randint(0, 5000, n)]


def test_ids_only_name_what_comes_out(spark):
    """Near copies with null ids are compared; texts that share an id keep groups of their own."""
    base, other, third = prose(1), prose(2), prose(3)
    near_ = [" ".join([*base[:k], "changed", *base[k:]]) for k in (20, 40, 60)]
    rows = [(None, x) for x in near_] + [(7, " ".join(other)), (7, " ".join(third)), (3, " ".join(["new", *other])), (9, " ".join(["new", *third]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.text: r for r in df.join(m.membership(df), "doc_id").collect()}
    assert len(got) == 4
    groups = sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in m.membership(df).collect())
    assert groups == sorted([(0, 0, 79)] * 3 + [(7, 3, 78), (7, 7, 78), (3, 3, 79), (9, 7, 79)])
    kept = sorted((r.doc_id or 0, r.text) for r in m.keep_one(df, 3, 85).collect())
    assert [d for d, _ in kept] == [0, 3, 7] and kept[2][1] == " ".join(third) and kept[0][1] in near_


def test_small_blocks_and_hot_keys(spark, monkeypatch):
    from latticework.llm import common

    monkeypatch.setattr(m, "BLOCK", 7)
    monkeypatch.setattr(m, "BYTES", 3000)
    monkeypatch.setattr(common, "PART", 20)
    near(made(), spark, 3, 85)


def test_estimate():
    r = np.random.RandomState(1)
    for share in (0.5, 0.85, 1.0):
        common, own = r.randint(0, 1 << 62, 4000), r.randint(0, 1 << 62, 4000)
        n = int(4000 * (1 / share - 1) / 2)
        a = np.concatenate([common, own[:n]]).astype(np.uint64)
        b = np.concatenate([common, own[2000 : 2000 + n]]).astype(np.uint64)
        p = m.pack(m.minima(np.concatenate([a, b]), np.array([0, len(a)])))
        assert abs(m.estimate(p[0], p[1]) - share) < 0.15
