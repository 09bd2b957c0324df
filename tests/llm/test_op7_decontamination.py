import re

import numpy as np
import pyarrow as pa
import pytest
from latticework.llm import op7_decontamination as m

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def bag(w, k):
    out = {}
    for i in range(len(w) - k + 1):
        out[tuple(w[i : i + k])] = out.get(tuple(w[i : i + k]), 0) + 1
    return out


def jaccard(a, b):
    both = sum(min(n, b.get(k, 0)) for k, n in a.items())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = words(text)
        own = {k: set(bag(w, k)) for k in range(1, 6)}
        for i, item in items:
            v = words(item)
            if not v or len(w) < min(5, len(v)):
                continue
            k, n = min(5, len(v)), min(len(v), len(w))
            target = bag(v, k)
            if own[k].isdisjoint(target):  # no window has any similarity
                continue
            best = max(jaccard(bag(w[s : s + n], k), target) for s in range(len(w) - n + 1))
            if best >= 0.8:
                out[d, i] = round(best, 9)
    return out


def test_small(spark):
    r = np.random.RandomState(3)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary, n))
    items = [(i, text(n)) for i, n in enumerate((30, 30, 45, 12, 4, 1))] + [(20, None), (21, ""), (22, "  ")]
    items[5] = (5, "Unique")
    docs = [(i, text(200)) for i in range(20)]
    for i in range(20, 40):
        w = text(150).split()
        own = items[i % 3][1].split()
        for _ in range(i % 5):
            own[r.randint(len(own))] = "CHANGED"
        if i % 2:
            del own[r.randint(len(own))]
        docs.append((i, "\n".join([" ".join(w[:60]), " ".join(own).upper(), " ".join(w[60:])])))
    docs += [(50, None), (51, ""), (52, items[0][1]), (53, " ".join(items[0][1].split()[:-2])), (54, "x unique y"), (55, items[4][1]), (None, items[1][1]), (56, "a a a " * 500)]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, similarity int")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in m.contaminated(df, it).collect()}
    assert got == brute(docs, items)
    again = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in m.contaminated(df, it, chunk=2).collect()}
    assert again == got
    left = m.clean(df, it)
    assert left.columns == df.columns and {x.doc_id for x in left.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert m.contaminated(df, it.limit(0)).count() == 0 and m.contaminated(df.limit(0), it).count() == 0


def test_table(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(x) for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(x) for x in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in m.op7_decontamination(spark, d).collect()}
    assert got == brute(docs, items)


def test_every_fingerprint_within_the_radius():
    r = np.random.RandomState(1)
    index = m.Index(pa.array(range(50)), [" ".join(f"x{r.randint(9999)}" for _ in range(20)) for _ in range(50)])
    for distance in (0, 1, 8, 16, m.RADIUS):
        bits = np.unpackbits(index.prints.view(np.uint8), axis=1)
        for row in bits:
            row[r.choice(m.BITS, distance, replace=False)] ^= 1
        w, i = index.near(np.packbits(bits, axis=1).view(np.uint16))
        assert set(zip(range(50), range(50))) <= set(zip(w.tolist(), i.tolist()))


def test_windows_at_the_threshold_lie_within_the_radius():
    """5,000 pairs at a similarity of 0.80 to 0.83: windows of 45 shingles, of which 5 at most differ."""
    r = np.random.RandomState(8)
    far = 0
    for _ in range(5000):
        a = r.randint(0, 1 << 62, 45).astype(np.uint64)
        b = a.copy()
        b[:5] = r.randint(0, 1 << 62, 5).astype(np.uint64)
        assert m.similarity(a, b) >= 0.8
        x, y = (m.fingerprint(m.bits_of(s).sum(axis=0)) for s in (a, b))
        far += int(np.bitwise_count(x ^ y).sum()) > m.RADIUS
    assert far <= 2


def test_ids_of_other_types(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.sql(f"select cast('2024-01-01' as date) doc_id, '{text}' text")
    items = spark.sql(f"select cast(7 as smallint) item_id, '{text}' text")
    assert [(str(r.doc_id), r.item_id) for r in m.contaminated(docs, items).collect()] == [("2024-01-01", 7)]


if __name__ == "__main__":
    pytest.main([__file__, "-x", "-q"])


def test_far_windows_of_a_long_text():
    """An item at both ends of a long text: the words between are not counted for it, and the first window is returned."""
    import tracemalloc

    r = np.random.RandomState(5)
    item = " ".join(f"i{x}" for x in r.randint(0, 10_000, 40))
    filler = " ".join(f"w{x}" for x in r.randint(0, 50_000, 150_000))
    index = m.Index(pa.array([9]), [item])
    texts = pa.array([f"{item} {filler} {item}", f"{filler} {item} {item.replace('i', 'j', 1)}"])
    tracemalloc.start()
    found = m.found_in(index, texts, 0.8)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert found == [(0, 0, 1.0, 0, 40), (1, 0, 1.0, 150_000, 40)]
    assert most < 100 << 20
