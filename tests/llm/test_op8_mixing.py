import heapq
import math
import random
import re
from collections import defaultdict

from latticework.llm import op8_mixing as m


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, cap, out = sum(sizes.values()), {s: 3 * n for s, n in sizes.items()}, {}
    free = set(sizes)
    while free:
        left = total - sum(out.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap[s]]
        if not over:
            return out | {s: left * weight[s] / w for s in free}
        for s in over:
            out[s] = cap[s]
        free -= set(over)
    return out


def held(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, taken int, size string")
    got = m.mixed(docs, **options).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(33, 0.01 * t), (s, taken[s], t)
    again = m.mixed(docs.repartition(3), **options).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    return got


def test_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source").collect()]
    held(spark, rows, shard=500)


def test_odd_rows(spark):
    rows = [(i, "w " * (i % 50), "big") for i in range(400)] + [(i, "a b c", "small") for i in range(3)] + [(None, "x y", None), (None, "x y", None), (900, None, "empty"), (901, "", "empty"), (902, "w " * 30_000, "long")]
    held(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert m.mixed(docs.limit(0)).count() == 0
    carried = m.mixed(docs.withColumn("size", docs.doc_id), carry=True)
    assert carried.columns == ["doc_id", "text", "source", "doc_size", "size", "source_size", "target", "taken"] and carried.count() == len(rows)
    assert {r.taken for r in m.mixed(docs.where("source = 'empty'")).collect()} == {0}


def by_quotients(wish, seats, room):
    """Seats by the highest quotients, a party having room for room[s]; a heap of each party's next quotient."""
    given = dict.fromkeys(wish, 0)
    queue = [(-w, s) for s, w in sorted(wish.items()) if room[s] > 0]
    heapq.heapify(queue)
    for _ in range(seats):
        if not queue:
            break
        _, s = heapq.heappop(queue)
        given[s] += 1
        if given[s] < room[s]:
            heapq.heappush(queue, (-wish[s] / (2 * given[s] + 1), s))
    return given


def wishes():
    r = random.Random(3)
    yield {s: float(3 + 17 * s % 91 + s * s) for s in range(40)}, (0, 1, 100)
    yield {0: 3000.0} | {s: 1.4 for s in range(1, 61)}, (3084, 5)
    yield {0: 1000.0} | {s: 0.6 for s in range(1, 1001)}, (1600,)
    yield {0: 5e6} | {s: float(r.randint(1, 900)) for s in range(1, 4000)}, (90_000,)
    yield {s: 5.0 for s in range(50)}, (7,)


def test_seats_of_sources_are_those_of_highest_quotients(spark):
    for wish, all_seats in wishes():
        for seats in all_seats:
            for unit, most in ((1, 10**6), (2, 1))[: 1 if len(wish) == 40 else 2]:
                df = spark.createDataFrame([(s, int(w + 1), w) for s, w in wish.items()], "sid long, source_size long, target double")
                room = {s: int(int(w + 1) * most / unit + 0.5) for s, w in wish.items()}
                got = dict.fromkeys(wish, 0) | {r.sid: r.given for r in m.seats_of_sources(df, seats, unit, most).collect()}
                assert got == by_quotients(wish, seats, room)


def test_seats_of_shards_are_those_of_highest_quotients(spark):
    cases = [({s: int(w + 1) for s, w in wish.items()}, seats) for wish, all_seats in wishes() for seats in all_seats]
    rows = [(g, s, n, seats) for g, (sizes, seats) in enumerate(cases) for s, n in sizes.items()]
    got = {(r.sid, r.shard): r.given for r in m.seats_of_shards(spark.createDataFrame(rows, "sid long, shard long, n long, seats long")).collect()}
    for g, (sizes, seats) in enumerate(cases):
        want = by_quotients({s: float(n) for s, n in sizes.items()}, seats, dict.fromkeys(sizes, 10**9))
        assert {s: got[g, s] for s in sizes} == want


def test_steps_are_seeded_and_prime_to_the_pieces(spark):
    df = spark.createDataFrame([(s, h, k) for s in range(3) for h in range(40) for k in (1, 2, 3, 6, 210, 30030, 1563)], "sid long, shard long, m long")
    rows = m._permuted(df, "a").collect()
    assert all(math.gcd(r.step, r.m) == 1 for r in rows)
    assert len({r.step for r in rows if r.m == 1563}) > 90 and all(500 < r.step < 1100 for r in rows if r.m == 1563)
    assert [r.step for r in m._permuted(df, "b").collect()] != [r.step for r in rows]


def test_one_small_source_leaves_blocks_as_they_are(spark):
    """40 words of its own take less than a block; the others are still cut in blocks of 64."""
    rows = [(i, "w " * 500, "a") for i in range(300)] + [(i, "w " * 500, "b") for i in range(300)] + [(9999, "w " * 40, "c")]
    picks = m.selected(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=64).collect()
    inner = {x.end - x.begin for r in picks if r.source == "b" for x in r.ranges if x.begin > 0 and x.end < r["size"]}
    assert inner <= {63, 64, 65} and len(inner) > 0


def test_equal_caps(spark):
    """Sources of equal cap / weight: the level is that of the first of them."""
    held(spark, [(i, "w " * 100, "a") for i in range(50)] + [(i, "w " * 100, "b") for i in range(20)] + [(i, "w " * 100, "c") for i in range(10)])


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(m, "SENT", 3)
    held(spark, [(i, "w " * (i % 90), f"s{i % 9}" if i % 3 else "hot") for i in range(900)])


def remade(text, ranges):
    words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    return "\n".join("".join("".join(words[x.begin : x.end]) for x in ranges if x.times >= t) for t in range(1, max(x.times for x in ranges) + 1))


def test_selection_and_its_texts(spark):
    """Texts hold the taken words as often as they are taken, so the sources' words are at their targets."""
    rows = [(i, "  " + " ".join(f"w{i}_{k}" + "\t" * (k % 3) for k in range(i % 60)), "a small" if i % 7 == 0 else "b big") for i in range(700)]
    rows += [(800, "é😀 " * 20_000, "b big"), (801, None, "a small"), (None, " x  y\nz ", None), (None, " x  y\nz ", None)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n_chars int, taken string")
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    picks = {r.row.doc_id: r for r in m.selected(docs, carry=True).collect() if r.row.doc_id is not None}
    got = m.remade(docs).collect()
    assert m.remade(docs).columns == ["doc_id", "text", "source", "n_chars", "doc_taken", "size", "source_size", "target", "taken"]
    total, goal = defaultdict(int), {}
    for r in got:
        assert r.taken == count(r.text) > 0 and r.n_chars == len(r.text) and r.doc_taken == "x"
        total[r.source] += count(r.text)
        goal[r.source] = r.target
        if r.doc_id is not None:
            p = picks[r.doc_id].ranges
            assert all(x.end <= y.begin for x, y in zip(p, p[1:])) and p[0].begin >= 0 and p[-1].end <= r["size"]
            assert r.text == remade(rows[r.doc_id][1] if r.doc_id < 700 else rows[700][1], p)
    assert set(goal) == {"a small", "b big"}  # the words of the null source are less than a third of a block
    assert all(abs(total[s] - t) <= max(33, 0.01 * t) for s, t in goal.items()), (total, goal)
    assert {d for d, p in picks.items() if p.ranges} == {r.doc_id for r in got if r.doc_id is not None}
    assert any(x.times > 1 for p in picks.values() for x in p.ranges)
    long = next(r for r in got if r.doc_id == 800)
    assert long.taken != long["size"]
