import hashlib
import random
import zlib

import pytest

from latticework.llm import op11_trie as op

from .helpers import TINY, of, oracle

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """From the definition: every prefix is a key, sums go to all ancestors one by one."""
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [t for _, _, t in sorted(ts, key=lambda x: x[:2])] for c, ts in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        made[c] = own.get(base, [])[:h] + own[c][h:]
    members = {}
    for c, ts in made.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(made[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, turns, monkeypatch=None):
    each = op.sequences(spark.createDataFrame(rows, SCHEMA))
    return sorted((tuple(r[c] for c in NAMES) for r in op.trie(op.rebuilt(op.cut(each)), turns).collect()), key=repr)


def random_rows(seed, convs=160):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(draw.choice([1, 1, 2, 3, 5, 9, 14])):
            rows.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["a", "bé", "", None, "longer text", "𝄞"]), "x"))
    rows += [(250 + k, t, "user", "the same", "x") for k in range(60) for t in range(7)]  # copies
    rows += [(400, None, "user", "first", "x"), (400, 0, "user", "tie", "x"), (400, 0, "user", "tie", "x"), (400, 0, "user", "other", "x")]
    rows += [(-7, 0, "user", "negative", "x"), (-150, 0, "user", "base absent", "x"), (None, 0, "user", "nobody's", "x"), (10**15 + 1, 3, "user", "x", None)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("turns", [op.TURNS, 40, 5])
def test_against_brute_force(spark, turns):
    rows = random_rows(turns)
    assert got(spark, rows, turns) == brute(rows)


def test_pieces_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(op, "PIECE", 4)
    rows = random_rows(9, 30)
    assert got(spark, rows, 50) == brute(rows)


def test_conversations_without_turns(spark):
    """A conversation all of whose turns come before h, with no first of its hundred, keeps none: the root's member."""
    few = [c for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6 >= 2][:5]
    rows = [(c, 0, "user", f"text {c}", "x") for c in few]
    assert got(spark, rows, op.TURNS) == brute(rows) == [(few[0], 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, few)).encode()).hexdigest())]
    assert got(spark, [], op.TURNS) == []


def test_long_conversation(spark):
    rows = [(0, t, "user", f"{t % 7}", "x") for t in range(300)] + [(100, t, "user", f"{t % 7}", "x") for t in range(290)]
    assert got(spark, rows, 100) == brute(rows)


def test_against_sql(spark):
    assert of(op.op11_trie(spark, TINY)) == oracle(op.SQL)


def test_shards_agree_with_one_tree():
    draw = random.Random(3)
    made = sorted({tuple(draw.choices(range(4), k=draw.randint(0, 6))) for _ in range(300)})
    rows = [(list(s), [x + 1 for x in s], draw.randint(1, 4), i, f"e{i}") for i, s in enumerate(made)]
    whole = op.shard_nodes(rows, -1, -1)
    assert len(whole) == len({s[:d] for s in made for d in range(len(s) + 1)})
    assert whole[0][5] == sum(r[2] for r in rows)


def test_medians():
    for n in range(40):
        assert sorted(op.medians(n)) == list(range(n))
