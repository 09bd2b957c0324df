import hashlib
import re

import pytest
from latticework.llm import op4_pii as m

SIMPLE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def fits(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    out = []
    for kind, pattern in SIMPLE.items():
        out += [f"{kind}:{x.start()}:{x.end()}" for x in re.finditer(pattern, text or "") if fits(kind, x[0])]
    return out


TEXTS = [
    None, "", "   ", "a@b.c+d@e.f", "1.2.3.4.5.6.7.8", "x 300.1.1.1 001.002.003.004", "mail é😀 me@x.org, +1 (555) 123-4567.",
    "4111 1111 1111 1111 and 4111-1111-1111-1111-1", "12 4111111111111111", "5 - 4111111111111111", "+12345 +1234567890123456789",
    "9" * 30, "abc@.com abc@d", "a@b.c." + "d@e.f" * 400, "1 " * 9000, "4111111111111111 " * 700, "a" * 50_000, "é" * 300 + " 10.0.0.1", "+4111111111111111@x.y",
]


def test_base_spans(spark):
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(TEXTS)], "doc_id long, text string, begin long")
    for row in m.spans(docs, []).select("doc_id", m._named(m.KINDS).alias("s")).collect():
        assert row.s == ",".join(brute(TEXTS[row.doc_id])), TEXTS[row.doc_id][:60]


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in m.op4_pii(spark, "/root/testdata/sf0.001").collect():
        want = brute(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert row.spans.split(",")[: len(want)] == want or not want
        assert row.n_email == sum(x.startswith("email") for x in want)


def bootstrap(docs):
    hexes = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    rows = [(i, f'words token = "{hexes(i)}" and key: {hexes(i + 50)} end') for i in range(9)]
    return [*rows, (100, 'my token = "abc-123456" x'), (101, "size=1234567 size=2345678 size=3456789"), (102, None), (103, "clean text only, 12 of 3")]


def test_bootstrapping(spark):
    docs = spark.createDataFrame(bootstrap(None), "doc_id long, text string")
    contexts = m.learned(docs)
    assert contexts == ["key:", 'token="']
    found = {r.doc_id: [x.hit for x in r.id] for r in m.spans(docs, contexts).collect()}
    assert found[100] == ["abc-123456"] and found[101] == [] and found[103] == [] and len(found[3]) == 2
    text = {r.doc_id: r.text for r in m.redact(docs, contexts).collect()}
    assert text[100] == 'my token = "[ID]" x' and text[103] == "clean text only, 12 of 3" and text[102] is None


def test_labelled_base_spans_of_all_kinds_are_seeds(spark):
    seeds = {
        "phone: ": ("+1-555-010-7713", "+1 (555) 010-7714", "+44 20 7946 0958"),
        "card=": ("4111 1111 1111 1111", "5500-0000-0000-0004", "4111111111111111"),
        "mail [": ("me@x.org", "you@y.org", "he@z.org."),
        "host#": ("10.0.0.1", "10.0.0.2.", "001.2.3.4"),
        # not valid, so no seeds
        "part ": ("4111 1111 1111 1112",) * 3,
        "call: ": ("+12345", "+123456", "+1234567890123456789"),
        "node: ": ("300.1.1.1", "300.1.1.2", "300.1.1.3"),
    }
    rows = [(i, f"text {label}{x} and more") for label, xs in seeds.items() for i, x in enumerate(xs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    contexts = m.learned(docs)
    assert contexts == ["card=", "host#", "mail[", "phone:"]
    new = spark.createDataFrame([(1, "my phone: 555-0107 x"), (2, "call: 555-0107"), (3, "phone: +1 555 010 7713")], "doc_id long, text string")
    assert {r.doc_id: [x.hit for x in r.id] for r in m.spans(new, contexts).collect()} == {1: ["555-0107"], 2: [], 3: []}
    assert sorted(r.text for r in m.redact(new, contexts).collect()) == ["call: 555-0107", "my phone: [ID] x", "phone: [PHONE]"]


def word(i):
    return "lab" + "".join(chr(97 + int(c)) for c in f"{i:04}")


def test_all_contexts_over_the_thresholds_are_used(spark):
    """More contexts than the literal holds; rows repeat and ids are null."""
    n = m.PATTERNS + 50
    hexes = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    rows = [(i, " ".join(f"{word(i)}: {hexes(3 * i + k)} x" for k in range(3))) for i in range(n)]
    rows += [(None, f"{word(i)}: abc-{i:06} and other: abc-123456") for i in range(n)] + [(None, f"{word(7)}: abc-000007 and other: abc-123456")] * 2 + [(5, None), (6, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # the labels also have an instance that is no seed; as 3 of 4 are trusted, only a lower bound makes them learned
    old, m.CONFIDENT = m.CONFIDENT, 0.7
    try:
        contexts = m.learned(docs)
    finally:
        m.CONFIDENT = old
    assert {r.context for r in contexts.collect()} == {word(i) + ":" for i in range(n)}
    ids = sorted((r.text, x.hit) for r in m.spans(docs, contexts).collect() if r.doc_id is None for x in r.id)
    assert ids == sorted((t, t.split()[1]) for d, t in rows if d is None)
    out = m.redact(docs, contexts)
    assert out.columns == docs.columns
    want = [None if t is None else re.sub(r"(lab\w+: )\S+", r"\1[ID]", t) for _, t in rows]
    assert sorted(map(str, want)) == sorted(str(r.text) for r in out.collect())


def masked(text):
    """By characters: a run of covered ones is a mask, named by the span that begins it."""
    kinds = list(SIMPLE)
    spans = sorted((int(b), kinds.index(k), int(e)) for k, b, e in (x.split(":") for x in brute(text)))
    out, at = [], 0
    for begin, kind, end in spans:
        if begin >= at:
            out += [text[at:begin], f"[{kinds[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_redaction_masks_the_union_of_spans(spark):
    texts = [*TEXTS, "call +10.20.30.40 555 now", "+1 a@b.c 10.0.0.1", "x 10.0.0.1 " * 700 + "end é", "+4111111111111 111@x.y 1.2.3.4"]
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, email string")
    out = m.redact(docs, [])
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert got[i].text == (None if t is None else masked(t)), t[:80]
        assert got[i].n_chars == (5 if t is None else len(got[i].text)) and got[i].email == "x"
    assert got[len(TEXTS)].text == "call [PHONE] now"


def by_rounds(texts):
    """The contexts that an independent iteration over the graph learns."""
    label = re.compile(r"(?<![^\W\d_])([^\W\d_]{2,24}+)( ?[:=#\"'(\[][:=#\"'(\[ ]{0,4}+)([A-Za-z0-9._%+@-]{6,})")
    pairs = {(w.lower() + d.replace(" ", ""), x) for t in texts if t for w, d, x in label.findall(t) if re.match(r"[A-Za-z_.%+@-]*[0-9]", x)}
    trust = {x: float(bool(re.fullmatch("[0-9a-fA-F]{16,}", x) and re.search("[a-fA-F]", x))) for _, x in pairs}
    while True:
        of = lambda c: [x for k, x in pairs if k == c]
        score = {c: (sum(trust[x] >= 0.9 for x in of(c)), len(of(c))) for c, _ in pairs}
        conf = {c: h / n for c, (h, n) in score.items() if h >= 3}
        new = dict(trust)
        for x in trust:
            miss = 1.0
            for c, y in pairs:
                if y == x and c in conf:
                    miss *= 1 - min(conf[c], 0.999)
            new[x] = max(trust[x], 1 - miss)
        if sum(v >= 0.9 for v in new.values()) == sum(v >= 0.9 for v in trust.values()):
            return sorted(c for c, v in conf.items() if v >= 0.9)
        trust = new


def test_bootstrapping_ends_at_a_fixed_point(spark):
    """Half of a label's instances are trusted, by the labels before it; four such labels make the others trusted: one round for each step."""
    hexes = [hashlib.md5(str(i).encode()).hexdigest() for i in range(3)]
    tokens = [hexes] + [[f"id-{k}77{i}" for i in range(3)] for k in range(6)]
    rows = [f"l{'abcdef'[k]}{x}: {p} end" for k in range(6) for x in "pqrs" for p in tokens[k] + tokens[k + 1]]
    # a label whose instances are mostly no identifiers
    rows += [f"size: 12345{i}" for i in range(9)] + [f"size: {hexes[0]}", f"size: {hexes[1]}", f"size: {hexes[2]}"]
    want = by_rounds(rows)
    assert len(want) == 24 and "size:" not in want
    assert m.learned(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")) == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert m.learned(docs) == [] and m.spans(docs, []).count() == 0 and m.redact(docs).count() == 0


if __name__ == "__main__":
    pytest.main([__file__, "-x", "-q"])
