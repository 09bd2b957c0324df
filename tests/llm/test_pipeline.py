import corpus_pipeline as p
from latticework.llm import op4_pii
from latticework.llm.common import cut

from .helpers import TINY
from .test_op4_pii import brute as spans
from .test_op7_decontamination import brute as leaks
from .test_op10_minhash import brute as groups


def test_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    extra = [(9001, None, "en", "src0", 0), (9002, "12 34 ...", None, None, 9), (None, "Words without an id, and with mail a@b.org in them, that are in no other text of all.", "en", None, 5)]
    long = " ".join(r.text for r in docs.where("lang = 'en'").orderBy("doc_id").limit(40).collect()).replace(".", ";")
    extra += [(9003, " ".join(f"{long} {k}" for k in range(12)), None, "src0", 3)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    docs = docs.withColumn("c0", docs.doc_id).withColumn("taken", docs.doc_id)
    names = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = [r for r in docs.collect()]
        docs = cut(stage(spark, docs, TINY), name)
        after = [r for r in docs.collect()]
        assert docs.columns == names
        gone = {r.doc_id for r in before} - {r.doc_id for r in after}
        if name == "language":
            assert {9001, 9002} <= gone and len(gone) < 8
        if name == "near_duplicates":
            got = groups([(r.doc_id if r.doc_id is not None else 1 << 50, r.text) for r in before], 5, 80)
            assert sorted(r.doc_id if r.doc_id is not None else 1 << 50 for r in after) == sorted(d for d, (_, c) in got.items() if c == d)
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
            assert {d for d, _ in leaks([(r.doc_id, r.text) for r in before], items)} == gone
        if name == "personal_data":
            assert len(after) == len(before)
            texts = {r.doc_id: r.text for r in before}
            for r in after:
                assert not spans(r.text) and (r.text == texts[r.doc_id] or "[" in r.text)
    mixed = p.STAGES[-1][1](spark, docs, TINY)
    assert mixed.columns == [*(f"doc_{c}" if c == "taken" else c for c in names), "size", "source_size", "target", "taken"]
    assert 0 < mixed.count() <= len(after)


def test_empty(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, TINY).count() == 0


def test_native_stages():
    source = open(op4_pii.__file__).read()
    assert not any(x in source for x in ("pandas", "mapIn", "applyIn", ".rdd", "F.udf"))
