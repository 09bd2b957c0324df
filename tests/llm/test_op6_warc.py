import gzip
import hashlib
import random
import uuid

import pandas as pd
import pyarrow.fs as pafs
from latticework.llm import op6_warc as m
from latticework.llm.common import new_path
from pyspark.sql import functions as F

from .helpers import oracle, of, write

BIG = "<p>" + "text é " * 300
ROWS = [(1, "http://a/ b\n", BIG), (2, None, BIG), (7, "http://c", BIG), (3, "u", "<p>small"), (4, "u", "<p>small"), (5, "u", None), (6, "u", ""), (7, "again", BIG), (8, "u", "\x1f\x8b\x08 WARC/1." * 400), (9, "u", "\r\n\r\n" * 300)]


def test_table(spark):
    d = "/root/testdata/sf0.001"
    assert of(m.op6_warc(spark, d)) == oracle(m.SQL, d)


def test_odd_rows(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int")
    assert of(m.op6_warc(spark, write(spark, tmp_path, pages=df))) == oracle(m.SQL, pages=pd.DataFrame(ROWS, columns=["page_id", "url", "html"]))
    empty = df.limit(0)
    assert m.op6_warc(spark, write(spark, tmp_path / "e", pages=empty)).count() == 0


def test_any_split_gives_every_record_once(spark):
    df = spark.createDataFrame(ROWS * 1 + [(None, "n", BIG + "x")], "page_id long, url string, html string").coalesce(1)
    folder = new_path(spark, "test")
    files = m.write(df, folder)
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    whole = of(m.read(files, scheme).drop("payload"))
    assert not any(dict(r)["error"] for r in whole)
    assert len(whole) == len(ROWS) + 1
    for split in (37, 211, 1000):
        assert of(m.read(files, scheme, split=split).drop("payload")) == whole
    # one member for each record, readable by anyone
    fs, path = pafs.FileSystem.from_uri(scheme + files.first().path)
    with fs.open_input_file(path) as f:
        assert gzip.decompress(f.read()).count(b"WARC/1.1\r\n") == len(ROWS) + 1
    texts = {r.record_id: bytes(r.payload).decode() for r in m.read(files, scheme, split=97).where("record_type = 'response'").collect()}
    assert texts["urn:page:8"] == ROWS[8][2] and texts["urn:page:5"] == "" and texts["urn:page:none"] == BIG + "x"


def member(text):
    return gzip.compress(text if isinstance(text, bytes) else text.encode())


def archive(tmp_path, spark, *parts, **options):
    """What is read of an archive that holds the given bytes."""
    path = tmp_path / f"{uuid.uuid4().hex}.warc.gz"
    path.write_bytes(b"".join(parts))
    files = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    return sorted(m.read(files, "file://", **options).collect(), key=lambda r: r.offset)


INFO = member("WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 11\r\n\r\nsoftware: x\r\n\r\n")
PLAIN = member("WARC/1.1\nwarc-TYPE:response\ncontent-length:33\nWARC-Target-URI:\n  http://a/b\n\nHTTP/1.1 200 OK\nX:1\n\nbody\n\n text\n\r\n\r\n")
REQUEST = member("WARC/1.1\r\nWARC-Type: request\r\nContent-Type: application/http; msgtype=request\r\nWARC-Payload-Digest: sha1:DA39A3EE5E6B4B0D3255BFEF95601890AFD80709\r\nContent-Length: 27\r\n\r\nGET / HTTP/1.1\r\nHost: a\r\n\r\n\r\n\r\n")
NOTE = member("WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Payload-Digest: md5:abc\r\nContent-Length: 4\r\n\r\nnote\r\n\r\n")


def test_records_of_other_writers(spark, tmp_path):
    got = archive(tmp_path, spark, INFO, PLAIN, REQUEST, NOTE)
    assert [(r.record_type, r.record_id, r.uri, r.digest, bytes(r.payload), r.error) for r in got] == [
        ("warcinfo", "urn:uuid:1", None, None, b"software: x", None),
        ("response", None, "http://a/b", None, b"body\n\n text\n", None),
        ("request", None, None, "da39a3ee5e6b4b0d3255bfef95601890afd80709", b"", None),
        ("metadata", None, None, "md5:abc", b"note", None),
    ]
    # all records in one member
    one = archive(tmp_path, spark, member(b"".join(map(gzip.decompress, (INFO, PLAIN, REQUEST, NOTE)))))
    assert [(r.record_type, r.payload) for r in one] == [(r.record_type, r.payload) for r in got]


def test_damage_is_reported(spark, tmp_path):
    big = member(m.record(5, "u", bytes(range(256)) * 40, "00" * 20, "response", None))
    good = [INFO, big, NOTE]
    assert [r.error for r in archive(tmp_path, spark, *good)] == [None] * 3
    cut_off = archive(tmp_path, spark, INFO, big[:-9])
    assert [r.record_type for r in cut_off] == ["warcinfo", None] and "ends" in cut_off[1].error and cut_off[1].offset == len(INFO)
    flipped = bytearray(big)
    flipped[-30] ^= 0xFF
    body = archive(tmp_path, spark, INFO, bytes(flipped), NOTE)
    assert [r.record_type for r in body] == ["warcinfo", None, "metadata"] and "damaged" in body[1].error
    flipped = bytearray(big)
    flipped[0] ^= 0xFF
    start = archive(tmp_path, spark, INFO, bytes(flipped), NOTE)
    assert [r.record_type for r in start] == ["warcinfo", None, "metadata"] and start[1].error == f"{len(big)} bytes belong to no record"
    assert "or more" in archive(tmp_path, spark, INFO, b"trailing bytes")[1].error
    assert [r.error is None for r in archive(tmp_path, spark, b"no archive at all")] == [False]
    wrong = archive(tmp_path, spark, member("WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 99\r\n\r\nx"), NOTE)
    assert [r.record_type for r in wrong] == [None, "metadata"] and wrong[0].error
    assert archive(tmp_path, spark, b"") == []


def test_pages_larger_than_reads_and_ranges(spark, tmp_path):
    r = random.Random(1)
    large = "".join(r.choices("abcdefgh <>/é", k=12_000_000))
    rows = [(1, "u", large), (2, "u", "<p>between"), (3, "u", large), (4, "u", large[::-1])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = new_path(spark, "large")
    files = m.write(df, folder)
    assert files.first().bytes > m.SPLIT
    for split in (m.SPLIT, 1 << 20):
        got = {r.record_id: r for r in m.read(files, "file://", split=split).select("record_id", "record_type", "refers_to", F.sha1("payload").alias("h"), "error").collect()}
        assert len(got) == 4 and not any(r.error for r in got.values())
        assert got["urn:page:1"].record_type == "revisit" and got["urn:page:1"].refers_to == "urn:page:3"
        assert got["urn:page:4"].h == hashlib.sha1(large[::-1].encode()).hexdigest()
