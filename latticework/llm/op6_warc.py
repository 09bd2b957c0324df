"""WARC archives: a writer with revisit records and a splittable reader.

Writer: one gzip member per record. Of records with equal payloads of at least `least` bytes, the
one with the largest page_id is a response and the others are revisits that refer to it. Each task
writes one file under a name of its attempt and renames it when it is whole, so a task that runs
again leaves no half-written archive.

Reader: files are dealt out in byte ranges. A task scans its range for the gzip magic, takes a
candidate only if the bytes there inflate to the start of a WARC record, and owns the records that
begin inside its range, reading on past the range's end for the last one. After a record the
next candidate is where its member ends. So ranges need no index and may cut records anywhere.
A task holds one member at a time, inflated.

Records of any writer are read: all types, any version 1.x, several records in one member; names of header fields in
any case, with or without a space after the colon, folded lines, bare newlines. What a record lacks is
null: id, type, target, digest, length of the HTTP body. A digest is lower-case hex if it is SHA-1 (base32 or hex), else
as it stands. The payload is the body of an HTTP block of a response or request, else the whole block.

Damage is never passed over in silence: it gives a row of its own with `error` set and nothing but path and
offset besides. These are: a member that begins as a record and does not end well (cut off, wrong
checksum), a record without a valid length or shorter than it, and bytes between the end of a member, or the
file's beginning, and the next record or the range's end. Reading goes on behind the damage. A member whose
beginning is damaged shows as such bytes, if the record before it was read by the same task.

Archives go to the folder that spark.checkpoint.dir names, by pyarrow's file systems.

Cases: null html is an empty payload, a response; rows with the same page_id as the response are
responses too (a page never refers to itself); a null page_id counts as smaller than all others; a
null url is left out of the record; an empty table writes no archive and gives an empty result.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, new_path, table

LEAST = 1000
#: Bytes of a range, and of one read.
SPLIT, READ = 8 << 20, 1 << 20
MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:page:"
RECORD = "path string, offset long, record_id string, record_type string, uri string, refers_to string, digest string, http_bytes long, payload binary, error string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in RECORD.split(", "))])


def marked(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages with payload, digest (SHA-1, hex), record_type and refers_to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    # several rows with one payload: few beside the rows, so the payloads move once at most
    groups = rows.select("page_id", "digest", "bytes").where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1 and top is not null").select("digest", "top"), "copies")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")) & (F.col("bytes") >= least)
    out = rows.join(groups, "digest", "left")
    return out.select("page_id", "url", "payload", "digest", F.when(other, "revisit").otherwise("response").alias("record_type"), F.when(other, F.col("top")).alias("refers_to"))


def _line(text: str) -> bytes:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text).encode()


def _name(page_id) -> bytes:
    return b"<" + NAME.encode() + (b"none" if page_id is None else str(page_id).encode()) + b">"


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Record-ID: " + _name(page_id), b"WARC-Date: " + DATE.encode(), b"WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest))]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + _line(url))
    if kind == "revisit":
        lines += [b"WARC-Refers-To: " + _name(refers_to), b"WARC-Profile: " + PROFILE.encode()]
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():05d}.warc.gz"
        own = f"{root}/.{task.partitionId():05d}-{task.taskAttemptId()}.tmp"
        out, size, n = None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")), strict=True):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(own)
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = pack.compress(record(*row)) + pack.flush()
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            fs.move(own, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "records": [n]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return run


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Writes the archives; returns path, bytes, records of each file."""
    return cut(marked(pages, least).mapInArrow(_writer(folder), "path string, bytes long, records long"), "archives")


def _member(at, held: bytes, pos: int) -> tuple[bytes | None, int, str | None]:
    """What the member at pos inflates to, where it ends and what is wrong with it; None if it is no record."""
    try:
        if not zlib.decompressobj(31).decompress(held if len(held) >= 512 else at(pos, 512), 64).startswith(b"WARC/1."):
            return None, pos + 1, None
    except zlib.error:
        return None, pos + 1, None
    gz, data, read, chunk = zlib.decompressobj(31), [], pos, held
    try:
        while not gz.eof:
            chunk = chunk or at(read, READ)
            if not chunk:
                return b"", pos + 1, "the file ends inside a record"
            data.append(gz.decompress(chunk))
            read += len(chunk)
            chunk = b""
    except zlib.error as wrong:
        return b"", pos + 1, f"damaged member: {wrong}"
    return b"".join(data), read - len(gz.unused_data), None


def members(fs, path: str, begin: int, end: int) -> Iterator[tuple[int, bytes, str | None]]:
    """Offset, content and error of members that begin in [begin, end), and of bytes that belong to none."""
    with fs.open_input_file(path) as file:
        size = file.size()

        def at(pos: int, n: int) -> bytes:
            file.seek(pos)
            return file.read(min(n, size - pos)) if pos < size else b""

        pos, held, base = begin, b"", begin
        due = 0 if begin == 0 else None  # where a member should begin, if that is known
        while pos < min(end, size):
            # magic may straddle two reads
            if not base <= pos <= base + len(held) - len(MAGIC):
                held, base = at(pos, READ), pos
            k = held.find(MAGIC, pos - base)
            if k < 0:
                pos = max(base + len(held) - len(MAGIC) + 1, pos + 1)
                continue
            pos = base + k
            if pos >= end:
                break
            whole, after, error = _member(at, held[k:], pos)
            if whole is not None:
                if due is not None and due < pos:
                    yield due, b"", f"{pos - due} bytes belong to no record"
                yield pos, whole, error
                due = None if error else after
            pos = after
        if due is not None and due < min(end, size):
            yield due, b"", f"{min(end, size) - due} bytes or more belong to no record"


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    """First line and header fields by lower-case name; folded lines go on with the field before."""
    first, *lines = head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            if name in out:  # of a repeated field the first counts
                name = None
            else:
                out[name] = value.strip()
    return first, out


def _split(data: bytes, start: int = 0) -> tuple[bytes, int] | None:
    """The header that begins at start, and where what follows it begins."""
    ends = [(k, k + len(x)) for x in (b"\r\n\r\n", b"\n\n") if (k := data.find(x, start)) >= 0]
    return (data[start : min(ends)[0]], min(ends)[1]) if ends else None


def _length(said: str | None) -> int | None:
    return int(said) if said and said.isascii() and said.isdigit() else None


def _digest(said: str | None) -> str | None:
    kind, _, value = (said or "").partition(":")
    if kind.strip().lower() == "sha1":
        value = value.strip()
        if re.fullmatch("[0-9a-fA-F]{40}", value):
            return value.lower()
        if re.fullmatch("[2-7a-zA-Z]{32}", value):
            return base64.b32decode(value.upper()).hex()
    return said or None


def records(whole: bytes, payloads: bool = True) -> Iterator[tuple]:
    """The records of a member's content: what RECORD lists after the offset."""
    at = 0
    while whole[at:].strip(b"\r\n") if len(whole) - at < 64 else True:
        while whole[at : at + 1] in (b"\r", b"\n"):
            at += 1
        parts = _split(whole, at)
        version, fields = _fields(parts[0]) if parts else ("", {})
        n = _length(fields.get("content-length"))
        if not parts or not version.startswith("WARC/1.") or n is None or parts[1] + n > len(whole):
            yield (*[None] * 7, "a record without a header, a valid length or all of its block")
            return
        at = parts[1] + n
        block = whole[parts[1] : at]
        body, http_bytes = block, None
        if block.startswith(b"HTTP/") or "application/http" in fields.get("content-type", "").lower():
            http = _split(block)
            if http:
                body = block[http[1] :]
                http_bytes = _length(_fields(http[0])[1].get("content-length"))
                http_bytes = len(body) if http_bytes is None else http_bytes
        name = lambda k: fields.get(k, "").strip("<> ") or None
        yield name("warc-record-id"), fields.get("warc-type", "").lower() or None, name("warc-target-uri"), name("warc-refers-to"), _digest(fields.get("warc-payload-digest")), http_bytes, body if payloads else None, None


def _reader(payloads: bool):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end")), strict=True):
                fs, path = pafs.FileSystem.from_uri(uri)
                rows, held = [], 0
                for offset, whole, error in members(fs, path, begin, end):
                    found = [(*[None] * 7, error)] if error else records(whole, payloads)
                    for r in found:
                        rows.append((uri, offset, *r))
                        held += len(r[6] or b"") + 200
                        if held > READ * 8:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def read(files: DataFrame, prefix: str = "", split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """Records of archives (path, bytes), read by byte ranges, and a row with error for each damage. prefix: what stands before paths to make them URIs."""
    files = files.where("bytes > 0")
    ranges = files.select(F.concat(F.lit(prefix), "path").alias("path"), "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split))).alias("begin"))
    total = files.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    ranges = ranges.select("path", "begin", F.least("bytes", F.col("begin") + split).alias("end")).repartition(int(total))
    return ranges.mapInArrow(_reader(payloads), RECORD)


def op6_warc(spark, sf_dir):
    folder = new_path(spark, "warc")
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    files = write(table(spark, sf_dir, "pages"), folder)
    # from_uri gives paths without scheme; a bucket or host stays part of them
    found = read(files, scheme)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(NAME) + 1}) as bigint)")
    whole = F.col("record_type") == "response"
    return found.select(
        number("record_id").alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("http_bytes")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as g from pages),
m as (select g, max(page_id) as top from p where n >= 1000 group by g)
select p.page_id, n as payload_bytes, p.g as payload_digest,
  case when top is not null and p.page_id is distinct from top then 'revisit' else 'response' end as record_type,
  case when top is not null and p.page_id is distinct from top then top end as refers_to
from p left join m on m.g = p.g and p.n >= 1000
"""
