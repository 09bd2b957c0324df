"""Matrix files as data sources: spark.read.format("latticework-mm"), "latticework-ijv" and "latticework-hb".

    register(spark)
    spark.read.format("latticework-hb").load("matrix.rsa")                       # (i, j, re, im), indices from 0
    matrix.coo.write.format("latticework-mm").mode("overwrite").save("folder")   # mm and ijv are written, too

A file or folder of any file system of pyarrow. A task of mm and ijv owns the lines that begin in its range of bytes. A file of
Harwell-Boeing has lines of one length in each section, so a task owns a range of columns and reads the pointers, rows and
values of these alone; lines of unequal lengths are an error. Options: `split`, bytes of a range (64 MB) or, for hb, `columns` of one (100,000);
`base` and `complex` of ijv, `field` (real, complex or pattern) and `symmetry` and `n` of a written mm. Files of more than MOST ranges
are read in longer ones, MOST and one for each file at most. Lines of numbers between single spaces are parsed and written by pyarrow, others one by one.
An empty folder has no rows. A pattern's re is null, and a null re is read back from no other field.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schema import COO
from .files import _fields, _width

SPLIT, COLUMNS = 64 << 20, 100_000
#: Entries of Harwell-Boeing, and bytes of lines, that are parsed at once; ranges of bytes, each of which is a task.
BATCH, CHUNK, MOST = 50_000, 1 << 20, 1_000
_ARROW = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("re", pa.float64()), ("im", pa.float64())])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _open(system: fs.FileSystem, path: str, held: int = 1 << 20) -> io.BufferedReader:
    return io.BufferedReader(system.open_input_file(path), held)


def _files(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """A file, or those of a folder by path; names that begin with . or _ are left out."""
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [info]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f for f in found if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path)


def _batch(i, j, re, im) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(i, dtype=np.int64)), pa.array(np.asarray(j, dtype=np.int64)), pa.array(re, pa.float64()), pa.array(im, pa.float64())], schema=_ARROW)


@dataclass
class Range(InputPartition):
    """Bytes of a file whose lines a task owns, or columns of one."""

    path: str
    begin: int
    end: int
    field: str = "real"


class _Lines(DataSourceReader):
    """Lines `i j [re [im]]`; those that begin with % and those before `body` of the first file are left out."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.base, self.field = int(options.get("base", 1)), "complex" if options.get("complex", "false").lower() == "true" else "real"
        self.has_head = False

    def _body(self, system: fs.FileSystem, file: fs.FileInfo) -> tuple[int, str]:
        """Where the entries of the first file begin, and what they hold."""
        return 0, self.field

    def partitions(self) -> list[Range]:
        system, path = _place(self.path)
        out, field, files = [], self.field, _files(system, path)
        split = max(self.split, -(-sum(f.size for f in files) // MOST))
        for k, f in enumerate(files):
            begin = 0
            if k == 0:
                begin, field = self._body(system, f)
            out += [Range(f.path, at, min(at + split, f.size), field) for at in range(begin, f.size, split)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = _place(self.path)
        with _open(system, part.path, min(CHUNK, part.end - part.begin + 1)) as raw:
            at = part.begin
            if at:  # a line belongs to the range that holds its first byte
                raw.seek(at - 1)
                at += len(raw.readline()) - 1
            raw.seek(at)
            while at < part.end:
                text = raw.read(min(CHUNK, part.end - at))
                if not text:
                    break
                if not text.endswith(b"\n"):
                    text += raw.readline()
                at += len(text)
                yield _plain(text, part.field, self.base) or self._parsed([x for x in text.split(b"\n") if x.strip() and not x.startswith(b"%")], part.field)

    def _parsed(self, lines: list[bytes], field: str) -> pa.RecordBatch:
        t = [line.split() for line in lines]
        i, j = ([int(x[c]) - self.base for x in t] for c in (0, 1))
        re = [None] * len(t) if field == "pattern" else [float(x[2]) if len(x) > 2 else None for x in t]
        im = [float(x[3]) if field == "complex" and len(x) > 3 else 0.0 for x in t]
        return _batch(i, j, re, im)


def _plain(text: bytes, field: str, base: int) -> pa.RecordBatch | None:
    """Entries of lines that hold as many numbers each, between single spaces; None for others."""
    width = text.split(b"\n", 1)[0].count(b" ") + 1
    names = [f"c{k}" for k in range(width)]
    shown = {"pattern": 2, "real": 3, "complex": 4}[field]
    if not min(shown, 3) <= width <= shown:
        return None
    try:
        t = csv.read_csv(
            pa.BufferReader(text),
            csv.ReadOptions(use_threads=False, column_names=names, block_size=len(text) + 1),
            csv.ParseOptions(delimiter=" ", quote_char=False),
            csv.ConvertOptions(column_types={n: pa.int64() if k < 2 else pa.float64() for k, n in enumerate(names)}, null_values=[]),
        )
    except pa.ArrowInvalid:
        return None
    i, j, *values = (np.concatenate([x.to_numpy() for x in c.chunks]) if c.num_chunks else np.zeros(0) for c in t.columns)
    if len(i) != text.count(b"\n") + (not text.endswith(b"\n")):  # empty lines
        return None
    return _batch(i - base, j - base, values[0] if values else [None] * len(i), values[1] if len(values) > 1 else np.zeros(len(i)))


class _MatrixMarket(_Lines):
    def __init__(self, options: dict):
        super().__init__({**options, "base": 1})

    def _body(self, system: fs.FileSystem, file: fs.FileInfo) -> tuple[int, str]:
        """Entries begin after banner, comments and the line of sizes."""
        with _open(system, file.path) as raw:
            line = raw.readline()
            banner, at = line.decode("latin-1").lower().split(), len(line)
            if len(banner) < 5 or banner[0] != "%%matrixmarket" or banner[2] != "coordinate":
                raise ValueError(f"{self.path} is no coordinate MatrixMarket file")
            while line and (line.startswith(b"%") or not line.strip()):
                line = raw.readline()
                at += len(line)
        return at, banner[3]


class _HarwellBoeing(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.columns = options["path"], int(options.get("columns", COLUMNS))

    def partitions(self) -> list[Range]:
        system, path = _place(self.path)
        out = []
        for f in _files(system, path):
            with _open(system, f.path) as raw:
                n = _Cards(raw).columns
            out += [Range(f.path, c, min(c + self.columns, n)) for c in range(0, n, self.columns)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = _place(self.path)
        with _open(system, part.path) as raw:
            cards = _Cards(raw)
            pointers = np.array(cards.numbers(0, part.begin, part.end + 1), dtype=np.int64) - 1
            per = 2 if cards.kind[0] == "C" else 1
            step = BATCH
            for s in range(int(pointers[0]), int(pointers[-1]), step):
                e = min(s + step, int(pointers[-1]))
                i = np.array(cards.numbers(1, s, e), dtype=np.int64) - 1
                j = part.begin + np.searchsorted(pointers, np.arange(s, e), "right") - 1
                if cards.kind[0] == "P":
                    yield _batch(i, j, [None] * len(i), np.zeros(len(i)))
                    continue
                v = np.array([float(x.upper().replace("D", "E")) for x in cards.numbers(2, s * per, e * per)])
                yield _batch(i, j, v[::per], v[1::2] if per == 2 else np.zeros(len(i)))


class _Cards:
    """Header of a Harwell-Boeing file, and the numbers of its sections (pointers, rows, values) by their places."""

    def __init__(self, raw):
        self.raw = raw
        head = [raw.readline() for _ in range(4)]
        text = [x.decode("latin-1").rstrip("\r\n") for x in head]
        cards = [int(text[1][k * 14 : (k + 1) * 14] or 0) for k in range(1, 4)]
        at = sum(map(len, head))
        if text[1][56:70].strip() not in ("", "0"):
            at += len(raw.readline())
        self.kind = text[2][:3].upper()
        self.columns, entries = int(text[2][28:42]), int(text[2][42:56])
        self.layouts = [text[3][:16], text[3][16:32], text[3][32:52]]
        self.counts = [self.columns + 1, entries, entries * (2 if self.kind[0] == "C" else 1)]
        self.starts, self.lengths = [], []
        for lines in cards:
            raw.seek(at)
            length = len(raw.readline()) if lines else 0
            self.starts.append(at)
            self.lengths.append(length)
            if lines:
                raw.seek(at + (lines - 1) * length)
                at += (lines - 1) * length + len(raw.readline())

    def numbers(self, section: int, begin: int, end: int) -> list[str]:
        if begin >= end:
            return []
        per, _ = _width(self.layouts[section])
        first, last = begin // per, (end - 1) // per
        length = self.lengths[section]
        self.raw.seek(self.starts[section] + first * length)
        lines = self.raw.read((last - first + 1) * length)
        # of the section's last line there may be less than a whole one
        cut = [lines[k * length : (k + 1) * length] for k in range(last - first + 1)]
        final = (self.counts[section] - 1) // per
        if any(b"\n" in x[:-1] or not x.endswith(b"\n") for x in cut[: len(cut) - (last == final)]):
            raise ValueError("lines of a section have unequal lengths")
        text = [x.split(b"\n")[0].decode("latin-1").rstrip("\r") for x in cut]
        return _fields(text, min((last + 1) * per, self.counts[section]) - first * per, self.layouts[section])[begin - first * per : end - first * per]


@dataclass
class Written(WriterCommitMessage):
    name: str
    count: int
    n: int


class _Writer(DataSourceArrowWriter):
    """Parts of lines, names of their own for each attempt; those of attempts that were not committed are deleted."""

    def __init__(self, options: dict, overwrite: bool, header: bool):
        self.options, self.overwrite, self.header = options, overwrite, header
        self.job = uuid.uuid4().hex
        self.base = int(options.get("base", 1))
        self.field = options.get("field", "complex" if options.get("complex", "false").lower() == "true" else "real")
        system, path = _place(options["path"])
        there = system.get_file_info(path)
        if not overwrite and there.type != fs.FileType.NotFound and (there.is_file or _files(system, path)):
            raise ValueError(f"{options['path']} exists and is replaced with mode overwrite only")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, path = _place(self.options["path"])
        system.create_dir(path, recursive=True)
        name = f"{path}/part-1-{self.job}-{uuid.uuid4().hex}"
        shown = {"pattern": 0, "real": 1, "complex": 2}[self.field]
        count = n = 0
        with system.open_output_stream(name) as to:
            for batch in batches:
                i, j = (np.asarray(batch.column(batch.schema.get_field_index(c))) + self.base for c in "ij")
                values = [batch.column(batch.schema.get_field_index(c)) for c in ("re", "im")[:shown]]
                if any(v.null_count for v in values):
                    to.write("".join(" ".join([str(a), str(b), *map(repr, v)]) + "\n" for a, b, *v in zip(i, j, *(v.to_pylist() for v in values), strict=True)).encode())
                else:
                    lines = pa.table([pa.array(i), pa.array(j), *values], names=["i", "j", "re", "im"][: 2 + shown])
                    csv.write_csv(lines, to, csv.WriteOptions(include_header=False, delimiter=" ", quoting_style="none"))
                count += len(i)
                n = max([n, *(int(x.max()) for x in (i, j) if len(x))])
        return Written(name, count, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _place(self.options["path"])
        done = [m for m in messages if m is not None]
        keep = {m.name for m in done}
        system.create_dir(path, recursive=True)
        for f in _files(system, path):
            if f.path not in keep and (self.overwrite or self.job in f.base_name):
                system.delete_file(f.path)
        if self.header:
            n = int(self.options.get("n", max((m.n for m in done), default=0)))
            head = f"%%MatrixMarket matrix coordinate {self.field} {self.options.get('symmetry', 'general').lower()}\n{n} {n} {sum(m.count for m in done)}\n"
            with system.open_output_stream(f"{path}/part-0") as to:
                to.write(head.encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, path = _place(self.options["path"])
        if system.get_file_info(path).type == fs.FileType.Directory:
            for f in _files(system, path):
                if self.job in f.base_name:
                    system.delete_file(f.path)


class IjvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "latticework-ijv"

    def schema(self) -> str:
        return COO

    def reader(self, schema) -> DataSourceReader:
        return _Lines(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite, header=False)


class MatrixMarketSource(IjvSource):
    @classmethod
    def name(cls) -> str:
        return "latticework-mm"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixMarket(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite, header=True)


class HarwellBoeingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "latticework-hb"

    def schema(self) -> str:
        return COO

    def reader(self, schema) -> DataSourceReader:
        return _HarwellBoeing(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (IjvSource, MatrixMarketSource, HarwellBoeingSource):
        spark.dataSource.register(source)
