import duckdb
import pytest
from latticework.plans import catalog
from latticework.sources import datasource, files

from .. import TABLES, TINY
from .test_catalog import rows

CASES = [(0, 0, 1.5, 0.0), (2, 1, -3e-300, 0.25), (1, 2, 4.0, -1.0), (2, 1, 0.5, 0.0), (11, 10, 1 / 3, 2.0)]


@pytest.fixture(scope="module")
def source(spark):
    datasource.register(spark)
    return spark


def read(spark, name, path, **options):
    return sorted((tuple(r) for r in spark.read.format(f"latticework-{name}").options(**options).load(str(path)).collect()), key=str)


@pytest.mark.parametrize("split", [1, 7, 1 << 20])
def test_every_line_has_one_owner(source, tmp_path, split):
    text = "%%MatrixMarket matrix coordinate complex general\n% 1 1 9 9\n\n12 12 5\n" + "".join(f"{i + 1} {j + 1}  {re!r} {im!r}\n\n" for i, j, re, im in CASES)
    (tmp_path / "a.mtx").write_text(text.rstrip("\n"))
    assert read(source, "mm", tmp_path / "a.mtx", split=split) == sorted(CASES, key=str)
    (tmp_path / "b.ijv").write_text("".join(f"{i} {j} {re!r} {im!r}\n" for i, j, re, im in CASES))
    assert read(source, "ijv", tmp_path / "b.ijv", split=split, base=0, complex=True) == sorted(CASES, key=str)


def test_written_files_are_those_of_the_readers(source, tmp_path):
    df = source.createDataFrame(CASES, "i long, j long, re double, im double").repartition(3)
    path = str(tmp_path / "mm")
    for _ in range(2):  # the second time replaces the first
        df.write.format("latticework-mm").option("field", "complex").mode("overwrite").save(path)
        assert read(source, "mm", path) == sorted(CASES, key=str)
    m = files.read_matrix_market(source, path)
    assert m.n == 12 and m.is_complex and sorted((tuple(r) for r in m.coo.collect()), key=str) == sorted(CASES, key=str)
    with pytest.raises(Exception, match="mode overwrite"):
        df.write.format("latticework-mm").mode("append").save(path)
    df.limit(0).write.format("latticework-mm").option("field", "pattern").mode("overwrite").save(path)
    assert read(source, "mm", path) == []
    df.write.format("latticework-mm").option("field", "pattern").mode("overwrite").save(path)
    assert read(source, "mm", path) == sorted(((i, j, None, 0.0) for i, j, _, _ in CASES), key=str)


def test_ranges_are_no_more_than_a_bound(source, tmp_path, monkeypatch):
    """A large file is read in longer ranges, and lines in chunks of bytes; the rows are the same."""
    lines = [f"{k % 97} {k} {k / 7!r}" for k in range(3000)]
    (tmp_path / "a.ijv").write_text("\n".join(lines))
    want = sorted(((k % 97, k, k / 7, 0.0) for k in range(3000)), key=str)
    monkeypatch.setattr(datasource, "MOST", 20)
    monkeypatch.setattr(datasource, "CHUNK", 500)
    reader = datasource._Lines({"path": str(tmp_path / "a.ijv"), "split": 64, "base": 0})
    parts = reader.partitions()
    assert len(parts) <= 21
    got = [tuple(r.values()) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(got, key=str) == want


@pytest.mark.parametrize("line", ["1 2 0.1", "1 2 -1e-300", "1 2 inf", "1  2 3", "1 2 3 ", "\t1 2 3", "1 2", "1 2 3 4", "% 1 2", "", "1 2 3\r", "01 2 +3", "9007199254740993 2 0.30000000000000004"])
def test_plain_lines_are_parsed_as_others(tmp_path, line):
    """Whatever pyarrow takes is what lines parsed one by one give."""
    for field in ("real", "complex", "pattern"):
        reader = datasource._Lines({"path": "/", "base": 1})
        for text in (line, f"{line}\n{line}\n", f"{line}\n5 6 7\n"):
            kept = [x for x in text.encode().split(b"\n") if x.strip() and not x.startswith(b"%")]
            fast = datasource._plain(text.encode(), field, 1)
            assert fast is None or fast.to_pylist() == reader._parsed(kept, field).to_pylist()
    assert datasource._plain(b"1 2 0.1\n3 4 5\n", "real", 1).num_rows == 2


def harwell_boeing(kind, columns, values, end="\n"):
    """Cards of fixed width: four pointers, three rows and two values a line."""
    pointers, entries = [1], [e for c in columns for e in c]
    for c in columns:
        pointers.append(pointers[-1] + len(c))

    def cards(numbers, per, width, how):
        return ["".join(f"{how(x):>{width}}" for x in numbers[k : k + per]) for k in range(0, len(numbers), per)]

    sections = [cards(pointers, 4, 6, str), cards([e + 1 for e in entries], 3, 5, str), cards(values, 2, 20, lambda x: f"{x:.12E}".replace("E", "D"))]
    head = ["a title".ljust(80), "".join(f"{n:14d}" for n in (sum(map(len, sections)), *map(len, sections), 0)), kind.ljust(14) + "".join(f"{n:14d}" for n in (9, len(columns), len(entries), 0)), "(4I6)".ljust(16) + "(3I5)".ljust(16) + "(2D20.12)".ljust(20)]
    return end.join(head + [line for s in sections for line in s])


@pytest.mark.parametrize("kind,per", [("RUA", 1), ("CUA", 2), ("PUA", 0)])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_columns_of_harwell_boeing(source, tmp_path, kind, per, end):
    columns = [[0, 3], [], [1, 2, 4, 5, 6], [], [8], [0, 8]]
    count = sum(map(len, columns))
    values = [round((-1) ** k * (k + 1) / 7, 9) for k in range(count * per)]
    text = harwell_boeing(kind, columns, values, end)
    for tail in ("", end):
        (tmp_path / "a.hb").write_bytes((text + tail).encode())
        flat = [(i, j) for j, c in enumerate(columns) for i in c]
        want = sorted(((i, j, values[k * per] if per else None, values[2 * k + 1] if per == 2 else 0.0) for k, (i, j) in enumerate(flat)), key=str)
        for step in (1, 2, 100):
            assert read(source, "hb", tmp_path / "a.hb", columns=step) == want
    ragged = text.split(end)
    ragged[7] += "  "
    (tmp_path / "b.hb").write_bytes(end.join(ragged).encode())
    with pytest.raises(Exception, match="unequal|invalid literal"):
        read(source, "hb", tmp_path / "b.hb")


def test_query(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    df = catalog.QUERIES["matrix_sources"](spark, TINY)
    got, cur = df.collect(), con.execute(catalog.SQL["matrix_sources"])
    assert rows(df.columns, got) == rows([d[0] for d in cur.description], cur.fetchall())
