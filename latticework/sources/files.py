"""Matrix files and tables of results.

Coordinate formats are read as text by Spark, so large files split; Harwell-Boeing, with its
fixed columns over wrapped lines, is read a file at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COO, GENERAL, HERMITIAN, SYMMETRIC, Matrix
from . import generators


def _numbers(lines: DataFrame, base: int, has_values: bool, complex_: bool) -> DataFrame:
    t = F.split(F.trim("value"), r"\s+")
    real = F.get(t, 2).cast("double") if has_values else F.lit(None).cast("double")
    im = F.get(t, 3).cast("double") if complex_ else F.lit(0.0)
    return lines.select((F.get(t, 0).cast("long") - base).alias("i"), (F.get(t, 1).cast("long") - base).alias("j"), real.alias("re"), im.alias("im"))


def read_matrix_market(spark: SparkSession, path: str) -> Matrix:
    """A coordinate MatrixMarket file: real, integer, complex or pattern; general, symmetric or Hermitian."""
    text = spark.read.text(path, recursiveFileLookup=True)
    # banner and size line begin the file, or the first of its parts
    first = text.select(F.min("_metadata.file_path")).first()[0]
    head = text.select("value", F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_path").alias("file")).where((F.col("at") == 0) & (F.col("file") == first))
    banner = head.first()["value"].lower().split()
    if len(banner) < 5 or banner[0] != "%%matrixmarket" or banner[2] != "coordinate":
        raise ValueError(f"{path} is no coordinate MatrixMarket file")
    entries = text.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = head.where(~F.col("value").startswith("%") & (F.trim("value") != "")).first()["value"]
    field, shape = banner[3], banner[4]
    kind = {"general": GENERAL, "symmetric": SYMMETRIC, "hermitian": HERMITIAN}[shape]
    rows, columns, _ = map(int, size.split())
    # entries may read as the size line does; such lines are all alike, so any one of them can be taken for it
    same = F.col("value") == size
    again = entries.where(same).count() - 1
    body = entries.where(~same).select("value").unionByName(spark.range(again).select(F.lit(size).alias("value")))
    coo = _numbers(body, 1, field != "pattern", field == "complex")
    arithmetic = {"pattern": "Pattern", "complex": "Complex64"}.get(field, "Double")
    return Matrix(coo, max(rows, columns), kind, arithmetic)


def write_matrix_market(a: Matrix, path: str) -> None:
    """A coordinate file in parts; banner and size line are a part of their own, the first by name."""
    field = {"Pattern": "pattern"}.get(a.arithmetic, "complex" if a.is_complex else "real")
    shown = ["re", "im"][: {"pattern": 0, "real": 1, "complex": 2}[field]]
    lines = a.coo.select(F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, *(F.col(c).cast("string") for c in shown)).alias("value"))
    head = [f"%%MatrixMarket matrix coordinate {field} {a.kind.lower()}", f"{a.n} {a.n} {a.coo.count()}"]
    spark = a.coo.sparkSession
    spark.createDataFrame([("\n".join(head),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/part=0")
    lines.write.mode("overwrite").text(f"{path}/part=1")


def write_ijv(a: Matrix, path: str, base: int = 1) -> None:
    shown = ("re", "im") if a.is_complex else ("re",)
    a.coo.select(F.concat_ws(" ", F.col("i") + base, F.col("j") + base, *(F.col(c).cast("string") for c in shown)).alias("value")).write.mode("overwrite").text(path)


def write_ordering(ordering: DataFrame, path: str) -> None:
    """Lines `vertex place`."""
    ordering.select(F.concat_ws(" ", "i", "perm").alias("value")).write.mode("overwrite").text(path)


def read_ordering(spark: SparkSession, path: str, base: int = 0) -> DataFrame:
    """(i, perm) from lines `vertex place`."""
    t = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select((F.get(t, 0).cast("long") - base).alias("i"), (F.get(t, 1).cast("long") - base).alias("perm"))


def read_ijv(spark: SparkSession, path: str, n: int, base: int = 1, complex_: bool = False, kind: str = GENERAL) -> Matrix:
    """Lines `i j re [im]`."""
    text = spark.read.text(path).where(F.trim("value") != "")
    return Matrix(_numbers(text, base, True, complex_), n, kind, "Complex64" if complex_ else "Double")


def _width(layout: str) -> tuple[int, int]:
    """Fields of a line and their width, from a Fortran format."""
    hit = re.search(r"\(?(?:\d+P,?)?(\d+)[IEDFG](\d+)", layout.upper())
    return int(hit[1]), int(hit[2])


def _fields(lines: list[str], count: int, layout: str) -> list[str]:
    per, width = _width(layout)
    out = [line[k * width : (k + 1) * width] for line in lines for k in range(per)]
    return [x for x in out if x.strip()][:count]


def parse_harwell_boeing(text: str) -> tuple[int, str, np.ndarray, np.ndarray, np.ndarray]:
    """n, type, row, column and value of each entry of an assembled file; indices from 0."""
    lines = text.split("\n")
    cards = [int(lines[1][k * 14 : (k + 1) * 14] or 0) for k in range(1, 4)]
    kind = lines[2][:3].upper()
    rows, columns, nnz = (int(lines[2][14 + k * 14 : 28 + k * 14]) for k in range(3))
    layouts = [lines[3][:16], lines[3][16:32], lines[3][32:52]]
    at = 5 if lines[1][56:70].strip() not in ("", "0") else 4
    number = lambda x: float(x.upper().replace("D", "E"))
    pointers = np.array(_fields(lines[at : at + cards[0]], columns + 1, layouts[0]), dtype=np.int64) - 1
    at += cards[0]
    i = np.array(_fields(lines[at : at + cards[1]], nnz, layouts[1]), dtype=np.int64) - 1
    at += cards[1]
    per = 2 if kind[0] == "C" else 1
    values = np.array([number(x) for x in _fields(lines[at : at + cards[2]], nnz * per, layouts[2])]) if kind[0] != "P" else np.full(nnz, np.nan)
    if per == 2:
        values = values[0::2] + 1j * values[1::2]
    return max(rows, columns), kind, i, np.repeat(np.arange(columns), np.diff(pointers)), values


def read_harwell_boeing(spark: SparkSession, path: str) -> Matrix:
    whole = spark.read.text(path, wholetext=True)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf["value"]:
                _, _, i, j, v = parse_harwell_boeing(text)
                yield pd.DataFrame({"i": i, "j": j, "re": v.real, "im": v.imag})

    size = whole.select(F.split("value", "\n")[2].alias("line")).first()["line"]
    kind = {"U": GENERAL, "S": SYMMETRIC, "H": HERMITIAN}.get(size[1].upper(), GENERAL)
    arithmetic = {"P": "Pattern", "C": "Complex64"}.get(size[0].upper(), "Double")
    return Matrix(whole.mapInPandas(entries, COO), max(int(size[14:28]), int(size[28:42])), kind, arithmetic)


def parse_grid(text: str) -> dict:
    """`[type:]nx[:ny[:nz[:alpha[:beta[:dof]]]]]`."""
    parts = text.split(":")
    arithmetic = {"p": "Pattern", "s": "Float", "d": "Double", "c": "Complex32", "z": "Complex64"}.get(parts[0].lower())
    if arithmetic:
        parts = parts[1:]
    numbers = [float(x) for x in parts]
    names = ("nx", "ny", "nz", "alpha", "beta", "dof")
    out = {"nx": 1, "ny": 1, "nz": 1, "alpha": 1.0, "beta": 1.0, "dof": 1} | dict(zip(names, numbers, strict=False))
    return {k: int(v) if k in ("nx", "ny", "nz", "dof") else v for k, v in out.items()} | {"arithmetic": arithmetic or "Double"}


def read(spark: SparkSession, driver: str, source: str, **options) -> Matrix:
    """A matrix by driver: hb, rsa, ijv, mm, spm, laplacian, xlaplacian or graph."""
    if driver in ("hb", "rsa"):
        return read_harwell_boeing(spark, source)
    if driver == "mm":
        return read_matrix_market(spark, source)
    if driver == "ijv":
        return read_ijv(spark, source, **options)
    if driver == "spm":
        return load_matrix(spark, source, **options)
    if driver in ("laplacian", "xlaplacian"):
        g = parse_grid(source)
        if driver == "xlaplacian":
            a = generators.extended_laplacian(spark, g["nx"], g["ny"], g["nz"], g["alpha"], g["beta"], g["arithmetic"])
        else:
            a = generators.laplacian(spark, g["nx"], g["ny"], g["nz"], g["alpha"], g["beta"], g["arithmetic"])
        return generators.with_dofs(a, g["dof"])
    if driver == "graph":
        edges = spark.read.schema("i long, j long").parquet(source)
        return Matrix(generators.fake_values(edges), (edges.agg(F.max(F.greatest("i", "j"))).first()[0] or 0) + 1)
    raise ValueError(f"no driver {driver}")


def check_and_correct(a: Matrix) -> Matrix:
    """Entries of the same place added up; a general pattern made symmetric with explicit zeros."""
    from ..operators.algebra import merge_duplicates

    coo = merge_duplicates(a.coo)
    if a.kind == GENERAL:
        mirror = coo.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
        coo = merge_duplicates(coo.unionByName(mirror.join(coo, ["i", "j"], "left_anti")))
    return Matrix(coo, a.n, a.kind, a.arithmetic)


def save(df: DataFrame, path: str) -> None:
    """Orderings, graphs, symbols, factors and matrices are Parquet tables."""
    df.write.mode("overwrite").parquet(path)


def load_matrix(spark: SparkSession, path: str, n: int, kind: str = GENERAL) -> Matrix:
    return Matrix(spark.read.schema(COO).parquet(path), n, kind)


def save_csv(df: DataFrame, path: str) -> None:
    """Parameters and coefficient dumps."""
    df.write.mode("overwrite").option("header", True).csv(path)


def tree_dot(tree: DataFrame) -> DataFrame:
    """Lines of a Graphviz drawing of (k, parent)."""
    return tree.where("k <> parent").select(F.format_string('"%d" -> "%d"', "parent", "k").alias("value"))
