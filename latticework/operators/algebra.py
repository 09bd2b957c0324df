"""Vector and matrix algebra as joins and aggregations.

Everything here is a DataFrame plan of built-in functions, lazy but for the number of entries of a product's
factors. Sums are partial before a shuffle, and a product needs one grouping by the shared index and one aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import GENERAL, HERMITIAN, Matrix

NO, TRANS, CONJ = "NoTrans", "Trans", "ConjTrans"

#: Entries of both factors of a product in a range of inner indices; entries of one inner index beyond which they are not held in a row.
RANGE, HOT = 1_000_000, 100_000


def pair(value: complex) -> tuple[float, float]:
    return float(complex(value).real), float(complex(value).imag)


def times(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> tuple[Column, Column]:
    return a_re * b_re - a_im * b_im, a_re * b_im + a_im * b_re


def scaled(re: Column, im: Column, by: complex) -> tuple[Column, Column]:
    x, y = pair(by)
    if y == 0:
        return re * x, im * x
    return re * x - im * y, re * y + im * x


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def merge_duplicates(coo: DataFrame) -> DataFrame:
    """Entries of the same place added up."""
    return summed(coo, "i", "j")


def transpose(coo: DataFrame, conjugate: bool = False) -> DataFrame:
    return coo.select(F.col("j").alias("i"), F.col("i").alias("j"), "re", (-F.col("im") if conjugate else F.col("im")).alias("im"))


def full(a: Matrix) -> DataFrame:
    """All entries of a matrix that may store one triangle only."""
    if a.kind == GENERAL:
        return a.coo
    return a.coo.unionByName(transpose(a.coo.where("i <> j"), a.kind == HERMITIAN))


def operand(a: Matrix, trans: str = NO) -> DataFrame:
    entries = full(a)
    if trans == NO:
        return entries
    return transpose(entries, trans == CONJ)


def spmv(entries: DataFrame, x: DataFrame, alpha: complex = 1.0, beta: complex = 0.0, y: DataFrame | None = None) -> DataFrame:
    """alpha * A x + beta * y for entries (i, j, re, im) and vectors (i, k, re, im)."""
    b = x.select(F.col("i").alias("j"), "k", F.col("re").alias("x_re"), F.col("im").alias("x_im"))
    re, im = times(F.col("re"), F.col("im"), F.col("x_re"), F.col("x_im"))
    out = summed(entries.join(b, "j").select("i", "k", re.alias("re"), im.alias("im")), "i", "k")
    re, im = scaled(F.col("re"), F.col("im"), alpha)
    out = out.select("i", "k", re.alias("re"), im.alias("im"))
    if y is None or beta == 0:
        return out
    return axpy(1.0, out, scal(beta, y))


def copy(x: DataFrame) -> DataFrame:
    return x.select("*")


def scal(alpha: complex, x: DataFrame) -> DataFrame:
    re, im = scaled(F.col("re"), F.col("im"), alpha)
    return x.withColumns({"re": re, "im": im})


def axpy(alpha: complex, x: DataFrame, y: DataFrame) -> DataFrame:
    """alpha * x + y; a component that one side lacks is 0 there."""
    keys = [c for c in x.columns if c not in ("re", "im")]
    a = x.select(*keys, F.col("re").alias("a_re"), F.col("im").alias("a_im"))
    b = y.select(*keys, F.col("re").alias("b_re"), F.col("im").alias("b_im"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    re, im = scaled(zero("a_re"), zero("a_im"), alpha)
    return a.join(b, keys, "full_outer").select(*keys, (re + zero("b_re")).alias("re"), (im + zero("b_im")).alias("im"))


def dot(x: DataFrame, y: DataFrame, conjugate: bool = False) -> DataFrame:
    """Per right-hand side k the sum of x * y, x conjugated if asked."""
    a = x.select("i", "k", F.col("re").alias("a_re"), (-F.col("im") if conjugate else F.col("im")).alias("a_im"))
    re, im = times(F.col("a_re"), F.col("a_im"), F.col("re"), F.col("im"))
    return summed(a.join(y, ["i", "k"]).select("k", re.alias("re"), im.alias("im")), "k")


def squares() -> Column:
    return F.col("re") * F.col("re") + F.col("im") * F.col("im")


def nrm2(x: DataFrame) -> DataFrame:
    """Per k the 2-norm. Components are scaled by the largest, so squares neither overflow nor vanish."""
    size = F.sqrt(squares())
    large = F.greatest(F.abs("re"), F.abs("im"))
    top = x.groupBy("k").agg(F.max(large).alias("top"))
    part = F.when(F.col("top") > 0, (F.col("re") / F.col("top")) * (F.col("re") / F.col("top")) + (F.col("im") / F.col("top")) * (F.col("im") / F.col("top"))).otherwise(size)
    return x.join(F.broadcast(top), "k").groupBy("k").agg((F.first("top") * F.sqrt(F.sum(part))).alias("norm"))


def gemv(a: DataFrame, x: DataFrame, alpha: float = 1.0, beta: float = 0.0, y: DataFrame | None = None) -> DataFrame:
    """alpha * A x + beta * y for a tall dense matrix of rows (i, row array<double>) and a short vector (j, re)."""
    cells = a.select("i", F.posexplode("row").alias("j", "v"))
    # x is as long as the matrix is wide: a few components
    out = cells.join(F.broadcast(x.select(F.col("j").cast("int").alias("j"), "re")), "j").groupBy("i").agg((F.lit(float(alpha)) * F.sum(F.col("v") * F.col("re"))).alias("re"))
    if y is None:
        return out
    return out.join(y.select("i", F.col("re").alias("b")), "i").select("i", (F.col("re") + F.lit(float(beta)) * F.col("b")).alias("re"))


def norms(entries: DataFrame) -> DataFrame:
    """Max, infinity (row sums), one (column sums) and Frobenius norm. Squares are those of entries over a power of two near the largest, so they neither overflow nor vanish."""
    # hypot does not overflow either
    e = entries.select("i", "j", F.hypot("re", "im").alias("size"))
    top = entries.agg(F.max(F.greatest(F.abs("re"), F.abs("im")))).first()[0]
    scale = 2.0 ** math.frexp(top)[1] if top and math.isfinite(top) and abs(math.frexp(top)[1]) < 1000 else (top or 1.0)
    part = F.col("size") / scale
    rows = e.groupBy("i").agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.sum(part * part).alias("q"))
    none = F.lit(None).cast("double")
    by_row = rows.select("m", "s", "q", none.alias("c"))
    by_column = e.groupBy("j").agg(F.sum("size").alias("c")).select(none.alias("m"), none.alias("s"), none.alias("q"), "c")
    both = by_row.unionByName(by_column)
    return both.agg(F.max("m").alias("norm_max"), F.max("s").alias("norm_inf"), F.max("c").alias("norm_one"), (F.sqrt(F.sum("q")) * scale).alias("norm_fro"))


def add(a: DataFrame, b: DataFrame, alpha: complex = 1.0, beta: complex = 1.0, trans: str = NO) -> DataFrame:
    """alpha * op(A) + beta * B of entries."""
    return axpy(alpha, a if trans == NO else transpose(a, trans == CONJ), scal(beta, b))


def scaled_product(a: DataFrame, d: DataFrame, b: DataFrame, alpha: complex = 1.0) -> DataFrame:
    """alpha * A D B with a diagonal d (i, re, im): a join and a grouping on the inner index, one aggregation."""
    re, im = times(F.col("re"), F.col("im"), F.col("d_re"), F.col("d_im"))
    left = a.join(d.select(F.col("i").alias("j"), F.col("re").alias("d_re"), F.col("im").alias("d_im")), "j").select("i", "j", re.alias("re"), im.alias("im"))
    return product(left, b, alpha)


def product(a: DataFrame, b: DataFrame, alpha: complex = 1.0) -> DataFrame:
    """alpha * A B of entries.

    A column of A and its row of B meet in one row of a table dealt to ranges of the inner index, so a task adds up the products of neighbouring
    indices before they are shuffled. A range holds about RANGE entries. An inner index with more than HOT entries goes by a join of its entries instead.
    """
    left = a.where("j is not null").select(F.col("j").alias("m"), F.struct("i", "re", "im").alias("l"))
    right = b.where("i is not null").select(F.col("i").alias("m"), F.struct("j", "re", "im").alias("r"))
    both = left.unionByName(right, allowMissingColumns=True)
    sizes = both.groupBy("m").agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    hot = F.broadcast(sizes.where(F.col("n") > HOT).select("m")) if most > HOT else None  # total / HOT rows at most
    if hot is not None:
        both = both.join(hot, "m", "left_anti")
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    met = both.repartitionByRange(parts, "m").groupBy("m").agg(F.collect_list("l").alias("ls"), F.collect_list("r").alias("rs"))
    pairs = met.where("size(rs) > 0").select("rs", F.explode("ls").alias("l")).select("l", F.explode("rs").alias("r"))
    if hot is not None:
        pairs = pairs.unionByName(left.join(hot, "m", "left_semi").join(right, "m").select("l", "r"))
    re, im = times(F.col("l.re"), F.col("l.im"), F.col("r.re"), F.col("r.im"))
    return scal(alpha, summed(pairs.select("l.i", "r.j", re.alias("re"), im.alias("im")), "i", "j"))


def gram(a: DataFrame, d: DataFrame | None = None, alpha: complex = 1.0, lower: bool = False) -> DataFrame:
    """alpha * A D A^T of entries, with a diagonal d (i, re, im) or none; lower: its entries i >= j alone.

    As product, but the entries of A go to the ranges once, the diagonal along with them, and the products of one triangle are made and shuffled: the other one is its mirror image.
    """
    left = a.where("j is not null").select(F.col("j").alias("m"), F.struct("i", "re", "im").alias("l"))
    sizes = left.groupBy("m").agg(F.count("*").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    hot = F.broadcast(sizes.where(F.col("n") > HOT).select("m")) if most > HOT else None  # total / HOT rows at most
    if d is not None:
        left = left.withColumn("d", F.lit(None).cast("struct<re:double,im:double>"))
        d = d.where("i is not null").select(F.col("i").alias("m"), F.struct("re", "im").alias("d"))
    cold = left if hot is None else left.join(hot, "m", "left_anti")
    rows = cold if d is None else cold.unionByName(d if hot is None else d.join(hot, "m", "left_anti"), allowMissingColumns=True)
    parts = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    scale = [] if d is None else [F.sum("d.re").alias("d_re"), F.sum("d.im").alias("d_im")]
    # null entries are not collected
    met = rows.repartitionByRange(parts, "m").groupBy("m").agg(F.collect_list("l").alias("ls"), *scale)
    if d is not None:
        met = met.where("d_re is not null")
    names = [c for c in met.columns if c.startswith("d_")]
    pairs = met.select("ls", *names, F.explode("ls").alias("l")).select("l", *names, F.explode("ls").alias("r"))
    if hot is not None:
        whole = left.select("m", "l").join(hot, "m", "left_semi")
        if d is not None:
            whole = whole.join(d.join(hot, "m", "left_semi").groupBy("m").agg(*scale), "m")
        pairs = pairs.unionByName(whole.join(left.select("m", F.col("l").alias("r")), "m").select("l", *names, "r"))
    pairs = pairs.where("r.i is null or l.i >= r.i")
    re, im = F.col("l.re"), F.col("l.im")
    if d is not None:
        re, im = times(re, im, F.col("d_re"), F.col("d_im"))
    re, im = times(re, im, F.col("r.re"), F.col("r.im"))
    out = summed(pairs.select("l.i", F.col("r.i").alias("j"), re.alias("re"), im.alias("im")), "i", "j")
    if not lower:
        place, mirror = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
        out = out.select(F.explode(F.when(F.col("i").eqNullSafe(F.col("j")), F.array(place)).otherwise(F.array(place, mirror))).alias("at"), "re", "im").select("at.*", "re", "im")
    return scal(alpha, out)


def largest(entries: DataFrame, n: int) -> DataFrame:
    """The n entries of largest modulus; ties by row, then column. Each task keeps n at most."""
    return entries.orderBy(F.hypot("re", "im").desc(), "i", "j").limit(n)


def diagonal(entries: DataFrame) -> DataFrame:
    return entries.where("i = j").select("i", "re", "im")


def scale_rows(entries: DataFrame, by: DataFrame, divide: bool = False) -> DataFrame:
    """Vectors or entries times (or over) a diagonal (i, re, im)."""
    d = by.select("i", F.col("re").alias("d_re"), F.col("im").alias("d_im"))
    if divide:
        # by the modulus twice: its square may vanish or overflow where the quotient does not
        m = F.hypot("d_re", "d_im")
        re, im = times(F.col("re") / m, F.col("im") / m, F.col("d_re") / m, -F.col("d_im") / m)
    else:
        re, im = times(F.col("re"), F.col("im"), F.col("d_re"), F.col("d_im"))
    return entries.join(d, "i").withColumns({"re": re, "im": im}).drop("d_re", "d_im")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest difference of two matrices or factors, and the number of places that only one of them has."""
    keys = [c for c in a.columns if c not in ("re", "im")]
    x = a.select(*keys, F.col("re").alias("a_re"), F.col("im").alias("a_im"))
    y = b.select(*keys, F.col("re").alias("b_re"), F.col("im").alias("b_im"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    gap = F.sqrt((z("a_re") - z("b_re")) * (z("a_re") - z("b_re")) + (z("a_im") - z("b_im")) * (z("a_im") - z("b_im")))
    only = (F.col("a_re").isNull() | F.col("b_re").isNull()).cast("long")
    return x.join(y, keys, "full_outer").agg(F.max(gap).alias("max_difference"), F.sum(only).alias("unmatched"))


def residual(entries: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """b - A x."""
    return axpy(-1.0, spmv(entries, x), b)


def check(entries: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """Per k the backward error ||b - A x|| / ||b|| (||b|| = 1 if it is 0)."""
    top = residual(entries, x, b).groupBy("k").agg(F.sqrt(F.sum(squares())).alias("r"))
    low = b.groupBy("k").agg(F.sqrt(F.sum(squares())).alias("b"))
    return top.join(low, "k").select("k", (F.col("r") / F.when(F.col("b") > 0, F.col("b")).otherwise(1.0)).alias("error"))


def to_single(x: DataFrame) -> DataFrame:
    """Components rounded to single precision, kept as doubles."""
    return x.withColumns({c: F.col(c).cast("float").cast("double") for c in ("re", "im")})
