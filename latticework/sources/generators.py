"""Matrices and right-hand sides made from their indices alone, the same on any layout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import GENERAL, HERMITIAN, SYMMETRIC, Matrix

#: Multiplier, increment and scale of the 64-bit generator.
LCG_A, LCG_C, LCG_SCALE = 6364136223846793005, 1, 5.4210108624275222e-20


def laplacian(spark: SparkSession, nx: int, ny: int = 1, nz: int = 1, alpha: float = 1.0, beta: float = 1.0, arithmetic: str = "Double", hermitian: bool = False) -> Matrix:
    """Lower triangle of alpha * D - beta * Adj on a grid with x fastest, D the degrees. Hermitian edges have an imaginary part."""
    v = spark.range(nx * ny * nz).select(F.col("id").alias("i"), (F.col("id") % nx).alias("x"), (F.floor(F.col("id") / nx) % ny).alias("y"), F.floor(F.col("id") / (nx * ny)).alias("z"))
    degree = sum(((F.col(c) > 0).cast("int") + (F.col(c) < n - 1).cast("int")) for c, n in (("x", nx), ("y", ny), ("z", nz)))
    im = -beta / 2 if hermitian else 0.0
    entry = lambda j, re, im: F.struct(j.cast("long").alias("j"), re.alias("re"), F.lit(im).alias("im"))
    cells = F.array(
        entry(F.col("i"), F.lit(float(alpha)) * degree, 0.0),
        *(F.when(F.col(c) > 0, entry(F.col("i") - step, F.lit(-float(beta)), im)) for c, step in (("x", 1), ("y", nx), ("z", nx * ny))),
    )
    coo = v.select("i", F.explode(F.filter(cells, lambda e: e.isNotNull())).alias("e")).select("i", "e.j", "e.re", "e.im")
    return Matrix(coo, nx * ny * nz, HERMITIAN if hermitian else SYMMETRIC, "Complex64" if hermitian else arithmetic)


def extended_laplacian(spark: SparkSession, nx: int, ny: int = 1, nz: int = 1, alpha: float = 1.0, beta: float = 1.0, arithmetic: str = "Double") -> Matrix:
    """Lower triangle of a grid Laplacian with neighbours along edges and all diagonals: 9 points in two directions, 27 in three.

    In complex arithmetic it is Hermitian: edges have an imaginary part, as those of laplacian.
    """
    v = spark.range(nx * ny * nz).select(F.col("id").alias("i"), (F.col("id") % nx).alias("x"), (F.floor(F.col("id") / nx) % ny).alias("y"), F.floor(F.col("id") / (nx * ny)).alias("z"))
    # the neighbours with smaller numbers; the others are their mirror images
    shifts = [(a, b, c) for c in (-1, 0) for b in (-1, 0, 1) for a in (-1, 0, 1) if (c, b, a) < (0, 0, 0)]
    inside = lambda a, b, c: (F.col("x") + a).between(0, nx - 1) & (F.col("y") + b).between(0, ny - 1) & (F.col("z") + c).between(0, nz - 1)
    degree = sum(inside(*s).cast("int") + inside(*(-t for t in s)).cast("int") for s in shifts)
    is_complex = arithmetic.startswith("Complex")
    entry = lambda j, re, im: F.struct(j.cast("long").alias("j"), re.alias("re"), F.lit(im).alias("im"))
    im = -beta / 2 if is_complex else 0.0
    near = (F.when(inside(a, b, c), entry(F.col("i") + a + b * nx + c * nx * ny, F.lit(-float(beta)), im)) for a, b, c in shifts)
    cells = F.array(entry(F.col("i"), F.lit(float(alpha)) * degree, 0.0), *near)
    coo = v.select("i", F.explode(F.filter(cells, lambda e: e.isNotNull())).alias("e")).select("i", "e.j", "e.re", "e.im")
    return Matrix(coo, nx * ny * nz, HERMITIAN if is_complex else SYMMETRIC, arithmetic)


def with_dofs(a: Matrix, dof: int) -> Matrix:
    """Every vertex as dof unknowns: the product A x B with B = 1 on the diagonal and 1 / (2 dof) beside it, which is definite if A is."""
    if dof == 1:
        return a
    cell = F.explode(F.sequence(F.lit(0), F.lit(dof - 1)))
    rows = a.coo.withColumn("a", cell).withColumn("b", cell)
    if a.kind != GENERAL:  # a block on the diagonal keeps its lower triangle
        rows = rows.where("i <> j or a >= b")
    by = F.when(F.col("a") == F.col("b"), 1.0).otherwise(1 / (2 * dof))
    coo = rows.select((F.col("i") * dof + F.col("a")).alias("i"), (F.col("j") * dof + F.col("b")).alias("j"), (F.col("re") * by).alias("re"), (F.col("im") * by).alias("im"))
    return Matrix(coo, a.n * dof, a.kind, a.arithmetic, dof)


def with_variable_dofs(a: Matrix, dofs: DataFrame) -> Matrix:
    """Every vertex as unknowns of its own number, from offsets (i, begin, end); values as in with_dofs, so definite if A is."""
    n, most = dofs.agg(F.coalesce(F.max("end"), F.lit(0)), F.coalesce(F.max(F.col("end") - F.col("begin")), F.lit(1))).first()
    own = dofs.where("end > begin")
    rows = own.select("i", F.col("begin").alias("row"), F.col("end").alias("row_end"))
    cols = own.select(F.col("i").alias("j"), F.col("begin").alias("col"), F.col("end").alias("col_end"))
    cell = lambda begin, end: F.explode(F.sequence(F.lit(0).cast("long"), F.col(end) - F.col(begin) - 1))
    out = a.coo.join(rows, "i").join(cols, "j").withColumn("a", cell("row", "row_end")).withColumn("b", cell("col", "col_end"))
    if a.kind != GENERAL:  # the triangle that is stored
        out = out.where("i <> j or a >= b")
    by = F.when(F.col("a") == F.col("b"), 1.0).otherwise(1 / (2 * most))
    coo = out.select((F.col("row") + F.col("a")).alias("i"), (F.col("col") + F.col("b")).alias("j"), (F.col("re") * by).alias("re"), (F.col("im") * by).alias("im"))
    return Matrix(coo, n, a.kind, a.arithmetic, dofs=dofs)


def fake_values(edges: DataFrame) -> DataFrame:
    """Values for a pattern: -1 off the diagonal, and on it one more than the entries of the row."""
    count = edges.where("i <> j").groupBy("i").agg(F.count("*").alias("c"))
    diag = edges.select(F.explode(F.array("i", "j")).alias("i")).distinct().join(count, "i", "left")
    zero = F.lit(0.0).alias("im")
    off = edges.where("i <> j").select("i", "j", F.lit(-1.0).alias("re"), zero)
    return off.unionByName(diag.select("i", F.col("i").alias("j"), (F.coalesce("c", F.lit(0)) + 1).cast("double").alias("re"), zero))


def random_vector(spark: SparkSession, n: int, seed: int, k: int = 1) -> DataFrame:
    """k columns of n components in (-0.5, 0.5] from jumps of a 64-bit linear congruential generator.

    The states come with numpy's wrapping integers, batch by batch.
    """
    steps = [(LCG_A, LCG_C)]
    for _ in range(63):
        a, c = steps[-1]
        steps.append(((a * a) % (1 << 64), (c * (a + 1)) % (1 << 64)))

    def run(batches):
        for pdf in batches:
            at = (pdf["k"].to_numpy(dtype=np.uint64) * np.uint64(n)) + pdf["i"].to_numpy(dtype=np.uint64)
            state = np.full(len(pdf), seed, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for b, (a, c) in enumerate(steps):
                    on = (at >> np.uint64(b)) & np.uint64(1) == 1
                    state[on] = state[on] * np.uint64(a) + np.uint64(c)
            yield pd.DataFrame({"i": pdf["i"], "k": pdf["k"], "re": 0.5 - state.astype(np.float64) * LCG_SCALE, "im": 0.0})

    base = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("k"))
    return base.mapInPandas(run, "i long, k int, re double, im double")


def right_hand_side(a: Matrix, k: int = 1, seed: int = 3927, known: bool = True) -> tuple[DataFrame | None, DataFrame]:
    """A random solution and its right-hand side A x; if it is not to be known, None and a random right-hand side."""
    from ..operators.algebra import full, spmv

    x = random_vector(a.coo.sparkSession, a.n, seed, k)
    return (x, spmv(full(a), x)) if known else (None, x)
