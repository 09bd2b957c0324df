"""Iterative refinement: CG, GMRES(m), BiCGStab and simple refinement on DataFrames.

Vectors are (i, re, im). Only scalars come to the driver; each round's vectors are written once. The
residual test is ||r|| / ||b|| <= eps, with ||b|| = 1 if it is 0. A preconditioner is a function
from vector to vector, such as a solve with a factor.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import algebra
from .lineage import bucketed, cut, drop, new_path

Apply = Callable[[DataFrame], DataFrame]
EPS, MOST, RESTART = 1e-12, 250, 25


@dataclass
class Result:
    x: DataFrame
    iterations: int
    error: float
    log: list[float] = field(default_factory=list)


def matvec(entries: DataFrame) -> Apply:
    """One join and one aggregation for each product. The matrix is stored in buckets of its columns once, so a product shuffles the vector and partial sums only.

    release() of the function drops that table when no more products are wanted and those made are written.
    """
    held = bucketed(entries, "j")

    def apply(x: DataFrame) -> DataFrame:
        return algebra.spmv(held, x.select("i", F.lit(0).alias("k"), "re", "im")).select("i", "re", "im")

    apply.release = lambda: drop(held)
    return apply


def _combine(*terms: tuple[complex, DataFrame]) -> DataFrame:
    """Sum of multiples of vectors: a union and one aggregation."""
    parts = [v.select("i", *(c.alias(n) for c, n in zip(algebra.scaled(F.col("re"), F.col("im"), s), ("re", "im"), strict=True))) for s, v in terms]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return cut(algebra.summed(out, "i"))


def _dots(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> dict[str, complex]:
    """Conjugated inner products, all in one job."""
    out = None
    for name, (x, y) in pairs.items():
        a = x.select("i", F.col("re").alias("a_re"), (-F.col("im")).alias("a_im"))
        re, im = algebra.times(F.col("a_re"), F.col("a_im"), F.col("re"), F.col("im"))
        one = a.join(y, "i").select(F.lit(name).alias("name"), re.alias("re"), im.alias("im"))
        out = one if out is None else out.unionByName(one)
    rows = {r["name"]: complex(r["re"], r["im"]) for r in algebra.summed(out, "name").collect()}
    return {name: rows.get(name, 0j) for name in pairs}


def _norm(x: DataFrame) -> float:
    return float(x.agg(F.sqrt(F.sum(algebra.squares()))).first()[0] or 0.0)


def _start(a: Apply, b: DataFrame, x: DataFrame | None) -> tuple[DataFrame, DataFrame, float]:
    x = b.select("i", F.lit(0.0).alias("re"), F.lit(0.0).alias("im")) if x is None else x
    r = _combine((1, b), (-1, a(x)))
    return x, r, _norm(b) or 1.0


def cg(a: Apply, b: DataFrame, x: DataFrame | None = None, m: Apply | None = None, eps: float = EPS, most: int = MOST) -> Result:
    """Preconditioned conjugate gradients; step sizes are real."""
    if m is None:
        return _plain_cg(a, b, x, eps, most)
    x, r, size = _start(a, b, x)
    z = m(r)
    p = z
    d = _dots({"rz": (r, z), "rr": (r, r)})
    log = [abs(d["rr"]) ** 0.5 / size]
    n = 0
    while log[-1] > eps and n < most:
        q = cut(a(p))
        alpha = d["rz"].real / _dots({"pq": (p, q)})["pq"].real
        x, r = _combine((1, x), (alpha, p)), _combine((1, r), (-alpha, q))
        z = m(r)
        new = _dots({"rz": (r, z), "rr": (r, r)})
        p = _combine((1, z), (new["rz"].real / d["rz"].real, p))
        d, n = new, n + 1
        log.append(abs(d["rr"]) ** 0.5 / size)
    return Result(x, n, log[-1], log)


def _plain_cg(a: Apply, b: DataFrame, x: DataFrame | None, eps: float, most: int) -> Result:
    """Without a preconditioner x, r and p share one table, so that a round writes once and adds up twice."""
    x, r, size = _start(a, b, x)
    part = lambda v, name: v.select("i", F.col("re").alias(f"{name}_re"), F.col("im").alias(f"{name}_im"))
    s = part(r, "r").join(part(x, "x"), "i", "left").na.fill(0.0)
    s = cut(s.select("*", F.col("r_re").alias("p_re"), F.col("r_im").alias("p_im")))
    total = lambda df, re, im: float(df.agg(F.sum(re + im)).first()[0] or 0.0)
    rr = total(s, F.col("r_re") * F.col("r_re"), F.col("r_im") * F.col("r_im"))
    log = [rr**0.5 / size]
    n = 0
    while log[-1] > eps and n < most:
        q = part(a(s.select("i", F.col("p_re").alias("re"), F.col("p_im").alias("im"))), "q")
        t = cut(s.join(q, "i", "left").na.fill(0.0))
        alpha = rr / total(t, F.col("p_re") * F.col("q_re"), F.col("p_im") * F.col("q_im"))
        r_re, r_im = F.col("r_re") - alpha * F.col("q_re"), F.col("r_im") - alpha * F.col("q_im")
        new = total(t, r_re * r_re, r_im * r_im)
        moved = {"x_re": F.col("x_re") + alpha * F.col("p_re"), "x_im": F.col("x_im") + alpha * F.col("p_im"), "r_re": r_re, "r_im": r_im}
        beta = new / rr
        s = t.withColumns(moved | {"p_re": r_re + beta * F.col("p_re"), "p_im": r_im + beta * F.col("p_im")}).drop("q_re", "q_im")
        rr, n = new, n + 1
        log.append(rr**0.5 / size)
    return Result(cut(s.select("i", F.col("x_re").alias("re"), F.col("x_im").alias("im"))), n, log[-1], log)


def bicgstab(a: Apply, b: DataFrame, x: DataFrame | None = None, m: Apply | None = None, eps: float = EPS, most: int = MOST) -> Result:
    """Preconditioned stabilised biconjugate gradients."""
    m = m or (lambda v: v)
    x, r, size = _start(a, b, x)
    shadow, p = r, r
    rho = _dots({"rho": (shadow, r)})["rho"]
    log = [_norm(r) / size]
    n = 0
    while log[-1] > eps and n < most:
        y = m(p)
        v = cut(a(y))
        alpha = rho / _dots({"sv": (shadow, v)})["sv"]
        s = _combine((1, r), (-alpha, v))
        z = m(s)
        t = cut(a(z))
        d = _dots({"ts": (t, s), "tt": (t, t)})
        omega = d["ts"] / d["tt"] if d["tt"] != 0 else 0
        x, r = _combine((1, x), (alpha, y), (omega, z)), _combine((1, s), (-omega, t))
        d = _dots({"rho": (shadow, r), "rr": (r, r)})
        n += 1
        log.append(abs(d["rr"]) ** 0.5 / size)
        if log[-1] <= eps or omega == 0:
            break
        beta = d["rho"] / rho * alpha / omega
        rho = d["rho"]
        p = _combine((1, r), (beta, p), (-beta * omega, v))
    return Result(x, n, log[-1], log)


class _Basis:
    """Vectors q = 0, 1, ... as one table (q, i, re, im), so that all products with it take one join and one aggregation."""

    def __init__(self, like: DataFrame):
        self.spark, self.path, self.size = like.sparkSession, new_path(like.sparkSession, "basis"), 0

    def append(self, v: DataFrame) -> None:
        v.select("i", "re", "im", F.lit(self.size).alias("q")).write.mode("append").partitionBy("q").parquet(self.path)
        self.size += 1

    def table(self) -> DataFrame:
        return self.spark.read.schema("i long, re double, im double, q int").parquet(self.path)

    def vector(self, q: int) -> DataFrame:
        return self.table().where(F.col("q") == q).select("i", "re", "im")

    def dots(self, w: DataFrame) -> np.ndarray:
        """Conjugated inner products of all vectors with w."""
        right = w.select("i", F.col("re").alias("w_re"), F.col("im").alias("w_im"))
        re, im = algebra.times(F.col("re"), -F.col("im"), F.col("w_re"), F.col("w_im"))
        out = np.zeros(self.size, dtype=complex)
        for row in algebra.summed(self.table().join(right, "i").select("q", re.alias("re"), im.alias("im")), "q").collect():
            out[row["q"]] = complex(row["re"], row["im"])
        return out

    def combined(self, c: np.ndarray, w: DataFrame | None = None) -> DataFrame:
        """w plus the vectors' combination with coefficients c."""
        at = lambda part: F.element_at(F.array(*(F.lit(float(x)) for x in part)), F.col("q") + 1)
        re, im = algebra.times(F.col("re"), F.col("im"), at(c.real), at(c.imag))
        rows = self.table().where(F.col("q") < len(c)).select("i", re.alias("re"), im.alias("im"))
        return cut(algebra.summed(rows if w is None else rows.unionByName(w.select("i", "re", "im")), "i"))


def gmres(a: Apply, b: DataFrame, x: DataFrame | None = None, m: Apply | None = None, eps: float = EPS, most: int = MOST, restart: int = RESTART) -> Result:
    """Right-preconditioned restarted GMRES with classical Gram-Schmidt. A step takes as many jobs whatever the size of the basis."""
    m = m or (lambda v: v)
    x, r, size = _start(a, b, x)
    log = [_norm(r) / size]
    n = 0
    while log[-1] > eps and n < most:
        norm = _norm(r)
        basis = _Basis(b)
        basis.append(_combine((1 / norm, r)))
        h = np.zeros((restart + 1, restart), dtype=complex)
        small = np.zeros(restart + 1, dtype=complex)
        small[0] = norm
        for k in range(restart):
            w = cut(a(m(basis.vector(k))))
            h[: k + 1, k] = basis.dots(w)
            new = basis.combined(-h[: k + 1, k], w)
            drop(w)
            h[k + 1, k] = _norm(new)
            y, *_ = np.linalg.lstsq(h[: k + 2, : k + 1], small[: k + 2], rcond=None)
            n += 1
            log.append(float(np.linalg.norm(small[: k + 2] - h[: k + 2, : k + 1] @ y)) / size)
            if log[-1] <= eps or n >= most or abs(h[k + 1, k]) == 0:
                break
            basis.append(algebra.scal(1 / h[k + 1, k], new))
            drop(new)
        step = m(basis.combined(np.asarray(y, dtype=complex)))
        x = _combine((1, x), (1, step))
        r = _combine((1, b), (-1, a(x)))
        log[-1] = _norm(r) / size
    return Result(x, n, log[-1], log)


def simple(a: Apply, b: DataFrame, x: DataFrame | None, m: Apply, eps: float = EPS, most: int = MOST) -> Result:
    """x += M^-1 (b - A x) while the error is above eps and at least halves."""
    x, r, size = _start(a, b, x)
    log = [_norm(r) / size]
    n, last = 0, 3 * log[0]
    while log[-1] > eps and log[-1] <= last / 2 and n < most:
        last = log[-1]
        x = _combine((1, x), (1, m(r)))
        r = _combine((1, b), (-1, a(x)))
        n += 1
        log.append(_norm(r) / size)
    return Result(x, n, log[-1], log)


METHODS = {"gmres": gmres, "cg": cg, "bicgstab": bicgstab, "simple": simple}
