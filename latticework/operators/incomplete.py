"""Incomplete factorization on a fixed pattern, ILU(k), as joins, and its use as a preconditioner.

The pattern has the entries of A and fill of level k at most. Its values solve (L U)(i, j) = A(i, j) at every place (i, j) of the pattern, L with a
unit diagonal. A row is eliminated once it has the finished rows of all its entries below the diagonal; a finished row is sent to
the rows of its entries above the diagonal. So a round moves what still waits and the rows that were finished before it, and rounds are as many as the
longest chain of rows that wait for each other: a dozen where the numbers of neighbours are in no order, whatever the size.

Where that chain is long, as in a mesh numbered line by line, too few rows are finished in a round, and the rest goes by sweeps, which
compute all values at once from the ones before: one join of L and U on the inner
index, one aggregation. An entry is right as soon as all those are that it depends on, so sweeps end at the
factors that elimination gives, after as many as the longest chain of dependent entries at most; far fewer make them
stand still, as errors shrink from sweep to sweep.

The preconditioner solves with both factors by a fixed number of Jacobi steps each, which is a fixed linear map, as
Krylov methods need. A step is one product; no vertex waits for another and no task holds more than its part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import hypot

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import algebra
from .lineage import cut, drop
from .refine import Apply, matvec
from .symbolic import incomplete_levels

SWEEPS, STEPS, EPS = 60, 6, 1e-14


@dataclass(frozen=True)
class Incomplete:
    """lower (i > j), upper (i <= j), each (i, j, re, im); sweeps made after the rounds of rows, and the largest change of the last one over the largest entry of A, 0 without any."""

    lower: DataFrame
    upper: DataFrame
    sweeps: int
    change: float

    def preconditioner(self, steps: int = STEPS) -> Apply:
        """A function from b to about U^-1 L^-1 b."""
        low = matvec(self.lower)
        up = matvec(self.upper.where("i < j"))
        pivots = cut(self.upper.where("i = j").select("i", "re", "im"))

        def apply(b: DataFrame) -> DataFrame:
            b = b.select("i", "re", "im")
            y = b
            for _ in range(steps):
                y = _minus(b, low(y))
            y = cut(y)
            z = start = algebra.scale_rows(y, pivots, divide=True)
            for _ in range(steps):
                z = _minus(start, algebra.scale_rows(up(z), pivots, divide=True))
            return cut(z)

        apply.release = lambda: (low.release(), up.release())
        return apply


def _minus(x: DataFrame, y: DataFrame) -> DataFrame:
    """x - y, on the components of x."""
    y = y.select("i", F.col("re").alias("y_re"), F.col("im").alias("y_im"))
    zero = F.lit(0.0)
    return x.join(y, "i", "left").select("i", (F.col("re") - F.coalesce("y_re", zero)).alias("re"), (F.col("im") - F.coalesce("y_im", zero)).alias("im"))


def pattern(entries: DataFrame, level: int) -> DataFrame:
    """Places (i, j) of ILU(level): entries, diagonal and fill of that level at most. The pattern of entries must be symmetric."""
    off = entries.where("i <> j").select("i", "j").distinct()
    if level:
        off = incomplete_levels(off, level).select("i", "j")
    return off.unionByName(entries.select("i", F.col("i").alias("j")).distinct())


def factorize(entries: DataFrame, level: int = 0, sweeps: int = SWEEPS, eps: float = EPS, least: float = 1e-300) -> Incomplete:
    """Factors of all entries (i, j, re, im) of a matrix. A pivot whose modulus is below `least` counts as that."""
    places = pattern(entries, level)
    zero = F.lit(0.0)
    a = places.join(algebra.summed(entries, "i", "j"), ["i", "j"], "left").select("i", "j", F.coalesce("re", zero).alias("a_re"), F.coalesce("im", zero).alias("a_im"))
    a = cut(a)
    top = a.agg(F.max(F.hypot("a_re", "a_im"))).first()[0] or 1.0
    rows, waiting = _rows(a, least, sweeps)
    if waiting is None:
        return Incomplete(rows.where("i > j"), rows.where("i <= j"), 0, 0.0)
    start = _start(a, least)
    now = cut(start if rows is None else rows.unionByName(start.join(waiting.select("i"), "i", "left_semi").select("i", "j", "re", "im")))
    drop(waiting)
    done, change = 0, 0.0
    while done < sweeps:
        low = now.where("i > j").select("i", F.col("j").alias("p"), "re", "im")
        up = now.where("i <= j").select(F.col("i").alias("p"), "j", F.col("re").alias("u_re"), F.col("im").alias("u_im"))
        re, im = algebra.times(F.col("re"), F.col("im"), F.col("u_re"), F.col("u_im"))
        # L(i, p) U(p, j) with p below both; a unit of L and a pivot of U take no part
        sums = low.join(up.where("p < j"), "p").select("i", "j", re.alias("s_re"), im.alias("s_im")).groupBy("i", "j").agg(F.sum("s_re").alias("s_re"), F.sum("s_im").alias("s_im"))
        rest = a.join(sums, ["i", "j"], "left").select("i", "j", (F.col("a_re") - F.coalesce("s_re", zero)).alias("re"), (F.col("a_im") - F.coalesce("s_im", zero)).alias("im"))
        new = cut(_over_pivots(rest, now, least))
        gap = new.join(now.select("i", "j", F.col("re").alias("o_re"), F.col("im").alias("o_im")), ["i", "j"])
        change = gap.agg(F.max(F.hypot(F.col("re") - F.col("o_re"), F.col("im") - F.col("o_im")))).first()[0] or 0.0
        drop(now)
        now, done = new, done + 1
        if change <= eps * top:
            break
    return Incomplete(now.where("i > j"), now.where("i <= j"), done, change / top)


_ROW = "i long, js array<long>, re array<double>, im array<double>"


def _rows(a: DataFrame, least: float, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Entries (i, j, re, im) of finished rows, and the rows that still wait: None, if all are finished.

    Rounds go on while they finish so many rows that `most` of them will do. A row waits with the finished rows (j, re, im, pivot first) that it was sent.
    """
    sent = "array<struct<j:array<long>,re:array<double>,im:array<double>>>"
    held = a.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "a_re", "a_im"))).alias("row"))
    held = held.select("i", F.col("row.j").alias("js"), F.col("row.a_re").alias("re"), F.col("row.a_im").alias("im"))
    now = cut(held.withColumn("need", F.expr("size(filter(js, j -> j < i))")).withColumn("got", F.array().cast(sent)), "rows")
    done: list[DataFrame] = []
    left = now.count()
    while left:
        ready = F.size("got") == F.col("need")
        flat = now.where(ready).select("i", "js", "re", "im", F.transform("got", lambda u: F.size(u["j"])).alias("sizes"), *(F.flatten(f"got.{c}").alias(f"u_{c}") for c in ("j", "re", "im")))
        new = cut(flat.mapInPandas(_eliminated(least), _ROW), "finished")
        made = new.count()
        if made * (most - len(done)) < left:
            drop(new)
            break
        done.append(new)
        left -= made
        if not left:
            break
        upper = [F.expr(f"filter({c}, (x, n) -> js[n] >= i)").alias(c) for c in ("js", "re", "im")]
        given = new.select(F.col("i").alias("p"), *upper).select(F.explode("js").alias("i"), "p", F.struct(F.col("js").alias("j"), "re", "im").alias("u")).where("i > p")
        given = given.groupBy("i").agg(F.collect_list("u").alias("more"))
        more = F.filter(F.coalesce("more", F.array().cast(sent)), lambda u: F.array_contains("js", u["j"][0]))
        later = cut(now.where(~ready).join(given, "i", "left").select("i", "js", "re", "im", "need", F.concat("got", more).alias("got")), "rows")
        drop(now)
        now = later
    if not left:
        drop(now)
    rows = None
    for d in done:
        each = d.select("i", F.explode(F.arrays_zip("js", "re", "im")).alias("e")).select("i", F.col("e.js").alias("j"), "e.re", "e.im")
        rows = each if rows is None else rows.unionByName(each)
    if rows is None and not left:  # a matrix without rows
        rows = a.select("i", "j", F.col("a_re").alias("re"), F.col("a_im").alias("im"))
    if done:  # one table for those that read it several times
        rows = cut(rows, "factor")
        drop(*done)
    return rows, now if left else None


def _eliminated(least: float):
    """Rows after the elimination with those that they were sent: L, then U."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                row = dict(zip(r.js.tolist(), (r.re + 1j * r.im if r.im.any() else r.re).tolist(), strict=True))
                ends = np.cumsum(r.sizes).tolist()
                js, us = r.u_j.tolist(), (r.u_re + 1j * r.u_im if r.u_im.any() else r.u_re).tolist()
                for begin, end in sorted(zip([0, *ends], ends, strict=False), key=lambda x: js[x[0]]):
                    pivot = us[begin]
                    if hypot(pivot.real, pivot.imag) < least:
                        pivot = least
                    low = row[js[begin]] = row[js[begin]] / pivot
                    for n in range(begin + 1, end):
                        if js[n] in row:
                            row[js[n]] -= low * us[n]
                v = np.array(list(row.values()))
                out.append((r.i, r.js, v.real, v.imag))
            yield pd.DataFrame(out, columns=["i", "js", "re", "im"])

    return run


def _over_pivots(rest: DataFrame, now: DataFrame, least: float) -> DataFrame:
    """Entries below the diagonal divided by the pivot of their column."""
    size = F.hypot("re", "im")
    small = size < least
    one = lambda c, other: F.when(small, F.lit(other)).otherwise(F.col(c))
    pivots = now.where("i = j").select("j", one("re", least).alias("d_re"), one("im", 0.0).alias("d_im"))
    # divided by the modulus twice, so that no square over- or underflows
    size = F.hypot("d_re", "d_im")
    re, im = algebra.times(F.col("re") / size, F.col("im") / size, F.col("d_re") / size, -F.col("d_im") / size)
    low = F.col("i") > F.col("j")
    return rest.join(pivots, "j").select("i", "j", F.when(low, re).otherwise(F.col("re")).alias("re"), F.when(low, im).otherwise(F.col("im")).alias("im"))


def _start(a: DataFrame, least: float) -> DataFrame:
    plain = a.select("i", "j", F.col("a_re").alias("re"), F.col("a_im").alias("im"))
    return _over_pivots(plain, plain, least)


def product(f: Incomplete) -> DataFrame:
    """L U of the factors: (i, j, re, im), on the pattern and beyond it."""
    low = f.lower.select("i", "j", "re", "im").unionByName(f.upper.where("i = j").select("i", "j", F.lit(1.0).alias("re"), F.lit(0.0).alias("im")))
    return algebra.product(low, f.upper)
