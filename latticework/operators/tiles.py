"""Large fronts in tiles: elimination and solves of supernodes whose front is more than a task should hold.

A front (a supernode's columns, then its rows) is a table of square tiles (grp, a, b, pivots, tiles, data): a and b number the
tiles' rows and columns, the first `pivots` of `tiles` hold the supernode's columns, data is the tile by rows, null for zeros.
A step eliminates a block of columns of tiles, as many as have TILE rows: its corner is factorized, the blocks of tiles below (and of LU those to the right) are
solved with it, and each remaining block of tiles meets its two partners in a cogroup. So a task holds three blocks of 8 MB at a time (or three tiles, if those are larger)
whatever the width of the front, steps are as many as the front's columns over TILE, and all fronts of a stage go together. Symmetric kinds keep the tiles a >= b.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import factor_front
from .lineage import cut, drop

#: Rows of a tile, and of a block of smaller ones, 8 MB of doubles; rows of a front that is one task still, 288 MB.
TILE, FRONT = 1_024, 6_000

_PARTS = "part string, k long, i long, j long, b long, re double, im double"


@dataclass(frozen=True)
class Tiled:
    """Factor tiles (stage, grp, pivots, a, b, low, up), a >= b, up the transposed tile of U and null but for LU; places (stage, grp, k, t, o, i); steps: most columns of pivot tiles by stage; together: those that a sweep solves at once."""

    tiles: DataFrame
    places: DataFrame
    steps: dict[int, int]
    together: int = 1


def places(nodes: DataFrame, tile: int) -> DataFrame:
    """(stage, grp, k, t, o, i) of nodes (stage, grp, k, first, last, rows): row i of a front is row o of the tile row t."""
    t, o = F.floor(F.col("p") / tile).cast("int"), (F.col("p") % tile).cast("int")
    own = nodes.select("stage", "grp", "k", F.posexplode(F.sequence("first", "last")).alias("p", "i"))
    below = nodes.select("stage", "grp", "k", _pivots(tile).alias("begin"), F.posexplode("rows").alias("p", "i"))
    return own.select("stage", "grp", "k", t.alias("t"), o.alias("o"), "i").unionByName(below.select("stage", "grp", "k", (t + F.col("begin")).alias("t"), o.alias("o"), "i"))


def _pivots(tile: int):
    return F.ceil((F.col("last") - F.col("first") + 1) / tile).cast("int")


def steps(nodes: DataFrame, tile: int) -> dict[int, int]:
    """Most columns of pivot tiles, by stage."""
    return {r[0]: r[1] for r in nodes.groupBy("stage").agg(F.max(_pivots(tile))).collect()}


def _pack(x: np.ndarray | None) -> bytes | None:
    return None if x is None else np.ascontiguousarray(x).tobytes()


def _values(pdf: pd.DataFrame, is_complex: bool) -> np.ndarray:
    return pdf["re"].to_numpy() + (1j * pdf["im"].to_numpy() if is_complex else 0)


def fronts(entries: DataFrame, nodes: DataFrame, at: DataFrame, tile: int, symmetric: bool, is_complex: bool) -> DataFrame:
    """All tiles of the nodes' fronts from entries (grp, i, j, re, im) without repetitions."""
    kind = complex if is_complex else float
    size = at.groupBy("grp", "t").agg(F.count("*").cast("int").alias("n"))
    row, column = (at.select("grp", F.col("t").alias(t), F.col("o").alias(o), F.col("i").alias(i)) for t, o, i in (("a", "x", "i"), ("b", "y", "j")))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((tile, tile), dtype=kind)
        out[pdf["x"].to_numpy(), pdf["y"].to_numpy()] = _values(pdf, is_complex)
        return pd.DataFrame({"grp": [key[0]], "a": [key[1]], "b": [key[2]], "full": [_pack(out)]})

    filled = entries.join(row, ["grp", "i"]).join(column, ["grp", "j"]).groupBy("grp", "a", "b").applyInPandas(fill, "grp long, a int, b int, full binary")
    shape = nodes.select("grp", _pivots(tile).alias("pivots"), (_pivots(tile) + F.ceil(F.size("rows") / tile)).cast("int").alias("tiles"))
    every = shape.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    every = every.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("a") if symmetric else F.col("tiles") - 1)))
    every = every.join(size.select("grp", F.col("t").alias("a"), F.col("n").alias("m")), ["grp", "a"]).join(size.select("grp", F.col("t").alias("b"), "n"), ["grp", "b"])

    def trim(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m, n, full = int(pdf["m"][0]), int(pdf["n"][0]), pdf["full"][0]
        pdf["data"] = [None if full is None else _pack(np.frombuffer(full, dtype=kind).reshape(tile, tile)[:m, :n])]
        return pdf[_NAMES]

    return every.join(filled, ["grp", "a", "b"], "left").groupBy("grp", "a", "b").applyInPandas(trim, _FRONT)


_FRONT = "grp long, a int, b int, pivots int, tiles int, m int, n int, data binary"
_NAMES = ["grp", "a", "b", "pivots", "tiles", "m", "n", "data"]


def factorize(front: DataFrame, most: int, kind: str, criterion: float, is_complex: bool, together: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Eliminates the pivot tiles of fronts, `most` columns of them at most, `together` in a step.

    Returns the factor's tiles (grp, pivots, a, b, low, up), what remains of the fronts, and of each diagonal tile (grp, s, d, fixed), d that of
    LDL and fixed the pivots replaced.
    """
    dtype = complex if is_complex else float
    hermitian, general, diagonal = kind in ("LLH", "LDLH"), kind == "LU", kind in ("LDLT", "LDLH")
    steps = -(-most // together)

    def read(data: bytes | None, m: int, n: int) -> np.ndarray:
        return np.zeros((m, n), dtype=dtype) if data is None else np.frombuffer(data, dtype=dtype).reshape(m, n)

    def edges(pdf: pd.DataFrame, at: str, size: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the tiles in one direction, and where each begins."""
        names, first = np.unique(pdf[at].to_numpy(), return_index=True)
        return names.astype(np.int64), np.append(0, np.cumsum(pdf[size].to_numpy()[first].astype(np.int64)))

    def whole(pdf: pd.DataFrame) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """The block of some tiles, None if all of them are zero, and where its rows of tiles begin."""
        rows, top = edges(pdf, "a", "m")
        columns, left = edges(pdf, "b", "n")
        if pdf["data"].isna().all():
            return None, rows, top
        out = np.zeros((top[-1], left[-1]), dtype=dtype)
        for r in pdf.itertuples(index=False):
            x, y = np.searchsorted(rows, r.a), np.searchsorted(columns, r.b)
            out[top[x] : top[x + 1], left[y] : left[y + 1]] = read(r.data, r.m, r.n)
        return out, rows, top

    def first(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        block, names, at = whole(pdf)
        low, up, _, fixed = factor_front(np.zeros((at[-1], at[-1]), dtype=dtype) if block is None else block, int(at[-1]), kind, criterion)
        return pd.DataFrame({"grp": [r["grp"]], "pivots": [r["pivots"]], "tiles": [r["tiles"]], "s": [names[0]], "m": [at[-1]], "ends": [at[1:]], "low": [_pack(low)], "up": [_pack(up.T) if general else None], "d": [_pack(up) if diagonal else None], "fixed": [fixed]})

    def corners_of(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Tiles of a factorized corner, by itself a row of the factor for each; d and fixed go with those of the diagonal."""
        r = pdf.iloc[0]
        n, at = int(r["m"]), np.append(0, np.asarray(r["ends"]))
        low, up, d = read(r["low"], n, n), (read(r["up"], n, n) if general else None), (read(r["d"], n, 1) if diagonal else None)
        out = []
        for x in range(len(at) - 1):
            rows = slice(at[x], at[x + 1])
            for y in range(x + 1):
                columns = slice(at[y], at[y + 1])
                same = x == y
                out.append((r["grp"], r["pivots"], r["s"] + x, r["s"] + y, _pack(low[rows, columns]), _pack(up[rows, columns]) if general else None, _pack(d[rows]) if diagonal and same else None, r["fixed"] if x == y == 0 else 0))
        return pd.DataFrame(out, columns=["grp", "pivots", "a", "b", "low", "up", "d", "fixed"])

    def solved(_: tuple, pdf: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        """Rows of tiles below the corner, and of LU the columns to its right, as one matrix each."""
        if pdf.empty or sent.empty:
            return pd.DataFrame({c: [] for c in ("grp", "pivots", "s", "at", "width", "low", "by", "names", "ends", "lefts")})
        r = sent.iloc[0]
        n = int(r["m"])
        corner = read(r["low"], n, n)
        d = read(r["d"], n, 1) if diagonal else np.ones((n, 1), dtype=dtype)
        block, names, at = whole(pdf[pdf["below"]])
        if general:
            right = whole(pdf[~pdf["below"]])[0]
            below = None if block is None else np.linalg.solve(read(r["up"], n, n), block.T).T
            by = None if right is None else np.linalg.solve(corner, right)
        elif block is None:
            below = by = None
        else:
            below = np.linalg.solve((d * (corner.conj() if hermitian else corner).T).T, block.T).T
            by = d * (below.conj() if hermitian else below).T
        return pd.DataFrame({"grp": [r["grp"]], "pivots": [r["pivots"]], "s": [r["s"]], "at": [r["at"]], "width": [n], "low": [_pack(below)], "by": [_pack(by)], "names": [names], "ends": [at[1:]], "lefts": [np.asarray(r["ends"])]})

    def updated(_: tuple, pdf: pd.DataFrame, panels: pd.DataFrame) -> pd.DataFrame:
        low, by = (panels[panels["side"] == x] for x in (0, 1))
        if pdf.empty or low.empty or by.empty or low["data"].iloc[0] is None or by["data"].iloc[0] is None:
            return pdf[_NAMES]
        w = int(low["width"].iloc[0])
        row, column = ({name: (begin, end) for name, begin, end in zip(x["names"], np.append(0, x["ends"][:-1]), x["ends"], strict=True)} for x in (low.iloc[0], by.iloc[0]))
        left, right = read(low["data"].iloc[0], int(low["ends"].iloc[0][-1]), w), read(by["data"].iloc[0], w, int(by["ends"].iloc[0][-1]))
        data = []
        for r in pdf.itertuples(index=False):
            (x, xx), (y, yy) = row[r.a], column[r.b]
            data.append(_pack(read(r.data, r.m, r.n) - left[x:xx] @ right[:, y:yy]))
        pdf["data"] = data
        return pdf[_NAMES]

    def panels_of(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """Tiles of a solved panel."""
        r = pdf.iloc[0]
        at, left = np.append(0, np.asarray(r["ends"])), np.append(0, np.asarray(r["lefts"]))
        m, n = int(at[-1]), int(r["width"])
        low, up = None if r["low"] is None else read(r["low"], m, n), None if r["by"] is None or not general else read(r["by"], n, m).T
        out = []
        for x, name in enumerate(r["names"]):
            for y in range(len(left) - 1):
                cell = slice(at[x], at[x + 1]), slice(left[y], left[y + 1])
                out.append((r["grp"], r["pivots"], name, r["s"] + y, None if low is None else _pack(low[cell]), None if up is None else _pack(up[cell])))
        return pd.DataFrame(out, columns=["grp", "pivots", "a", "b", "low", "up"])

    block = lambda c: _block(c, together)
    now, out, rest, corners, panels = cut(front, "front"), [], [], [], []
    ending = {-(-r[0] // together) for r in now.select("pivots").distinct().collect()}
    for s in range(steps):
        here = now.where(F.col("pivots") > s * together).withColumns({"x": block("a"), "y": block("b")})
        corner = cut(here.where((F.col("x") == s) & (F.col("y") == s)).groupBy("grp").applyInPandas(first, "grp long, pivots int, tiles int, s int, m int, ends array<long>, low binary, up binary, d binary, fixed long"), "corner")
        made = cut(corner.groupBy("grp").applyInPandas(corners_of, "grp long, pivots int, a int, b int, low binary, up binary, d binary, fixed long"), "corners")
        corners.append(made.where("a = b").select("grp", F.col("a").alias("s"), "d", "fixed"))
        out.append(made.select("grp", "pivots", "a", "b", "low", "up"))
        beside = here.where((F.col("x") > s) & (F.col("y") == s)).withColumnsRenamed({"x": "at"}).withColumn("below", F.lit(True)).drop("y")
        if general:
            beside = beside.unionByName(here.where((F.col("x") == s) & (F.col("y") > s)).withColumnsRenamed({"y": "at"}).withColumn("below", F.lit(False)).drop("x"))
        # the corner goes along with each block beside it, so that they are tasks of their own
        last = _block("tiles", together, -1)
        sent = corner.where(last > s).select("*", F.explode(F.sequence(F.lit(s + 1), last)).alias("at"))
        panel = cut(beside.groupBy("grp", "at").cogroup(sent.groupBy("grp", "at")).applyInPandas(solved, "grp long, pivots int, s int, at int, width int, low binary, by binary, names array<long>, ends array<long>, lefts array<long>"), "panel")
        out.append(panel.groupBy("grp", "at").applyInPandas(panels_of, "grp long, pivots int, a int, b int, low binary, up binary"))
        later = here.where((F.col("x") > s) & (F.col("y") > s))
        pairs = later.select(F.col("grp").alias("to_grp"), F.col("x").alias("to_x"), F.col("y").alias("to_y")).distinct()
        sides = [pairs.join(panel.select(F.col("grp").alias("to_grp"), F.col("at").alias(to), "width", "names", "ends", F.lit(n).alias("side"), F.col(of).alias("data")), ["to_grp", to]) for n, (to, of) in enumerate((("to_x", "low"), ("to_y", "by")))]
        new = cut(later.groupBy("grp", "x", "y").cogroup(sides[0].unionByName(sides[1]).groupBy("to_grp", "to_x", "to_y")).applyInPandas(updated, _FRONT), "front")
        drop(now)
        if s + 1 in ending:
            done = new.where(F.ceil(F.col("pivots") / together) == s + 1)
            rest.append(done if s + 1 == steps else cut(done, "rest"))
        panels.append(panel)
        now = new
    found = cut(union(out), "tiles")
    drop(*panels)
    return found, union(rest), union(corners)


def _block(tile: str, together: int, plus: int = 0) -> Column:
    """Number of the block that holds the tile row or column (plus so many): `together` of the pivots' tiles or of those below them."""
    at, of = F.col(tile) + plus, F.col("pivots")
    return F.when(at < of, F.floor(at / together)).otherwise(F.ceil(of / together) + F.floor((at - of) / together)).cast("int")


def together(tile: int) -> int:
    """Tiles of a row or column that a task takes at once: as many as have TILE rows."""
    return max(1, TILE // tile)


def union(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for other in tables[1:]:
        whole = whole.unionByName(other)
    return whole


def left_over(rest: DataFrame, corners: DataFrame, at: DataFrame, symmetric: bool, is_complex: bool) -> DataFrame:
    """What fronts pass on (part C), diagonals (D) and the number of replaced pivots (P) as the factorization's rows."""
    dtype = complex if is_complex else float
    ids = at.groupBy("grp", "k", "t").agg(F.array_sort(F.collect_list(F.struct("o", "i"))).alias("l")).select("grp", "k", "t", F.col("l.i").alias("ids"))

    def entries(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        rows, columns = np.asarray(r["rows"]), np.asarray(r["columns"])
        v = np.frombuffer(r["data"], dtype=dtype).reshape(len(rows), len(columns))
        x, y = np.nonzero((rows[:, None] >= columns) & (v != 0) if symmetric else v != 0)
        return pd.DataFrame({"part": "C", "k": -1, "i": rows[x], "j": columns[y], "b": 0, "re": v[x, y].real, "im": v[x, y].imag})

    tile = rest.where("data is not null").select("grp", "a", "b", "data").join(ids.select("grp", F.col("t").alias("a"), F.col("ids").alias("rows")), ["grp", "a"])
    tile = tile.join(ids.select("grp", F.col("t").alias("b"), F.col("ids").alias("columns")), ["grp", "b"])
    passed = tile.groupBy("grp", "a", "b").applyInPandas(entries, _PARTS)

    def diagonals(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        rows, v = np.asarray(r["ids"]), np.frombuffer(r["d"], dtype=dtype)
        return pd.DataFrame({"part": "D", "k": r["k"], "i": rows, "j": rows, "b": 0, "re": v.real, "im": v.imag})

    d = corners.where("d is not null").join(ids.withColumnRenamed("t", "s"), ["grp", "s"]).groupBy("grp", "s").applyInPandas(diagonals, _PARTS)
    zero = F.lit(0).cast("long")
    fixed = corners.where("fixed > 0").select(F.lit("P").alias("part"), zero.alias("k"), zero.alias("i"), zero.alias("j"), zero.alias("b"), F.col("fixed").cast("double").alias("re"), F.lit(0.0).alias("im"))
    return passed.unionByName(d).unionByName(fixed)


_VECTOR = "grp long, t int, o int, k int, re double, im double"


def solve(f: Tiled, stage: int, side: str, b: DataFrame, back: bool, is_complex: bool, conjugate: bool = False, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Solves with the tiled fronts of a stage: forward, or with the transpose backward. side: low or up.

    b and known are (i, k, re, im): the fronts' own right-hand side and, backward, the solution of the rows below. Returns the
    solution (i, k, re, im) and, forward, what the rows below receive. A step sums up the products of one row of blocks.
    """
    tiles = f.tiles.where(F.col("stage") == stage).select("grp", "pivots", "a", "b", F.col(side).alias("data"))
    at = f.places.where(F.col("stage") == stage).select("grp", "t", "o", "i")
    pivots = tiles.select("grp", "pivots").distinct()
    dtype = complex if is_complex else float

    def placed(v: DataFrame) -> DataFrame:
        return v.join(at, "i").select("grp", "t", "o", F.col("k").cast("int").alias("k"), "re", "im")

    def dense(pdf: pd.DataFrame, n: int, ks: np.ndarray) -> np.ndarray:
        x = np.zeros((n, len(ks)), dtype=dtype)
        np.add.at(x, (pdf["o"].to_numpy(), np.searchsorted(ks, pdf["k"].to_numpy())), _values(pdf, is_complex))
        return x

    def rows(grp: int, t: int, x: np.ndarray, ks: np.ndarray) -> pd.DataFrame:
        o, k = np.meshgrid(np.arange(len(x)), np.arange(len(ks)), indexing="ij")
        v = x.ravel()
        return pd.DataFrame({"grp": grp, "t": t, "o": o.ravel(), "k": ks[k.ravel()], "re": v.real, "im": v.imag})

    def tile(data: bytes, n: int) -> np.ndarray:
        """A tile of n columns as the sweep applies it."""
        v = np.frombuffer(data, dtype=dtype).reshape(-1, n)
        v = v.T if back else v
        return v.conj() if conjugate else v

    none = lambda: rows(0, 0, np.zeros((0, 0), dtype=dtype), np.zeros(0, dtype=int))

    def product(left: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """A block of tiles times its part of x, negative."""
        if left.empty or x.empty:
            return none()
        ks = np.unique(x["k"].to_numpy())
        to, from_ = ("b", "a") if back else ("a", "b")
        parts, out = {t: own for t, own in x.groupby("t")}, {}
        for r in left.itertuples(index=False):
            v = tile(r.data, r.n)
            if getattr(r, from_) in parts:
                out[getattr(r, to)] = out.get(getattr(r, to), 0) - v @ dense(parts[getattr(r, from_)], v.shape[1], ks)
        return pd.concat([rows(left["grp"].iloc[0], t, v, ks) for t, v in out.items()]) if out else none()

    def solved(left: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """The rows of a corner's tiles, in the sweep's order."""
        if left.empty or x.empty:
            return none()
        ks = np.unique(x["k"].to_numpy())
        sizes = {r.a: r.n for r in left.itertuples(index=False) if r.a == r.b}
        names = sorted(sizes)
        at = dict(zip(names, np.append(0, np.cumsum([sizes[t] for t in names])), strict=False))
        n = sum(sizes.values())
        own, v = np.zeros((n, n), dtype=dtype), np.zeros((n, len(ks)), dtype=dtype)
        for r in left.itertuples(index=False):
            a, b = (r.b, r.a) if back else (r.a, r.b)
            if r.data is not None:
                own[at[a] : at[a] + sizes[a], at[b] : at[b] + sizes[b]] = tile(r.data, r.n)
        for t, part in x.groupby("t"):
            v[at[t] : at[t] + sizes[t]] = dense(part, sizes[t], ks)
        v = np.linalg.solve(own, v)
        return pd.concat([rows(left["grp"].iloc[0], t, v[at[t] : at[t] + sizes[t]], ks) for t in names])

    sizes = at.groupBy("grp", "t").agg(F.count("*").cast("int").alias("n"))
    tiles = tiles.join(sizes.withColumnRenamed("t", "b"), ["grp", "b"]).withColumns({"x": _block("a", f.together), "y": _block("b", f.together)})
    blocks = ["grp", "x", "y"]

    def applied(chosen: DataFrame, x: DataFrame) -> DataFrame:
        """Products of blocks of tiles, each with its part of x, negative."""
        from_ = "a" if back else "b"
        chosen = chosen.where("data is not null")
        sent = chosen.select(*(F.col(c).alias(f"to_{c}") for c in blocks), F.col("grp"), F.col(from_).alias("t")).distinct().join(x, ["grp", "t"])
        return chosen.select(*blocks, "a", "b", "n", "data").groupBy(*blocks).cogroup(sent.drop("grp").groupBy(*(f"to_{c}" for c in blocks))).applyInPandas(product, _VECTOR)

    own = cut(placed(b).join(pivots, "grp").where("t < pivots").withColumn("x", _block("t", f.together)).drop("pivots"))
    beyond = placed(known) if back else None
    done = None if not back else cut(beyond.join(pivots, "grp").where("t >= pivots").drop("pivots"))
    x = None
    steps = range(-(-f.steps[stage] // f.together))
    for s in reversed(steps) if back else steps:
        here = tiles.where(F.col("pivots") > s * f.together)
        right = own.where(F.col("x") == s).drop("x")
        others = here.where((F.col("y") == s) & (F.col("x") > s)) if back else here.where((F.col("x") == s) & (F.col("y") < s))
        if done is not None and (back or s):
            right = right.unionByName(applied(others, done))
        corner = here.where((F.col("x") == s) & (F.col("y") == s)).select("grp", "a", "b", "n", "data")
        new = cut(corner.groupBy("grp").cogroup(right.groupBy("grp")).applyInPandas(solved, _VECTOR))
        done, x = (new if done is None else done.unionByName(new)), (new if x is None else x.unionByName(new))
    solution = x.join(at, ["grp", "t", "o"]).select("i", "k", "re", "im")
    if back:
        return solution, None
    moved = applied(tiles.where("a >= pivots"), x).groupBy("grp", "t", "o", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return solution, moved.join(at, ["grp", "t", "o"]).select("i", "k", "re", "im")
