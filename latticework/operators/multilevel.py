"""Nested dissection of graphs of any size: coarsening and refinement are joins, a task holds `share` vertices at most.

All parts of a pass are cut at once, and a pass goes through several levels of the dissection. A part of more than `share` vertices is coarsened until
it has no more: vertices are matched along heavy edges, each proposing to its heaviest neighbour, and what stays single
joins the pair of its heaviest matched neighbour; where a pair would get too heavy, those that hang on the same neighbour
are paired with each other, as in stars. So a coarse graph has about a third of the vertices. No coarse vertex weighs more than a
twentieth of the pieces to come, unless there would be too many. The coarse graph is halved in a task, the halves again, until a piece fits in a task or a coarse
graph has FEW vertices for a piece. The pieces go back step by step; at each, vertices that have more edge weight to another piece than to their own
move there, from the pieces of one colour to those of the other, then back. Such moves never make the cut heavier, as
edges between vertices that move are counted against them; where a piece would grow over its room, a seeded share of them moves.
Of a halving's finest edge cut the separator is the lightest of three vertex covers: the boundary of either side, or the end of each
edge with more cut edges; a vertex that several halvings take belongs to the first. Parts that fit in a task are dissected there. A part without edges needs no cut.
So passes are as many as the levels over those of a pass, and the rounds of joins of a pass as many as its coarsenings.

The order is that of the tree of parts: a part's halves, then its separator. A part is named by its path, a digit 0 or 1 for
each level; a separator is named by its part's path and the digit 2.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .graph import neighbours
from .lineage import cut
from .prefix import ordered

#: Vertices of a task, weight of a side and of a coarse vertex in parts of the whole, rows of a group that pairs singles.
SHARE, SIDE, HEAVY, BUCKET = 50_000, 0.55, 20, 10_000

#: Coarse vertices for a piece, and the part of a task's vertices that a piece has at most, so that it may grow by refinement.
FEW, FILL = 32, 0.9


def levels(share: int) -> int:
    """Levels of the dissection that a coarse graph of `share` vertices goes through."""
    return max(1, int(np.log2(max(2.0, share / FEW))))


def _other(v: DataFrame, *names: str) -> DataFrame:
    """v keyed by j, its columns with the suffix _j."""
    return v.select(F.col("i").alias("j"), *(F.col(c).alias(f"{c}_j") for c in names))


def _heaviest(e: DataFrame, seed: int) -> DataFrame:
    """(i, j): the neighbour on the heaviest edge; ties by a hash that both ends agree on."""
    tie = F.xxhash64(F.lit(seed), F.least("i", "j"), F.greatest("i", "j"))
    return e.groupBy("i").agg(F.max(F.struct("w", tie.alias("t"), "j"))["j"].alias("j"))


def capped(v: DataFrame, share: int) -> DataFrame:
    """(i, region, w, most): most is what a coarse vertex weighs at most, the same in all coarsenings of a pass."""
    all_w = F.sum("w")
    piece = F.least(all_w, F.greatest(F.lit(share / 2), all_w / 2 ** levels(share)))
    most = v.groupBy("region").agg(F.greatest(piece / HEAVY, 3 * all_w / share).alias("most"))
    return v.join(F.broadcast(most), "region").select("i", "region", "w", "most")  # parts of a level: 2^level rows


def matching(v: DataFrame, e: DataFrame) -> DataFrame:
    """(i, c): the coarse vertex of each vertex, named by a member. v (i, region, w, most), e (i, j, region, w) in both directions."""
    fit = e.join(v.select("i", F.col("w").alias("w_i"), "most"), "i").join(_other(v, "w"), "j").where("w_i + w_j <= most")
    pick = _heaviest(fit.select("i", "j", "w"), 0)
    back = pick.select(F.col("j").alias("i"), F.col("i").alias("j"))
    pairs = cut(pick.join(back, ["i", "j"]).where("i < j"), "pairs")
    ends = pairs.select("i", F.col("i").alias("c")).unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("c")))
    single = v.join(ends, "i", "left_anti")
    # a single vertex hangs on its heaviest neighbour, one that is matched if there is any
    near = e.join(single.select("i"), "i", "left_semi").join(ends.select(F.col("i").alias("j"), F.col("c").alias("to")), "j", "left")
    tie = F.xxhash64(F.lit(1), F.least("i", "j"), F.greatest("i", "j"))
    near = near.groupBy("i").agg(F.max(F.struct(F.col("to").isNotNull().alias("matched"), "w", tie.alias("t"), "j", "to")).alias("on"))
    hung = single.join(near, "i", "left").select("i", "region", "w", "most", F.coalesce("on.j", F.lit(-1)).alias("hub"), F.coalesce("on.to", "i").alias("to"))
    # a pair takes all that hang on it, if it may weigh so much
    held = ends.join(v.select("i", "w"), "i").groupBy(F.col("c").alias("to")).agg(F.sum("w").alias("held"))
    asked = hung.groupBy("to").agg(F.sum("w").alias("asked")).join(held, "to").select("to", (F.col("asked") + F.col("held")).alias("all"))
    hung = cut(hung.join(asked, "to", "left").select("i", "region", "w", "most", "hub", "to", F.coalesce(F.col("all") <= F.col("most"), F.lit(False)).alias("joins")), "hung")
    joined = hung.where("joins").select("i", F.col("to").alias("c"))
    light = hung.where("not joins and 2 * w <= most").select("i", "region", "hub")
    many = light.groupBy("region", "hub").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"))
    # a hub's other singles are numbered in buckets of bounded size, and neighbours in number are paired
    seated = light.join(many, ["region", "hub"]).withColumn("bucket", F.pmod(F.xxhash64("i"), F.col("buckets")))
    groups = seated.groupBy("region", "hub", "bucket").agg(F.array_sort(F.collect_list("i")).alias("all"))
    two = groups.select(F.posexplode("all").alias("at", "i"), "all").select("i", F.element_at("all", (F.col("at") - F.col("at") % 2 + 1).cast("int")).alias("c"))
    heavy = hung.where("not joins and 2 * w > most").select("i", F.col("i").alias("c"))
    return cut(ends.unionByName(joined).unionByName(two).unionByName(heavy), "matching")


def contracted(v: DataFrame, e: DataFrame, match: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The coarse graph: weights of vertices and of parallel edges are added up."""
    coarse_v = v.join(match, "i").groupBy("region", F.col("c").alias("i")).agg(F.sum("w").alias("w"), F.max("most").alias("most")).select("i", "region", "w", "most")
    ends = e.join(match, "i").join(match.select(F.col("i").alias("j"), F.col("c").alias("d")), "j").where("c <> d")
    coarse_e = ends.groupBy("region", F.col("c").alias("i"), F.col("d").alias("j")).agg(F.sum("w").alias("w")).select("i", "j", "region", "w")
    return cut(coarse_v, "vertices"), cut(coarse_e, "edges")


def _grouped(v: DataFrame, e: DataFrame) -> DataFrame:
    """One table for grouped functions: an edge of a vertex to itself carries its weight."""
    return e.select("region", "i", "j", "w").unionByName(v.select("region", "i", F.col("i").alias("j"), "w"))


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """names, weights of vertices, and starts, targets, weights of edges."""
    i, j, w = (pdf[c].to_numpy() for c in ("i", "j", "w"))
    names = np.unique(i)
    a, b = np.searchsorted(names, i), np.searchsorted(names, j)
    own = a == b
    weight = np.zeros(len(names), dtype=np.int64)
    weight[a[own]] = w[own]
    a, b, w = a[~own], b[~own], w[~own]
    order = np.argsort(a, kind="stable")
    starts, targets = neighbours(a, b, len(names))
    return names, weight, starts, targets, w[order]


def halves(v: DataFrame, e: DataFrame, share: int) -> DataFrame:
    """(i, side): each part halved in one task, and the halves again; side is a piece's path within its part."""
    depth = levels(share)

    def halve(pdf: pd.DataFrame) -> pd.DataFrame:
        names, weight, starts, targets, w = _arrays(pdf)
        source = np.repeat(np.arange(len(names)), np.diff(starts))
        side = np.full(len(names), "", dtype=object)
        todo = [("", np.arange(len(names)))]
        while todo:
            path, of = todo.pop()
            if len(of) < 2 or (path and (len(path) >= depth or weight[of].sum() <= FILL * share)):
                side[of] = path
                continue
            at = np.full(len(names), -1)
            at[of] = np.arange(len(of))
            own = (at[source] >= 0) & (at[targets] >= 0)
            half = kernels.bisect(weight[of], *neighbours(at[source[own]], at[targets[own]], len(of)), w[own], SIDE)
            todo += [(path + str(k), of[half == k]) for k in (0, 1) if (half == k).any()]
        return pd.DataFrame({"i": names, "side": side})

    return cut(_grouped(v, e).groupBy("region").applyInPandas(halve, "i long, side string"), "side")


def refined(v: DataFrame, e: DataFrame, side: DataFrame, share: int, seed: int) -> DataFrame:
    """(i, side) with vertices moved to the piece to which they have more edge weight, within the room of each piece."""
    # pieces of one colour: those whose path has an even number of ones, or that are in the first half
    colour = lambda c: F.length(F.regexp_replace(c if seed % 2 else F.substring(c, 1, 1), "0", "")) % 2
    for way in (0, 1):
        with_side = v.join(side, "i")
        ends = e.join(side, "i").where(colour(F.col("side")) == way).join(_other(side, "side"), "j")
        tied = ends.groupBy("i", "side", "side_j").agg(F.sum("w").alias("w"))
        other = F.when(colour(F.col("side_j")) != way, F.struct("w", F.col("side_j").alias("to")))
        best = tied.groupBy("i").agg(F.sum(F.when(F.col("side_j") == F.col("side"), F.col("w")).otherwise(0)).alias("own"), F.max(other).alias("best"))
        wish = best.where("best.w > own").select("i", "best.to").join(v.select("i", "region", "w"), "i")
        held = with_side.groupBy("region", F.col("side").alias("to")).agg(F.sum("w").alias("held"))
        room = F.when(F.col("held") <= share, share - F.col("held")).otherwise((2 * SIDE - 1) * F.col("held"))
        asked = wish.groupBy("region", "to").agg(F.sum("w").alias("asked")).join(held, ["region", "to"]).select("region", "to", (room / F.col("asked")).alias("part"))
        luck = F.pmod(F.xxhash64(F.lit(seed * 2 + way), "i"), F.lit(1 << 20)) / float(1 << 20)
        # a share of less than all is kept well below the room, as the weights that move vary
        moves = wish.join(F.broadcast(asked), ["region", "to"]).where((F.col("part") >= 1) | (luck < F.col("part") * 0.8)).select("i", "to")
        side = cut(side.join(moves, "i", "left").select("i", F.coalesce("to", "side").alias("side")), "side")
    return side


def separated(v: DataFrame, e: DataFrame, side: DataFrame) -> DataFrame:
    """(i, region, side): pieces and separators by their path in the part. A halving's separator is the lightest of three vertex covers of the edges between its halves."""
    ends = e.join(side, "i").join(_other(side, "side"), "j").where("side <> side_j")
    # the first digit in which the paths differ tells the halving that cuts the edge
    digit = F.expr("cast(array_position(zip_with(split(side, ''), split(side_j, ''), (x, y) -> x <> y), true) as int)")
    crossing = ends.withColumn("digit", digit).select("i", "j", "region", F.expr("substring(side, 1, digit - 1)").alias("node"), F.expr("substring(side, digit, 1)").alias("half"))
    crossing = cut(crossing, "crossing")
    degree = crossing.groupBy("i", "node").agg(F.count("*").alias("degree"))
    both = crossing.join(degree, ["i", "node"]).join(degree.select(F.col("i").alias("j"), "node", F.col("degree").alias("degree_j")), ["j", "node"])
    # of each edge the end with more cut edges, on ties that of side 0
    chosen = (F.col("degree") > F.col("degree_j")) | ((F.col("degree") == F.col("degree_j")) & (F.col("half") == "0"))
    ends = cut(both.groupBy("i", "region", "node", "half").agg(F.max(chosen).alias("chosen")), "ends")
    count = lambda c: F.count(F.when(c, 1))
    sizes = ends.groupBy("region", "node").agg(count(F.col("half") == "0").alias("a"), count(F.col("half") == "1").alias("b"), count(F.col("chosen")).alias("c"))
    best = sizes.select("region", "node", F.when((F.col("c") < F.col("a")) & (F.col("c") < F.col("b")), "2").when(F.col("a") <= F.col("b"), "0").otherwise("1").alias("cover"))
    taken = ends.join(F.broadcast(best), ["region", "node"]).where(F.when(F.col("cover") == "2", F.col("chosen")).otherwise(F.col("half") == F.col("cover")))
    taken = taken.groupBy("i").agg(F.concat(F.min("node"), F.lit("2")).alias("sep"))  # a vertex's nodes are prefixes of its path
    out = v.select("i", "region").join(side, "i").join(taken, "i", "left")
    return cut(out.select("i", "region", F.coalesce("sep", "side").alias("side")), "separated")


def pieces(v: DataFrame, e: DataFrame, share: int) -> DataFrame:
    """(i, region, side) of parts: v (i, region), e (i, j, region); side is the path of a piece or separator in its part."""
    v, e = cut(capped(v.select("i", "region", F.lit(1).cast("long").alias("w")), share), "vertices"), cut(e.select("i", "j", "region", F.lit(1).cast("long").alias("w")), "edges")
    stack, largest = [], None
    while True:
        most = v.groupBy("region").count().agg(F.max("count")).first()[0]
        if most <= share or (largest is not None and most > 0.98 * largest):
            break
        largest = most
        match = matching(v, e)
        stack.append((v, e, match))
        v, e = contracted(v, e, match)
    side = refined(v, e, halves(v, e, share), share, 0)
    for n, (v, e, match) in enumerate(reversed(stack), 1):
        side = match.join(side.withColumnRenamed("i", "c"), "c").select("i", "side")
        side = refined(v, e, side, share, n)
    if stack:
        side = refined(v, e, side, share, len(stack) + 1)  # in the other colours
    return separated(v, e, side)


def dissection(edges: DataFrame, vertices: DataFrame, share: int = SHARE, leaf: int = 24) -> DataFrame:
    """Fill-reducing ordering (i, region, perm). edges (i, j) in both directions, vertices (i).

    region names the part or separator of a vertex: paths as above. An edge joins vertices of which one's part holds the other's.
    """
    now = cut(vertices.select("i", F.lit("").alias("region")), "parts")
    links = cut(edges.where("i <> j").select("i", "j").distinct().withColumn("region", F.lit("")), "links")
    done: list[DataFrame] = []  # (i, region, local): finished vertices
    small: list[tuple[DataFrame, DataFrame]] = []
    while True:
        sizes = now.groupBy("region").agg(F.count("*").alias("n"))
        tied = links.select("region").distinct().withColumn("tied", F.lit(True))
        kind = cut(sizes.join(tied, "region", "left").select("region", F.when(F.col("tied").isNull(), 2).when(F.col("n") > share, 1).otherwise(0).alias("kind")), "kind")
        of = lambda df, k, kind=kind: df.join(F.broadcast(kind.where(F.col("kind") == k).select("region")), "region", "left_semi")
        done.append(of(now, 2).select("i", "region", F.lit(0).cast("long").alias("local")))
        small.append((of(now, 0), of(links, 0)))
        if not kind.where("kind = 1").limit(1).count():
            break
        inner = cut(of(links, 1), "inner")
        parts = pieces(of(now, 1), inner, share)
        path = F.concat("region", "side")
        done.append(parts.where(F.col("side").endswith("2")).select("i", path.alias("region"), F.lit(0).cast("long").alias("local")))
        halved = parts.where(~F.col("side").endswith("2"))
        now = cut(halved.select("i", path.alias("region")), "parts")
        kept = inner.join(halved.select("i", "side"), "i").join(_other(halved, "side"), "j").where("side = side_j")
        links = cut(kept.select("i", "j", path.alias("region")), "links")

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        names, _, starts, targets, _ = _arrays(pdf)
        return pd.DataFrame({"i": names, "region": pdf["region"].iloc[0], "local": kernels.dissected_postorder(starts, targets, leaf)})

    for v, e in small:
        one = lambda df: df.withColumn("w", F.lit(1).cast("long"))
        done.append(_grouped(one(v), one(e)).groupBy("region").applyInPandas(local, "i long, region string, local long"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    return ordered(cut(every, "places"), [F.col("region"), F.col("local"), F.col("i")], "at").select("i", "region", (F.col("at") - 1).alias("perm"))


def depth(region: Column) -> Column:
    """Level of a part or separator in the tree of parts: the root's part and separator are at 0."""
    return F.length(F.regexp_replace(region, "2", ""))


def crossing(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges (i, j) that break the dissection: neither end's part holds the other's. None, if it is right."""
    path = lambda c: F.regexp_replace(c, "2", "")
    at = order.select("i", path("region").alias("path"))
    ends = edges.select("i", "j").join(at, "i").join(_other(at, "path"), "j")
    return ends.where(~(F.col("path").startswith(F.col("path_j")) | F.col("path_j").startswith(F.col("path")))).select("i", "j")
