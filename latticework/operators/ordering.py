"""Orderings, elimination trees and supernodes.

What is sequential by nature (dissection, the tree walk) runs with numpy in one group per connected
component; everything on its results is a DataFrame plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from .graph import neighbours, new_numbers
from .lineage import cut
from .prefix import ordered


def identity(vertices: DataFrame) -> DataFrame:
    return vertices.select("i", F.col("i").alias("perm"))


def personal(vertices: DataFrame, given: DataFrame, inverse: bool = False) -> DataFrame:
    """A permutation given as (i, perm), or as its inverse."""
    given = given.select(F.col("perm").alias("i"), F.col("i").alias("perm")) if inverse else given.select("i", "perm")
    return vertices.select("i").join(given, "i")


def grid(spark: SparkSession, nx: int, ny: int = 1, nz: int = 1, leaf: int = 15, share: int | None = None) -> DataFrame:
    """Geometric nested dissection of a regular grid. A vertex's place follows from its coordinates alone, so tasks need nothing else.

    With share also the part or separator of each vertex, as of multilevel.dissection: (i, region, perm); boxes of at most `share` vertices are parts.
    """

    def places(batches):
        for pdf in batches:
            i = pdf["i"].to_numpy()
            out = {"i": i} if share is None else {"i": i, "region": kernels.grid_regions(i, nx, ny, nz, max(leaf, share + 1))}
            yield pd.DataFrame(out | {"perm": kernels.grid_places(i, nx, ny, nz, leaf)})

    names = "i long, perm long" if share is None else "i long, region string, perm long"
    return spark.range(nx * ny * nz).select(F.col("id").alias("i")).mapInPandas(places, names)


def random_order(vertices: DataFrame, seed: int) -> DataFrame:
    keyed = vertices.select("i").withColumn("key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "i"), 2))
    return new_numbers(keyed, "key").select("i", F.col("number").alias("perm"))


def _of_component(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = np.unique(rows["i"].to_numpy())
    a, b = np.searchsorted(names, rows["i"].to_numpy()), np.searchsorted(names, rows["j"].to_numpy())
    keep = a != b
    return names, *neighbours(a[keep], b[keep], len(names))


def nested_dissection(edges: DataFrame, labels: DataFrame, leaf: int = 24) -> DataFrame:
    """Fill-reducing ordering; edges in both directions, labels (i, component). Components follow each other."""
    own = labels.select("i", F.col("i").alias("j"), "component")
    rows = edges.select("i", "j").join(labels, "i").select("i", "j", "component").unionByName(own)

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        names, starts, targets = _of_component(pdf)
        return pd.DataFrame({"i": names, "component": pdf["component"].iloc[0], "perm": kernels.dissect(starts, targets, leaf)})

    local = cut(rows.groupBy("component").applyInPandas(order, "i long, component long, perm long"))
    sizes = local.groupBy("component").agg(F.count("*").alias("n"))
    before = ordered(sizes, [F.col("component")], "at", upto="n").select("component", (F.col("upto") - F.col("n")).alias("before"))
    return local.join(before, "component").select("i", (F.col("perm") + F.col("before")).alias("perm"))


def check(ordering: DataFrame) -> DataFrame:
    """One row: is (i, perm) a bijection of 0 .. n - 1?"""
    n = F.count("*")
    return ordering.agg(n.alias("n"), ((F.count_distinct("perm") == n) & (F.min("perm") == 0) & (F.max("perm") == n - 1)).alias("valid"))


def elimination(edges: DataFrame, labels: DataFrame, post: bool = False) -> DataFrame:
    """Elimination tree and factor structure of a permuted graph: (i, parent, rows).

    Roots are their own parents; rows lists the factor's rows below the diagonal of column i. Tree
    and structure come in one pass over each connected component (labels: i, component). With post also
    (component, post): the column's place in a postorder of its component.
    """
    own = labels.select("i", F.col("i").alias("j"), "component")
    rows = edges.select("i", "j").join(labels, "i").select("i", "j", "component").unionByName(own)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        names, starts, targets = _of_component(pdf)
        parent = kernels.elimination_tree(starts, targets)
        below = kernels.structures(starts, targets, parent)
        out = {"i": names, "parent": names[parent], "rows": [names[b] for b in below]}
        if post:
            out |= {"component": pdf["component"].iloc[0], "post": kernels.postorder(parent)}
        return pd.DataFrame(out)

    return rows.groupBy("component").applyInPandas(walk, "i long, parent long, rows array<long>" + ", component long, post long" * post)


def levels(tree: DataFrame) -> DataFrame:
    """Depth of each vertex of (i, parent): roots 0. Paths are walked by doubling, in log(depth) joins."""
    now = cut(tree.select("i", F.col("parent").alias("up"), F.when(F.col("i") == F.col("parent"), 0).otherwise(1).cast("long").alias("level")))
    while True:
        above = now.select(F.col("i").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        new = cut(now.join(above, "up").select("i", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"), (F.col("next") != F.col("up")).alias("moved")))
        if not new.where("moved").limit(1).count():
            return new.select("i", "level")
        now = new.select("i", "up", "level")


def subtree_sizes(tree: DataFrame, weight: str | None = None) -> DataFrame:
    """Sum of `weight` (1 if none) over each vertex's subtree: (i, size), from the deepest level up.

    Each round of doubling sends a vertex's sum to its ancestors at distance 1, 2, 4, ..., so
    log(depth) rounds do.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1).cast("long")
    now = cut(tree.select("i", F.when(F.col("i") != F.col("parent"), F.col("parent")).alias("up"), w.alias("size")))
    while now.where("up is not null").limit(1).count():
        sums = now.where("up is not null").groupBy(F.col("up").alias("i")).agg(F.sum("size").alias("more"))
        above = now.select(F.col("i").alias("up"), F.col("up").alias("next"))
        step = now.join(sums, "i", "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more")
        now = cut(step.join(above, "up", "left").select("i", F.col("next").alias("up"), "size"))
    return now.select("i", "size")


def postorder(tree: DataFrame) -> DataFrame:
    """(i, perm): children before parents, subtrees contiguous, siblings in order of i.

    A vertex comes after all vertices of earlier siblings' subtrees of all its ancestors: the sum of
    these sizes along the path, by doubling, plus its own subtree's size less one.
    """
    size = subtree_sizes(tree)
    child = tree.join(size, "i").withColumn("key", F.when(F.col("i") == F.col("parent"), F.lit(-1)).otherwise(F.col("parent")))
    order = Window.partitionBy("key").orderBy("i")
    child = child.withColumn("before", F.sum("size").over(order) - F.col("size"))
    now = cut(child.select("i", F.when(F.col("i") != F.col("parent"), F.col("parent")).alias("up"), "before", "size"))
    while now.where("up is not null").limit(1).count():
        above = now.select(F.col("i").alias("up"), F.col("up").alias("next"), F.col("before").alias("more"))
        now = cut(now.join(above, "up", "left").select("i", F.col("next").alias("up"), (F.col("before") + F.coalesce("more", F.lit(0))).alias("before"), "size"))
    return now.select("i", (F.col("before") + F.col("size") - 1).alias("perm"))


def supernodes(columns: DataFrame) -> DataFrame:
    """Fundamental supernodes (k, first, last) of a postordered factor (i, parent, rows).

    Column j continues the supernode of j - 1 if it is the parent of j - 1, has no other child and
    j - 1 has exactly one row more.
    """
    c = columns.select("i", "parent", F.size("rows").alias("height"))
    kids = c.where("parent <> i").groupBy(F.col("parent").alias("i")).agg(F.count("*").alias("kids"))
    prior = c.select((F.col("i") + 1).alias("i"), F.col("parent").alias("above"), F.col("height").alias("before"))
    c = c.join(kids, "i", "left").join(prior, "i", "left")
    joins = F.coalesce((F.col("above") == F.col("i")) & (F.col("kids") == 1) & (F.col("height") == F.col("before") - 1), F.lit(False))
    begin = new_numbers(c.where(~joins).select("i"))
    last = begin.select((F.col("number") - 1).alias("number"), (F.col("i") - 1).alias("last"))
    n = columns.count()
    return begin.join(last, "number", "left").select(F.col("number").alias("k"), F.col("i").alias("first"), F.coalesce("last", F.lit(n - 1)).alias("last"))


def supernode_tree(nodes: DataFrame, columns: DataFrame) -> DataFrame:
    """(k, first, last, parent, rows): father of each supernode and the rows below it."""
    of = nodes.select("k", F.explode(F.sequence("first", "last")).alias("j"))
    tail = nodes.join(columns.select(F.col("i").alias("last"), F.col("parent").alias("up"), "rows"), "last")
    up = of.select(F.col("k").alias("parent"), F.col("j").alias("up"))
    return tail.join(up, "up").select("k", "first", "last", "parent", "rows")


def amalgamated(tree: DataFrame, ratio: float = 0.05) -> DataFrame:
    """Supernodes after merging sons into fathers: (k, first, last), renumbered. One task holds the table of supernodes."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k").reset_index(drop=True)
        at = {k: n for n, k in enumerate(pdf["k"])}
        into = kernels.amalgamate(pdf["first"].tolist(), (pdf["last"] - pdf["first"] + 1).tolist(), list(pdf["rows"]), [at[p] for p in pdf["parent"]], ratio)
        out = pd.DataFrame({"into": into, "first": pdf["first"], "last": pdf["last"]}).groupby("into").agg(first=("first", "min"), last=("last", "max")).sort_values("first")
        return pd.DataFrame({"k": np.arange(len(out)), "first": out["first"].to_numpy(), "last": out["last"].to_numpy()})

    return tree.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(merge, "k long, first long, last long")


def level_order(tree: DataFrame) -> DataFrame:
    """Supernodes (k, parent) renumbered so that deeper levels come first: (k, level, number)."""
    lv = levels(tree.select(F.col("k").alias("i"), "parent")).withColumnRenamed("i", "k")
    return ordered(lv, [F.col("level").desc(), F.col("k")], "number").select("k", "level", (F.col("number") - 1).alias("number"))


def clusters(nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """Separators wider than `size` cut into parts of about that many columns: (k, i, part)."""
    wide = nodes.where(F.col("last") - F.col("first") + 1 > size)
    columns = wide.select("k", F.explode(F.sequence("first", "last")).alias("i"))
    inner = edges.join(columns, "i").join(columns.select(F.col("k").alias("k2"), F.col("i").alias("j")), "j").where("k = k2").select("k", "i", "j")
    rows = inner.unionByName(columns.select("k", "i", F.col("i").alias("j")))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        from .graph import _sweep

        names = np.unique(pdf["i"].to_numpy())
        a, b = np.searchsorted(names, pdf["i"].to_numpy()), np.searchsorted(names, pdf["j"].to_numpy())
        walk = _sweep(a, b, np.arange(len(names)), len(names))
        count = -(-len(names) // size)
        part = np.empty(len(names), dtype=np.int32)
        part[walk] = np.arange(len(names)) * count // len(names)
        return pd.DataFrame({"k": pdf["k"].iloc[0], "i": names, "part": part})

    return rows.groupBy("k").applyInPandas(split, "k long, i long, part int")
