"""Graphs of matrices: patterns, symmetrisation, isolation, neighbourhoods, components, partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins
from .lineage import cut
from .prefix import ordered


def pattern(coo: DataFrame, parts: int | None = None) -> DataFrame:
    """Places of entries. parts: partitions to find equal ones in (see joins.parts_of), here and below; without it as many as shuffles have."""
    return joins.dealt(coo.select("i", "j"), parts, "i", "j").distinct()


def symmetrize(edges: DataFrame, parts: int | None = None) -> DataFrame:
    return joins.dealt(edges.select("i", "j").union(edges.select("j", "i")), parts and 2 * parts, "i", "j").distinct()


def united(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two sets of integers, each a table of one column, which is named i."""
    return a.toDF("i").union(b.toDF("i")).distinct()


def without_diagonal(edges: DataFrame) -> DataFrame:
    return edges.where("i <> j")


def sorted_adjacency(edges: DataFrame) -> DataFrame:
    """Per column its row indices in ascending order."""
    return edges.groupBy("j").agg(F.array_sort(F.collect_list("i")).alias("rows"))


def rebase(edges: DataFrame, by: int) -> DataFrame:
    return edges.withColumns({"i": F.col("i") + by, "j": F.col("j") + by})


def prepare(coo: DataFrame, one_triangle: bool = True, parts: int | None = None) -> DataFrame:
    """The graph that orderings work on: pattern, both triangles, no diagonal."""
    edges = pattern(coo, parts)
    return without_diagonal(symmetrize(edges, parts) if one_triangle else edges)


def summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("nnz"), (F.greatest(F.max("i"), F.max("j")) + 1).alias("n"))


def vertex_weights(offsets: DataFrame) -> DataFrame:
    """Degrees of freedom of each vertex, from rows (i, begin, end)."""
    return offsets.select("i", (F.col("end") - F.col("begin")).alias("weight"))


def new_numbers(vertices: DataFrame, order: str = "i") -> DataFrame:
    """Vertices (i) with `number` 0, 1, ... by ascending i, without sorting in one task."""
    return ordered(vertices, [F.col(order)], "number").withColumn("number", F.col("number") - 1)


def isolate(edges: DataFrame, vertices: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without listed vertices, renumbered, and the permutation that puts these last in list order.

    vertices and listed have a column i.
    """
    kept = new_numbers(vertices.join(listed, "i", "left_anti").select("i"))
    n = kept.count()
    last = new_numbers(listed.select("i").distinct()).select("i", (F.col("number") + n).alias("perm"))
    order = kept.select("i", F.col("number").alias("perm")).unionByName(last)
    inside = edges.join(kept.select("i", F.col("number").alias("p")), "i").join(kept.select(F.col("i").alias("j"), F.col("number").alias("q")), "j")
    return inside.select(F.col("p").alias("i"), F.col("q").alias("j")), order


def isolate_range(edges: DataFrame, ordering: DataFrame, first: int, last: int, distance: int = 0) -> DataFrame:
    """Edges between vertices with perm in [first, last), direct or through at most distance + 1 vertices outside.

    edges holds both directions. Vertices keep perm - first as their number.
    """
    inside = ordering.where((F.col("perm") >= first) & (F.col("perm") < last)).select(F.col("i").alias("v"), (F.col("perm") - first).alias("number"))
    out = edges.select(F.col("i").alias("a"), F.col("j").alias("v"))
    front = out.join(inside.select(F.col("v").alias("a"), F.col("number").alias("i")), "a").select("i", "v")
    found = front.join(inside, "v").select("i", F.col("number").alias("j"))
    outside = front.join(inside, "v", "left_anti").distinct()
    for _ in range(distance + 1):
        outside = cut(outside)
        front = outside.select("i", F.col("v").alias("a")).join(out, "a").select("i", "v").distinct()
        found = found.unionByName(front.join(inside, "v").select("i", F.col("number").alias("j")))
        outside = front.join(inside, "v", "left_anti").distinct()
    return found.where("i <> j").distinct()


def components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Connected components: (i, component), component the smallest vertex in it. A component may hold most vertices: its joins are dealt out."""
    found = joins.components(edges.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return vertices.select("i").join(found.withColumnRenamed("id", "i"), "i", "left").select("i", F.coalesce("component", "i").alias("component"))


def partition(edges: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """Parts 0 .. parts - 1 of each component by repeated halving along breadth-first levels: (i, component, part).

    A component is halved in one task with numpy; it must fit there, as separators of orderings do.
    """
    e = edges.select("i", "j").join(labels, "i")
    own = labels.select("i", F.col("i").alias("j"), "component")
    rows = e.select("i", "j", "component").unionByName(own)

    def halve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(pdf["i"].to_numpy())
        a, b = np.searchsorted(names, pdf["i"].to_numpy()), np.searchsorted(names, pdf["j"].to_numpy())
        part = np.zeros(len(names), dtype=np.int32)
        todo = [(np.arange(len(names)), 0, parts)]
        while todo:
            members, base, k = todo.pop()
            if k == 1 or len(members) < 2:
                part[members] = base
                continue
            order = _sweep(a, b, members, len(names))
            left = len(order) * (k // 2) // k
            todo += [(order[:left], base, k // 2), (order[left:], base + k // 2, k - k // 2)]
        return pd.DataFrame({"i": names, "component": pdf["component"].iloc[0], "part": part})

    return rows.groupBy("component").applyInPandas(halve, "i long, component long, part int")


def neighbours(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Compressed lists: neighbours of v are targets[starts[v]:starts[v + 1]]."""
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)), b[order]


def _sweep(a: np.ndarray, b: np.ndarray, members: np.ndarray, n: int) -> np.ndarray:
    """Members in breadth-first order from a vertex far from the first one."""
    inside = np.zeros(n, dtype=bool)
    inside[members] = True
    keep = inside[a] & inside[b] & (a != b)
    starts, targets = neighbours(a[keep], b[keep], n)

    def walk(root: int) -> np.ndarray:
        seen = np.zeros(n, dtype=bool)
        out, front = [], np.array([root])
        rest = members
        while True:
            seen[front] = True
            out.append(front)
            nearby = np.concatenate([targets[starts[v] : starts[v + 1]] for v in front]) if len(front) else front
            front = np.unique(nearby[~seen[nearby]])
            if not len(front):
                rest = rest[~seen[rest]]
                if not len(rest):
                    return np.concatenate(out)
                front = rest[:1]

    return walk(int(walk(int(members[0]))[-1]))


def projections(levels: DataFrame, edges: DataFrame, separator: DataFrame, depth: int, distance: int) -> DataFrame:
    """Per separator vertex the depth of the nearest subtree level that it touches: (i, mark).

    levels (i, level): level of each vertex's supernode below the separator's, which is 0; vertices are
    explored through deeper levels only, in distance + 1 rounds. mark is the largest -level met, else
    -depth - 1.
    """
    near = separator.select(F.col("i").alias("s"), F.col("i").alias("v"))
    met = separator.select(F.col("i").alias("s"), F.lit(-depth - 1).alias("mark"))
    deeper = levels.where((F.col("level") > 0) & (F.col("level") <= depth))
    for _ in range(distance + 1):
        near = cut(near.join(edges.select(F.col("i").alias("v"), "j"), "v").select("s", F.col("j").alias("v")).distinct().join(deeper.select(F.col("i").alias("v"), "level"), "v"))
        met = met.unionByName(near.select("s", (-F.col("level")).cast("int").alias("mark")))
        near = near.select("s", "v")
    return met.groupBy(F.col("s").alias("i")).agg(F.max("mark").alias("mark"))
