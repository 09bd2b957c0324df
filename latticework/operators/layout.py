"""Permutation, grouping by supernodes and expansion of degrees of freedom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import ordered


def permute(coo: DataFrame, ordering: DataFrame) -> DataFrame:
    """P A P^T: both indices through (i, perm)."""
    p = ordering.select("i", F.col("perm").alias("p"))
    q = ordering.select(F.col("i").alias("j"), F.col("perm").alias("q"))
    rest = [c for c in coo.columns if c not in ("i", "j")]
    return coo.join(p, "i").join(q, "j").select(F.col("p").alias("i"), F.col("q").alias("j"), *rest)


def apply_order(vec: DataFrame, ordering: DataFrame, back: bool = False) -> DataFrame:
    """P b, or P^T b if back."""
    here, there = ("perm", "i") if back else ("i", "perm")
    o = ordering.select(F.col(here).alias("i"), F.col(there).alias("to"))
    return vec.join(o, "i").select(F.col("to").alias("i"), *(c for c in vec.columns if c != "i"))


def inverse(ordering: DataFrame) -> DataFrame:
    return ordering.select(F.col("perm").alias("i"), F.col("i").alias("perm"))


def compose(first: DataFrame, second: DataFrame) -> DataFrame:
    """The ordering that applies first and then second."""
    return first.join(second.select(F.col("i").alias("perm"), F.col("perm").alias("to")), "perm").select("i", F.col("to").alias("perm"))


def column_pointers(coo: DataFrame) -> DataFrame:
    """Per column its number of entries and the entries before it."""
    counts = coo.groupBy("j").agg(F.count("*").alias("entries"))
    return ordered(counts, [F.col("j")], "at", upto="entries").select("j", "entries", (F.col("upto") - F.col("entries")).alias("pointer"))


def columns_of(supernodes: DataFrame) -> DataFrame:
    """Column -> supernode, from (k, first, last), last inclusive."""
    return supernodes.select("k", F.explode(F.sequence("first", "last")).alias("j"))


def grouped(coo: DataFrame, ordering: DataFrame, supernodes: DataFrame) -> DataFrame:
    """Permuted entries with their column's supernode k, dealt out by it."""
    return permute(coo, ordering).join(columns_of(supernodes), "j").repartition("k")


def expand_matrix(coo: DataFrame, dofs: DataFrame) -> DataFrame:
    """Every entry as a block of dof(i) x dof(j) unknowns, from offsets (i, begin, end)."""
    rows = dofs.select("i", F.col("begin").alias("rb"), F.col("end").alias("re_"))
    cols = dofs.select(F.col("i").alias("j"), F.col("begin").alias("cb"), F.col("end").alias("ce"))
    out = coo.join(rows, "i").join(cols, "j")
    out = out.withColumn("a", F.explode(F.sequence(F.col("rb"), F.col("re_") - 1))).withColumn("b", F.explode(F.sequence(F.col("cb"), F.col("ce") - 1)))
    rest = [c for c in coo.columns if c not in ("i", "j")]
    return out.select(F.col("a").alias("i"), F.col("b").alias("j"), *rest)


def places(ordering: DataFrame, dofs: DataFrame) -> DataFrame:
    """(i, perm, begin, size, at) of vertices: how many unknowns each has, the first of them, and the first one's place when unknowns follow the order of the vertices."""
    sized = ordering.join(dofs, "i").select("i", "perm", "begin", (F.col("end") - F.col("begin")).alias("size"))
    return ordered(sized, [F.col("perm")], "place", upto="size").select("i", "perm", "begin", "size", (F.col("upto") - F.col("size")).alias("at"))


def unknowns_of(places: DataFrame) -> DataFrame:
    """The ordering (i, perm) of unknowns from the places of their vertices."""
    out = places.where("size > 0").withColumn("i", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("size") - 1)))
    return out.select("i", (F.col("at") + F.col("i") - F.col("begin")).alias("perm"))


def expand_ordering(ordering: DataFrame, dofs: DataFrame) -> DataFrame:
    """The ordering of unknowns: a vertex's unknowns stay together, in permuted order of the vertices."""
    return unknowns_of(places(ordering, dofs))


def expand_tree(tree: DataFrame, places: DataFrame) -> DataFrame:
    """Supernodes (k, first, last, parent, rows) of vertices as those of their unknowns; every vertex has some."""
    at = places.select(F.col("perm").alias("c"), "at", "size")
    span = F.struct("at", "size")
    below = tree.select("k", F.explode("rows").alias("c")).join(at, "c").groupBy("k").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1)))
    out = tree.select("k", F.col("first").alias("c"), "last", "parent").join(at.select("c", F.col("at").alias("first")), "c").drop("c")
    out = out.withColumnRenamed("last", "c").join(at, "c").select("k", "first", (F.col("at") + F.col("size") - 1).alias("last"), "parent")
    return out.join(below, "k", "left").select("k", "first", "last", "parent", F.coalesce(rows, F.array().cast("array<long>")).alias("rows"))


def offsets(counts: DataFrame) -> DataFrame:
    """(i, begin, end) of vertices with dof unknowns each, from (i, dof): they follow each other in the order of i."""
    return ordered(counts.select("i", "dof"), [F.col("i")], "at", upto="dof").select("i", (F.col("upto") - F.col("dof")).alias("begin"), F.col("upto").alias("end"))


def vertices_of(dofs: DataFrame) -> DataFrame:
    """Unknown i -> vertex."""
    return dofs.where("end > begin").select(F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("unknown"), F.col("i").alias("vertex")).withColumnRenamed("unknown", "i")


def constant_dofs(vertices: DataFrame, dof: int) -> DataFrame:
    return vertices.select("i", (F.col("i") * dof).alias("begin"), ((F.col("i") + 1) * dof).alias("end"))
