"""Joins on keys that may be hot, and connected components by stars, which uses them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lineage import cut, drop

#: A key is hot if it has more rows than PART and than a thousandth of all; it is joined in parts of about that many.
PART = 10_000

#: Rows of a task that groups or joins a whole table.
ROWS = 2_000_000


def parts_of(spark: SparkSession, rows: int) -> int | None:
    """Partitions for so many rows, where shuffles have too few for them; else None."""
    n = -(-rows // ROWS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df in so many partitions by keys, so that a task's share does not grow with the table; as it is if parts is None."""
    return df if parts is None else df.repartition(parts, *keys)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, salt: Column, how: str = "inner", part: int | None = None) -> DataFrame:
    """left joined with right, which has one row for each key and, as `size`, its number of rows in left.

    Rows of hot keys are dealt to parts by salt (a number of the row) and the right row goes to each
    part. There are at most a thousand hot keys for each time that left's rows are counted in size, so their list is small.
    part: instead of PART.
    """
    total, most = right.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    per = max(PART if part is None else part, total // 1000)
    if most <= per:
        return left.join(right, keys, how)
    hot = right.where(F.col(size) > per).select(*keys, F.ceil(F.col(size) / per).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    left = left.join(F.broadcast(hot), keys, "left").withColumn("__part", F.pmod(salt, parts).cast("int")).drop("__parts")
    right = right.join(F.broadcast(hot), keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"], how).drop("__part")


def components(edges: DataFrame, part: int | None = None) -> DataFrame:
    """Connected components of undirected edges (a, b): (id, component), component the smallest id.

    Alternates large-star and small-star until the edges stand still; a round's tables are deleted
    when the next one is written. Only vertices with an edge to another vertex appear. An empty edge
    table gives an empty result. part: as in spread_join.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31))).first())

    def least(pairs: DataFrame) -> DataFrame:
        return cut(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")

    hi, lo = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = cut(edges.where("a <> b").select(hi, lo).distinct(), "edges")
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both)
        large = spread_join(both, low, ["a"], "n", F.col("b"), part=part).select("a", "b", F.least("a", "m").alias("m"))
        large = cut(large.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        small = least(large)
        moved = spread_join(large, small, ["a"], "n", F.col("b"), part=part).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        drop(now, low, large, small)
        now, after = new, mark(new)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
