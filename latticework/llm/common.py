"""Shared helpers: table access; joins with hot keys, components, lineage and global order are those of the rest of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..operators import joins
from ..operators.lineage import cut, drop, new_path, shared_dir
from ..operators.prefix import ordered

__all__ = ["PART", "WORD", "components", "cut", "drop", "new_path", "ordered", "shared_dir", "spread_join", "table"]

#: Characters that separate words: space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a hot key, as joins.PART.
PART = joins.PART


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, salt: Column, how: str = "inner") -> DataFrame:
    """joins.spread_join with the operators' PART."""
    return joins.spread_join(left, right, keys, size, salt, how, PART)


def components(edges: DataFrame) -> DataFrame:
    """joins.components with the operators' PART."""
    return joins.components(edges, PART)
