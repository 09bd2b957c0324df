"""Cutting lineage in loops: tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table that a join may send through the driver within small_broadcasts.
SMALL = 256 << 10

#: Folders of local sessions that name none, as in tests.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = _OWN.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.gettempdir()}/latticework-{uuid.uuid4().hex}")
    return where.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/latticework/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut", **options: str) -> DataFrame:
    """df, written once (with options of the writer) and read again; a lost executor costs no recomputation of earlier rounds."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """df, written once in as many buckets of key as shuffles have partitions: joins on key do not move it again."""
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"latticework_{uuid.uuid4().hex}"
    rows = df.repartition(n, key)
    path = new_path(spark, "buckets")
    rows.write.bucketBy(n, key).sortBy(key).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out._cut_path, out._table = path, name
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut or bucketed made, and the latter's names, once all that was made of them is written itself."""
    for df in tables:
        name = getattr(df, "_table", None)
        if name:
            df.sparkSession.sql(f"drop table if exists {name}")
        path = getattr(df, "_cut_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Tables that are written here are joined by shuffles unless a side has at most SMALL bytes (or what the session allows, if that is less).

    A loop of many joins would else send as many tables of the session's limit each through the driver.
    """
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    if not before.startswith("-") and spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > SMALL:
        spark.conf.set(key, str(SMALL))
    try:
        yield
    finally:
        spark.conf.set(key, before)
