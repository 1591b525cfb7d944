"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are ordered: a null comes before every id.
NULL_ID = -(2**63)


def work_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's shared folder, ``spark.checkpoint.dir``.

    In local mode a temporary folder takes the place of an absent setting; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    _MADE.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _MADE[-1]


#: Folders that this process has given out.
_MADE: list[str] = []


@contextmanager
def parts_removed(spark: SparkSession) -> Iterator[None]:
    """Remove the folders of intermediate tables that are given out inside, once their results are written elsewhere."""
    before = len(_MADE)
    yield
    for path in _MADE[before:]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _MADE[before:]


def few_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Batches of at most ``rows`` rows between Spark and Python, where the session leaves the number at Spark's default.

    Rows here are whole texts, and each task holds a batch several times over.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def staged(df: DataFrame, name: str = "part") -> DataFrame:
    """Write a frame to the shared folder and read it again.

    This cuts the lineage and keeps the rows when executors are lost.
    """
    path = f"{work_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside drop their shuffle files at once, as their results are written; the session's setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def settled(df: DataFrame, name: str = "part") -> DataFrame:
    """``staged``, and the shuffle files of the write are gone when it ends."""
    with shuffles_removed(df.sparkSession):
        return staged(df, name)


def removed(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NULL_ID))


#: The white space of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)
