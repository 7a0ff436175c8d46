"""The folder that the cluster shares: cutting lineage, places for streams' progress."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only local sessions without that setting get a folder of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnfell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows that make many more, such as items of a graph, that a task gets.
ROWS = 8192


def spread(df: DataFrame, *by: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt by the columns ``by`` over tasks of some ``rows`` rows, however few files or row groups it lies in."""
    return df.repartition(max(1, -(-df.count() // (rows or ROWS))), *by)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def merged(df: DataFrame) -> DataFrame:
    """:func:`cut`, and never broadcast: what Spark expects of a checkpoint's size is that of the files it came from, which
    doesn't count the rows that were made of theirs."""
    return cut(df).hint("merge")
