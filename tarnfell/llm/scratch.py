"""Tables written to the folder that the cluster shares, to cut lineage and to survive lost executors.

The folder is ``spark.checkpoint.dir``.  Only where that is unset *and* the master is local (tests) a
temporary folder is made instead; on a cluster a missing setting is an error, because a machine-local
folder would be invisible to the other machines.

What is made within a :func:`scope` lies in a folder of its own, which goes when the scope ends; all other tables stay
until :func:`release`, since frames that are still to run may read them.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_SCOPE: ContextVar[str | None] = ContextVar("tarnfell-scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; sets a temporary one in local mode if there is none."""
    base = spark.conf.get(_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_KEY} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tarnfell-")
        spark.conf.set(_KEY, base)
    return f"{base.rstrip('/')}/tarnfell/{spark.sparkContext.applicationId}"


def folder(spark: SparkSession) -> str:
    """Where tables go now: the innermost scope's folder, else the application's."""
    return _SCOPE.get() or shared_dir(spark)


def materialize(df: DataFrame, tag: str, codec: str = "zstd", within: str | None = None) -> DataFrame:
    """``df`` written once as Parquet and read back with the same schema; in :func:`folder`, or ``within`` another one."""
    spark = df.sparkSession
    path = f"{within or folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, folder: str) -> None:
    """Delete a folder of tables."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """What is materialised inside is deleted at the end; frames built on it must have been written out by then."""
    own = f"{shared_dir(spark)}/scope-{uuid.uuid4().hex}"
    before = _SCOPE.set(own)
    try:
        yield own
    finally:
        _SCOPE.reset(before)
        drop(spark, own)


def release(spark: SparkSession) -> None:
    """Delete every table that this application has materialised; frames built on them become unreadable."""
    drop(spark, shared_dir(spark))
