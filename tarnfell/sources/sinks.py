"""Writers.  A table is a folder of versions; a new version is written beside the old and readers take the newest whole
one, so that a failed write spoils nothing and the version before is the backup."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.operators import catalog


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    whole = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(whole)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version, if there is one."""
    found = _versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def replace(df: DataFrame, path: str, sort_by: str | None = None) -> int:
    """A new version; with ``sort_by`` a file holds neighbouring values of that column, so readers skip the others."""
    number = (_versions(df.sparkSession, path) or [0])[-1] + 1
    rest = [c for c in df.columns if c != sort_by and df.schema[c].dataType.typeName() != "map"]  # maps have no order
    rows = df.repartitionByRange(sort_by, *rest).sortWithinPartitions(sort_by) if sort_by else df
    rows.write.mode("overwrite").parquet(f"{path}/v={number}")
    return number


def upsert(df: DataFrame, path: str, key: str, order: Column | None = None) -> int:
    """Rows by key: the last of ``df`` (by ``order``) wins over what is there."""
    new = catalog.first_by(df, [key], [order.desc()]) if order is not None else df.dropDuplicates([key])
    old = read(df.sparkSession, path)
    return replace(new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True), path)


def recreate(df: DataFrame, path: str, vector: str) -> int:
    """A new version of a table of vectors, all of which must have the width of the first; its width comes from there.

    A row with a null vector, or with one of another width, fails the write, and the version before stays.
    """
    one = df.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("w")).first()
    width = one["w"] if one else 0
    message = F.concat(F.lit(f"{vector} has not the width {width}: "), F.coalesce(F.size(vector).cast("string"), F.lit("null")))
    sound = F.when(
        F.coalesce(F.size(vector) == width, F.lit(False)),
        F.col(vector),
    ).otherwise(F.raise_error(message).cast(df.schema[vector].dataType))
    return replace(df.withColumn(vector, sound), path)


def save_texts(df: DataFrame, path: str, text: str, embed: Callable[[Column], Column], vector: str = "embedding") -> int:
    """A new version of a table of texts with their vectors, in the order of ``pos``."""
    return recreate(df.withColumn(vector, embed(F.col(text))).sortWithinPartitions("pos"), path, vector)


def append_rows(df: DataFrame, path: str, required: Sequence[str]) -> int:
    """Appends what has all required texts; columns that the table lacks are added."""
    good = df
    for c in required:
        good = good.filter(F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    old = read(df.sparkSession, path)
    return replace(good if old is None else old.unionByName(good, allowMissingColumns=True), path)


def delete(spark: SparkSession, path: str, condition: Column) -> int | None:
    """A version without the rows for which the condition holds (rows where it is null stay)."""
    old = read(spark, path)
    return None if old is None else replace(old.filter(~F.coalesce(condition, F.lit(False))), path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, version: int) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/version={version}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/version={version}/edges")


def report(summary: DataFrame, best: DataFrame | None = None, worst: DataFrame | None = None, width: int = 60) -> str:
    """A fixed-width text of a one-row summary and of short lists; only these come to the driver."""
    row = summary.first()
    lines = ["=" * width, *(f"{k:<{width - 16}}{'-' if v is None else v!s:>16}" for k, v in (row.asDict().items() if row else ()))]
    for title, df in (("best", best), ("worst", worst)):
        if df is not None:
            lines += ["-" * width, title, *("  " + json.dumps(r.asDict(), default=str, ensure_ascii=False) for r in df.limit(5).collect())]
    return "\n".join([*lines, "=" * width])


def json_report(summary: DataFrame) -> str:
    row = summary.first()
    return json.dumps(row.asDict(recursive=True) if row else {}, indent=2, default=str, ensure_ascii=False)
