"""Tables by key whose changes touch only what they must: rows lie in buckets of their key, a change rewrites the buckets of
the keys that it names, and all other files stay as they are.

A bucket is a partition folder, written with Spark's dynamic partition overwrite, which puts new files beside the old
before it lets these go.  A key that is deleted leaves a mark in its bucket until the bucket is written again, for a
partition without rows wouldn't be replaced.  Rows without one of their key columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.operators import catalog
from tarnfell.operators.lineage import cut

_BUCKET, _GONE = "__bucket", "__gone"
#: Rows of a bucket that one task writes; a larger bucket is several tasks' and as many files.
FILE_ROWS = 65_536


class Keyed:
    """A table at ``path`` with unique ``keys``, dealt into ``buckets`` folders by the hash of the columns ``by`` (all keys)."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: str, buckets: int = 64, by: Sequence[str] = ()) -> None:
        self.spark, self.path, self.keys, self.schema, self.buckets, self.by = spark, path, list(keys), schema, buckets, list(by or keys)
        spark.createDataFrame([], f"{schema}, {_GONE} boolean, {_BUCKET} int").write.mode("append").partitionBy(_BUCKET).parquet(path)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {_GONE} boolean, {_BUCKET} int").parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().filter(f"NOT {_GONE}").drop(_GONE, _BUCKET)

    def _in_buckets(self, df: DataFrame) -> DataFrame:
        whole = df.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in self.keys))
        return whole.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int"))

    def change(self, new: DataFrame | None = None, gone: DataFrame | None = None, order: Column | None = None) -> list[int]:
        """Put ``new`` in the place of rows of the same key (of several the last by ``order``) and drop the keys of
        ``gone``; the numbers of the buckets that were written."""
        empty = self.spark.createDataFrame([], self.schema)
        names = empty.columns
        new = self._in_buckets((empty if new is None else empty.unionByName(new, allowMissingColumns=True)).select(names))
        new = catalog.first_by(new, self.keys, [order.desc()]) if order is not None else new.dropDuplicates(self.keys)
        new = cut(new)
        dropped = cut(self._in_buckets((empty if gone is None else gone).select(self.keys)).distinct())
        named = new.select(*self.keys, _BUCKET).unionByName(dropped)
        touched = sorted(r[0] for r in named.select(_BUCKET).distinct().collect())  # no more than there are buckets
        if not touched:
            return []
        kept = self._stored().filter(F.col(_BUCKET).isin(touched) & ~F.col(_GONE)).join(named, [*self.keys, _BUCKET], "left_anti")
        marks = dropped.join(new.select(self.keys), self.keys, "left_anti").withColumn(_GONE, F.lit(True))
        rows = kept.unionByName(new.withColumn(_GONE, F.lit(False))).unionByName(marks, allowMissingColumns=True)
        # Files are a bucket's own; what is read has its place in the order of the schema.
        n = self._stored().filter(F.col(_BUCKET).isin(touched)).count() + new.count() + dropped.count()
        files = max(1, -(-n // (len(touched) * FILE_ROWS)))
        part = F.pmod(F.xxhash64(F.lit("file"), *self.keys), F.lit(files))
        dealt = rows.select(*names, _GONE, _BUCKET).repartition(len(touched) * files, F.col(_BUCKET), part)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(self.path)
        return touched

    def upsert(self, new: DataFrame, order: Column | None = None) -> list[int]:
        return self.change(new, order=order)

    def delete(self, keys: DataFrame) -> list[int]:
        return self.change(gone=keys)


def append(df: DataFrame, path: str, required: Sequence[str]) -> None:
    """New files of what has all required texts; files that are there stay, and those that lack a column read as null."""
    good = df
    for c in required:
        good = good.filter(F.coalesce(F.trim(F.col(c)), F.lit("")) != "")
    good.write.mode("append").parquet(path)
