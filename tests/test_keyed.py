"""Keyed tables and graphs brought up to date: files outside a change stay, and results are those of a full rebuild."""

import glob
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from tarnfell.operators import graph, reindex
from tarnfell.sources import keyed, sinks


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/__bucket=*/*.parquet")}


def test_a_change_writes_its_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    t = keyed.Keyed(spark, path, ["k"], "k long, v string", 8)
    held = {}

    def change(new=(), gone=()):
        t.change(spark.createDataFrame(list(new), "k long, v string"), spark.createDataFrame([(k,) for k in gone], "k long"))
        for k in gone:
            held.pop(k, None)
        held.update({k: v for k, v in new if k is not None})
        assert {r.k: r.v for r in t.read().collect()} == held and t.read().count() == len(held)

    change([(k, f"v{k}") for k in range(60)] + [(None, "no key")])
    was = files(path)
    change([(3, "other")])
    now = files(path)
    folder = lambda fs: {os.path.dirname(f) for f in fs}
    assert len(folder(set(was) ^ set(now))) == 1 and {f: now[f] for f in set(was) & set(now)} == {f: was[f] for f in set(was) & set(now)}
    change([(3, "again"), (100, "new")], [4, 3, 999])
    change(gone=range(60))  # buckets without rows are empty
    change([(5, "back")])
    assert t.change(spark.createDataFrame([], "k long, v string")) == []
    assert t.upsert(spark.createDataFrame([(5, "a"), (5, "b")], "k long, v string"), F.col("v")) and t.read().filter("k = 5").first().v == "b"
    assert keyed.Keyed(spark, path, ["k"], "k long, v string", 8).read().count() == t.read().count()


def test_a_range_lies_in_few_files(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id", "IF(id % 3 = 0, 50.0D, CAST(id * 7919 % 4000 AS DOUBLE)) AS price").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # files as they are at size
    try:
        sinks.replace(rows, f"{tmp_path}/p", "price")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    of_file = sinks.read(spark, f"{tmp_path}/p").groupBy(F.input_file_name().alias("f")).agg(F.min("price").alias("a"), F.max("price").alias("b"), F.count("*").alias("n"))
    told = sorted((r.a, r.b, r.n) for r in of_file.collect())
    assert len(told) > 1 and all(x[1] <= y[0] for x, y in itertools.pairwise(told))
    assert sum(b >= 1000 and a <= 1100 for a, b, _ in told) < len(told)
    assert max(n for *_, n in told) < 3000  # a third of the rows have one price


@pytest.mark.parametrize("seed", [1, 2])
def test_changed_pairs_are_those_of_a_rebuild(spark, seed):
    rng = random.Random(seed)
    own = lambda: {f"e{int(rng.paretovariate(0.8)) % 12}" for _ in range(rng.randrange(8))}
    before = {i: own() for i in range(40)}
    after = {i: own() if i % 9 == 0 else es for i, es in before.items() if i % 13} | {100: own(), 101: {"e1", "e2", "e3"}}
    changed = [i for i in before.keys() | after.keys() if before.get(i) != after.get(i)]
    frame = lambda items: spark.createDataFrame([(i, e) for i, es in items.items() for e in es], "i int, e string")
    was, now = frame(before), frame(after)
    pairs = graph.similar_pairs(was, "i", "e", 2, bucket_max=14)
    gone, come = reindex.pair_changes(was, now, spark.createDataFrame([(i,) for i in changed], "i int"), pairs, 2, 14)
    plain = lambda df: {tuple(r) for r in df.collect()}
    want = plain(graph.similar_pairs(now, "i", "e", 2, bucket_max=14))
    got = plain(pairs) - plain(gone) | plain(come)
    assert got == want and want != plain(pairs)
    assert plain(reindex.pair_changes(was, was, spark.createDataFrame([], "i int"), pairs, 2, 14)[0]) == set()


def test_a_large_bucket_is_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "FILE_ROWS", 50)
    t = keyed.Keyed(spark, str(tmp_path / "t"), ["id"], "id long, said string", 2)
    t.upsert(spark.range(1000).selectExpr("id", "'a' AS said"))
    t.change(spark.createDataFrame([(7, "b")], "id long, said string"), spark.createDataFrame([(8,)], "id long"))
    got = {r.id: r.said for r in t.read().collect()}
    assert got == {i: "b" if i == 7 else "a" for i in range(1000) if i != 8}
    files = [len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").glob("__bucket=*")]
    assert len(files) == 2 and min(files) > 4
