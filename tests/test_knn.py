"""Nearest vectors of many queries against all pairs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnfell.operators import knn


def sound(v, width=8):
    return v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, queries, k, over=None, apart=False):
    out = []
    for q, a in queries:
        if q is None or not sound(a):
            continue
        scored = []
        for i, b, keep in rows:
            if sound(b) and not (apart and i == q):
                a1, b1 = [x / max(map(abs, a)) for x in a], [x / max(map(abs, b)) for x in b]
                cos = sum(x * y for x, y in zip(a1, b1)) / math.sqrt(sum(x * x for x in a1)) / math.sqrt(sum(x * x for x in b1))
                scored.append((-round(cos, 10), i, keep))
        scored = sorted(scored)[: over or k]
        out += [(q, r, i, -s + 0.0) for r, (s, i, _) in enumerate([x for x in scored if x[2] or over is None][:k], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(12)
    rows = [(i, [float(rng.randrange(-3, 4)) for _ in range(8)], rng.random() < 0.5) for i in range(400)]
    odd = [None, [], [0.0] * 8, [1.0] * 7, [1.0] * 7 + [None], [math.nan] + [1.0] * 7, [math.inf] + [1.0] * 7, [1e200, *[0.0] * 7], [1e-200, *[0.0] * 7]]
    return rows + [(400 + i, v, True) for i, v in enumerate(odd)] + [(500 + i, rows[i][1], True) for i in range(20)]


@pytest.mark.parametrize("dealt", [False, True])
def test_hits_equal_all_pairs(spark, vectors, monkeypatch, dealt):
    if dealt:
        for name, value in (("BROADCAST_BYTES", 0), ("BLOCK", 64), ("PACK", 16)):
            monkeypatch.setattr(knn, name, value)
    monkeypatch.setattr(knn, "HELD", 1000)
    rows = spark.createDataFrame(vectors, "id long, v array<double>, cheap boolean").repartition(5)
    asked = [(i, v) for i, v, _ in vectors if i % 7 == 0 or 400 <= i < 410] + [(None, vectors[0][1])]
    queries = spark.createDataFrame(asked, "q long, w array<double>").repartition(2)
    near = lambda x: [(a, b, c, round(d, 8)) for a, b, c, d in x]
    run = lambda *a, **b: near(sorted(map(tuple, knn.nearest(rows, "id", "v", queries, "q", "w", *a, **b).collect())))
    assert run(5) == near(plain(vectors, asked, 5))
    assert run(5, apart=True) == near(plain(vectors, asked, 5, apart=True))
    assert run(3, F.col("cheap"), over=4) == near(plain(vectors, asked, 3, over=12))
    assert run(1000) == near(plain(vectors, asked, 1000))


def test_no_queries_and_no_candidates(spark, vectors):
    rows = spark.createDataFrame(vectors, "id long, v array<double>, cheap boolean")
    assert knn.nearest(rows, "id", "v", rows.limit(0), "id", "v", 3).count() == 0
    assert knn.nearest(rows.limit(0), "id", "v", rows, "id", "v", 3).count() == 0
    assert knn.nearest(rows, "id", "v", rows.filter("v IS NULL"), "id", "v", 3).count() == 0


def test_the_plan_has_no_cross_join(spark, vectors):
    rows = spark.createDataFrame(vectors, "id long, v array<double>, cheap boolean")
    plan = knn.nearest(rows, "id", "v", rows.filter("id < 9"), "id", "v", 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and plan.count("Exchange") == 1


def test_what_is_returned_at_once_is_bounded(vectors, monkeypatch):
    rng = np.random.default_rng(3)
    rows = pa.table({"id": pa.array(range(50)), "keep": pa.array([True] * 50), "vector": pa.array(list(rng.normal(size=(50, 8))))})
    asked, ids = rng.normal(size=(30, 8)), pa.array(range(30))
    whole = pa.Table.from_batches(knn._search(rows, asked, ids, 8, 4))
    monkeypatch.setattr(knn, "ASKED", 7)
    some = list(knn._search(rows, asked, ids, 8, 4))
    assert pa.Table.from_batches(some).to_pylist() == whole.to_pylist() and whole.num_rows == 120
    assert max(b.num_rows for b in some) <= 28
