"""Exact top-k: components whose products leave 64 bits."""

import pytest

pytest.importorskip("tarnfell.llm")
from pyspark.sql import functions as F  # noqa: E402

from tarnfell.llm import threshold  # noqa: E402


@pytest.mark.parametrize("large", [1e16, -1e300, 1.7e308])
def test_components_beyond_64_bit_products_are_named(spark, large):
    df = spark.createDataFrame([(0, [1.0, large]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError, match="64 bits"):
        threshold.top_k(df, F.col("vec_id") == 0)


def test_large_components_that_fit_are_exact(spark):
    data = {0: [1e6, -1e6 + 0.5], 1: [1e6, 3.0], 2: [-1e6, 7.25]}
    df = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in threshold.top_k(df, F.col("vec_id") == 0).collect()}
    whole = {i: [int(x * 256 // 1) for x in v] for i, v in data.items()}
    assert got == {i: sum(a * b for a, b in zip(whole[0], whole[i])) for i in (1, 2)}
