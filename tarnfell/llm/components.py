"""Connected components by contraction, without bringing links or components to the driver.

Each round every node points to the neighbour (or itself) that comes first in a fixed random order, and edges are
drawn anew between what their ends point to.  A star vanishes in two rounds and a path in a logarithmic number, since
the order is random.  Rounds are written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfell.llm.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node in ``edges`` (src, dst: long); component is some node of the same component.

    Null ends and loops are ignored; no edges give no rows.
    """
    edges = edges.filter("src <> dst").select("src", "dst")
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        first = both.groupBy("src").agg(F.min(F.struct(F.xxhash64("dst").alias("h"), F.col("dst").alias("n"))).alias("f"))
        own = F.struct(F.xxhash64("src").alias("h"), F.col("src").alias("n"))
        to = materialize(first.select(F.col("src").alias("node"), F.least("f", own)["n"].alias("component")), "components-to")
        if known is None:
            known = to
        else:
            known = materialize(
                known.join(
                    to.select(F.col("node").alias("component"), F.col("component").alias("next")),
                    "component",
                    "left",
                ).select("node", F.coalesce("next", "component").alias("component")),
                "components-known",
            )
        a, b = to.toDF("src", "a"), to.toDF("dst", "b")
        drawn = edges.join(a, "src").join(b, "dst").filter("a <> b")
        edges = materialize(drawn.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "components-edges")
        if edges.isEmpty():
            return known
