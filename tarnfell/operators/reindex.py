"""Bringing a stored graph up to date with changed items, without building it anew.

What depends on a change is found from it: the edges of the changed items, the nodes at their other ends, and of the
similar pairs those of the changed items and of the items of entities that now have too many or few enough items to count.
All else stays as it is.  The result is that of a full rebuild.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfell.operators import graph
from tarnfell.operators.lineage import cut


class Change(NamedTuple):
    """Rows that go and rows that come: edges (item by item), nodes that are replaced, and similar pairs."""

    items: DataFrame
    edges: DataFrame
    touched: DataFrame
    nodes: DataFrame
    pairs_gone: DataFrame
    pairs: DataFrame


def pair_changes(before: DataFrame, after: DataFrame, changed: DataFrame, pairs: DataFrame, least: int = 3, bucket_max: int = 200) -> tuple[DataFrame, DataFrame]:
    """(pairs that go, pairs that come) from links (i, e) before and after, the changed items (i) and the stored ``pairs``
    (a, b, overlap)."""
    was, now = before.select("i", "e").distinct(), after.select("i", "e").distinct()
    own = was.join(changed, "i", "left_semi").select("e").unionByName(now.join(changed, "i", "left_semi").select("e")).distinct()
    size = lambda links, name: links.join(own, "e", "left_semi").groupBy("e").agg(F.count(F.lit(1)).alias(name))
    counts = lambda n: F.coalesce(n, F.lit(0)).between(2, bucket_max)
    both = size(was, "x").join(size(now, "y"), "e", "full_outer")
    flipped = both.filter(counts(F.col("x")) != counts(F.col("y"))).select("e")
    met = was.unionByName(now).join(flipped, "e", "left_semi").select("i")
    affected = cut(met.unionByName(changed.select("i")).distinct())
    gone = pairs.join(affected.select(F.col("i").alias("a")), "a", "left_semi").unionByName(
        pairs.join(affected.select(F.col("i").alias("b")), "b", "left_semi")
    ).distinct()
    mine = now.join(affected, "i", "left_semi")
    near = now.join(mine.select("e").distinct(), "e", "left_semi")
    small = near.groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, bucket_max)).select("e")
    links = mine.join(small, "e").alias("x").join(near.alias("y"), (F.col("x.e") == F.col("y.e")) & (F.col("x.i") != F.col("y.i")))
    ordered = links.select(F.least("x.i", "y.i").alias("a"), F.greatest("x.i", "y.i").alias("b"), F.col("x.e").alias("e")).distinct()
    come = ordered.groupBy("a", "b").agg(F.count(F.lit(1)).alias("overlap")).filter(F.col("overlap") >= least)
    return gone, come


def change(
    items: DataFrame,
    entity_edges: DataFrame,
    pairs: DataFrame,
    new_items: DataFrame,
    new_edges: DataFrame,
    gone: DataFrame,
    kinds: tuple[str, ...] = ("Tier", "Brand"),
    least: int = 3,
    bucket_max: int = 200,
) -> Change:
    """What a stored graph (items, :func:`graph.item_edges`, similar pairs) has to lose and to gain.

    ``new_items`` and ``new_edges`` are those of items that are new or other than before, ``gone`` (id) those that are no
    more.  ``items`` holds the items as they are stored, in the columns of :func:`graph.nodes_of`.
    """
    changed = cut(new_items.select("id").unionByName(gone.select("id")).distinct())
    ids = changed.select(F.col("id").alias("item_id"))
    lost = entity_edges.join(ids, "item_id", "left_semi")
    come = cut(new_edges)
    after = entity_edges.join(ids, "item_id", "left_anti").unionByName(come)
    # Nodes: the changed items, and whatever their edges lead to or led to.
    touched = cut(lost.select(F.col("dst").alias("id")).unionByName(come.select(F.col("dst").alias("id"))).unionByName(changed).distinct())
    around = after.join(touched.select(F.col("id").alias("dst")), "dst", "left_semi")
    nodes = cut(graph.nodes_of(new_items, around.select(*entity_edges.columns)))  # all is known before anything is written
    links = lambda edges: edges.filter(F.col("type").isin(*kinds)).select(F.col("src").alias("i"), F.col("dst").alias("e"))
    pairs_gone, pairs_come = pair_changes(links(entity_edges), links(after), changed.select(F.col("id").alias("i")), pairs, least, bucket_max)
    return Change(changed, come, touched, nodes, cut(pairs_gone), cut(pairs_come))
