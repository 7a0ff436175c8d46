"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors become whole numbers, ``floor(SCALE * x)``.  The candidates are dealt into blocks of bounded size; a block
holds, for every dimension, its candidates sorted by that component.  For a query, sorted access walks all lists from
the end that raises the score (downwards for a positive query component, upwards for a negative one), random access
scores every candidate the first time that it turns up, and the walk stops when the bound, the score of a candidate
that would stand at the current depth in all lists, cannot reach the k-th result.  Depths double, and the queries of
a block walk together, so that random access is one product of matrices a round, over the queries that go on and the
candidates that are new.  The k best of every block meet in one ranking.

The queries are a stated set.  They are sent to every block of candidates, which moves once (as often as there are
shares of the queries, while there are fewer blocks than partitions to fill), and walk through it in packs; a task
holds one block and one pack, and neither side is broadcast or held whole.  Blocks and shares are dealt by the number
of the row, so that equal rows don't meet in one.

Defined results: vectors that are null or hold null or non-finite components take no part, neither do rows without an
id; an empty vector scores 0 with all others of its length; vectors of different lengths never meet; repeated ids are
candidates one by one, and a query passes over every row that bears its own id; rows that repeat a query's id are one
query's results together; further columns play no part.  Scores are
64-bit whole numbers: if the greatest component could take an inner product beyond them, an OverflowError names it
before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.llm.scratch import materialize

SCALE, TOP, CANDIDATES, QUERIES, DEPTH = 256, 5, 16384, 512, 16


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, ids: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.order = np.argsort(self.values, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.values, self.order, axis=0)

    def best(
        self,
        query_ids: np.ndarray,
        queries: np.ndarray,
        k: int = TOP,
        depth: int = DEPTH,
    ) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        """For each query the ids and scores of its k best, ties to the smaller id; and how many scores were made.

        The queries of a block share their sorted access (both ends of every list), each leaves as its bound allows.
        """
        n, width = self.values.shape
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        first, last = np.searchsorted(self.ids, query_ids), np.searchsorted(self.ids, query_ids, "right")
        at = [np.zeros(0, np.int64) for _ in query_ids]
        scores = [np.zeros(0, queries.dtype) for _ in query_ids]
        active, seen, done, made = np.arange(len(query_ids)), np.zeros(n, bool), 0, 0
        while len(active):
            to = min(n, max(depth, 2 * done)) if width else n
            met = np.zeros(n, bool)
            met[self.order[done:to]] = True
            met[self.order[n - to : n - done]] = True
            if not width:
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            found = queries[active] @ self.values[new].T
            made += found.size
            high, low = (self.sorted[n - to], self.sorted[to - 1]) if width else (np.zeros(0), np.zeros(0))
            bound, done = up[active] @ high + down[active] @ low, to
            over = done == n or bool(seen.all())
            going = []
            for row, q in enumerate(active):
                own = (new >= first[q]) & (new < last[q])
                here, there = (found[row][~own], new[~own]) if own.any() else (found[row], new)
                if len(here) > k:
                    kept = here >= np.partition(here, len(here) - k)[len(here) - k]
                    here, there = here[kept], there[kept]
                at[q], scores[q] = np.concatenate([at[q], there]), np.concatenate([scores[q], here])
                best = np.lexsort((at[q], -scores[q]))[:k]
                at[q], scores[q] = at[q][best], scores[q][best]
                if not over and (len(best) < k or scores[q][-1] <= bound[row]):
                    going.append(q)
            active = np.array(going, np.int64)
        return [self.ids[x] for x in at], scores, made


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """The number type in which inner products are exact: doubles up to 2**53, else Python's integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    return np.float64 if most < 2**53 else object


def _runs(keys: list[np.ndarray]) -> list[tuple[int, int]]:
    """Where the runs of equal rows of ``keys`` begin and end."""
    n = len(keys[0])
    cut = np.zeros(n, bool)
    for k in keys:
        cut[1:] |= k[1:] != k[:-1]
    starts = [0, *np.flatnonzero(cut).tolist()] if n else []
    return list(zip(starts, [*starts[1:], n]))


def _rank(k: int, pack: int):
    """Rows (block, share, width, asked, vec_id, v), sorted by the first four: a block's candidates, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block, lists = None, [], None, {}
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
            for a, b in _runs(columns):
                key, asked = tuple(c[a] for c in columns[:3]), bool(columns[3][a])
                ids = batch.column(4).slice(a, b - a).to_numpy()
                values = batch.column(5).slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, int(key[2]))
                if key != at:
                    at, held, block, lists = key, [], None, {}
                if not asked:
                    held.append((ids, values))
                    continue
                if block is None and held:
                    block = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    held = []
                for i in range(0, b - a, pack) if block else ():
                    queries, vectors = ids[i : i + pack], values[i : i + pack]
                    kind = _exact(block[1], vectors)
                    if kind not in lists:
                        lists[kind] = Lists(block[0], block[1].astype(kind))
                    found, scores, _ = lists[kind].best(queries, vectors.astype(kind), k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(queries, [len(f) for f in found])),
                            pa.array(np.concatenate(found)),
                            pa.array([int(x) for x in np.concatenate(scores)], pa.int64()),
                        ],
                        names=["query_id", "vec_id", "score"],
                    )

    return run


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = TOP,
    scale: int = SCALE,
    candidates: int = CANDIDATES,
    queries: int = QUERIES,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row of ``vectors`` (vec_id, embedding) for which ``is_query`` holds."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "vec_id",
        whole_numbers(F.col("embedding"), scale).alias("v"),
        F.size("embedding").alias("width"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    )
    rows = materialize(rows, "threshold-rows")
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    n, m, reach, largest = rows.agg(F.count(F.lit(1)), F.count_if("asked"), F.max(most * most * F.col("width")), F.max(most)).first()
    if (reach or 0) >= 2**63:
        raise OverflowError(f"components up to {largest:.3g} after scaling can take an inner product beyond 64 bits")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n // candidates))
    shares = max(1, min(-(-m // queries), -(-parts // blocks)))
    dealt = lambda number, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(number)).cast("int")
    every = lambda number: F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    here = rows.select(dealt(blocks, 0).alias("block"), every(shares).alias("share"), "width", F.lit(False).alias("asked"), "vec_id", "v")
    asked = rows.filter("asked").select(every(blocks).alias("block"), dealt(shares, 1).alias("share"), "width", "asked", "vec_id", "v")
    met = here.unionByName(asked).repartition(parts, "block", "share", "width").sortWithinPartitions("block", "share", "width", "asked")
    found = met.mapInArrow(_rank(k, queries), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
