"""The nearest vectors of a whole table of queries: exact, by products of blocks.

Queries are packed into matrices.  Where all of them fit ``BROADCAST_BYTES``, every task gets them and goes through its
candidates where they lie: no candidate moves.  Where they don't, candidates are dealt into blocks and queries into packs
of a bounded size, a block meets each pack once, by its number, and what moves is blocks times packs.  Either way a task
keeps no more than the k best of a query among the candidates it holds, and those few meet once more.

Scores are cosines in double precision, rounded to ten digits before they are compared; ties go to the smaller id.  A
vector that is null or empty, has no length, holds null or non-finite components, or isn't as wide as the first query,
takes no part.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of packed queries up to which every task gets all of them.
BROADCAST_BYTES = 64 << 20
#: Rows of a block of candidates and of a pack of queries, where both are dealt out.
BLOCK, PACK = 1 << 14, 1 << 14
#: Queries that are looked for at once, and products of a candidate and a query that are held at once.
ASKED, HELD = 1 << 11, 1 << 20


def unit_rows(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list array that can be compared, each of length one, and their places."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(sizes == width)
    flat = vectors.take(pa.array(places)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    rows = flat.reshape(len(places), width)
    with np.errstate(all="ignore"):
        top = np.abs(rows).max(axis=1, initial=0.0)
        rows = rows / np.where(top > 0, top, np.nan)[:, None]  # of any magnitude
        rows = rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    sound = np.isfinite(rows).all(axis=1) & np.isfinite(top)
    return rows[sound], places[sound]


class Best:
    """The k best candidates of each query so far: one matrix of scores and one of places."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.scores = np.full((len(queries), 0), -np.inf)
        self.rows = np.zeros((len(queries), 0), np.int64)

    def add(self, candidates: np.ndarray, rows: np.ndarray) -> None:
        """``rows`` number the candidates; of equal scores the smaller number is better."""
        step = max(1, HELD // max(1, len(self.queries)))
        for at in range(0, len(candidates), step):
            new = np.round(self.queries @ candidates[at : at + step].T, 10)
            scores = np.concatenate([self.scores, new], axis=1)
            numbers = np.concatenate([self.rows, np.broadcast_to(rows[at : at + step], new.shape)], axis=1)
            order = np.lexsort((numbers, -scores), axis=1)[:, : self.k]
            self.scores, self.rows = np.take_along_axis(scores, order, 1), np.take_along_axis(numbers, order, 1)


def _hits(best: Best, query_ids: pa.Array, ids: pa.Array, kept: pa.Array) -> pa.RecordBatch:
    asked = np.repeat(np.arange(len(best.queries)), best.rows.shape[1])
    found = pa.array(best.rows.ravel())
    columns = [query_ids.take(pa.array(asked)), ids.take(found), kept.take(found), pa.array(best.scores.ravel())]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "keep", "score"])


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _search(candidates: pa.Table, queries: np.ndarray, query_ids: pa.Array, width: int, k: int) -> Iterator[pa.RecordBatch]:
    """The best of one block, whose rows are numbered by id so that ties go to the smaller one.

    A few queries at a time, so that neither their best nor what is returned at once grows with the number of queries.
    """
    block = candidates.sort_by("id")
    ids, kept = _whole(block.column("id")), _whole(block.column("keep"))
    rows, places = unit_rows(_whole(block.column("vector")), width)
    for at in range(0, max(1, len(queries)), ASKED):
        best = Best(queries[at : at + ASKED], k)
        best.add(rows, places)
        yield _hits(best, query_ids.slice(at, ASKED), ids, kept)


def _packed(ids: pa.Array, rows: np.ndarray) -> bytes:
    sink = io.BytesIO()
    table = pa.table({"id": ids, "row": pa.array(list(rows.astype(np.float64)), pa.list_(pa.float64()))})
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue()


@functools.lru_cache(2)
def _unpacked(data: bytes, width: int) -> tuple[pa.Array, np.ndarray]:
    table = pa.ipc.open_stream(data).read_all()
    return _whole(table.column("id")), _whole(table.column("row")).flatten().to_numpy().reshape(-1, width)


def nearest(
    df: DataFrame,
    id_: str,
    vector: str,
    queries: DataFrame,
    query_id: str,
    query_vector: str,
    k: int,
    keep: Column | None = None,
    over: int = 10,
    apart: bool = False,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest of ``df`` for each row of ``queries``.

    ``keep`` is applied to the ``over * k`` best of a query, not before, which is its meaning.  With ``apart`` a candidate
    whose id is the query's is left out (before anything is counted).  Ids are unique on either side and not null.
    """
    spark = df.sparkSession
    n = (k if keep is None else over * k) + apart
    asked = queries.filter(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector"))
    told = df.filter(F.col(id_).isNotNull()).select(
        F.col(id_).alias("id"), F.col(vector).alias("vector"), (F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))).alias("keep")
    )
    first = asked.filter(F.size("vector") > 0).select(F.size("vector").alias("w")).first()
    width = first["w"] if first else 0
    kind = lambda d, c: d.schema[c].dataType.simpleString()
    schema = f"query_id {kind(asked, 'query_id')}, id {kind(told, 'id')}, keep boolean, score double"
    n_queries = asked.count() if width else 0
    if n_queries * width * 8 <= BROADCAST_BYTES:
        hits = _where_they_lie(told, asked, width, n, schema) if n_queries else spark.createDataFrame([], schema)
    else:
        hits = _dealt(told, asked, width, n, schema, -(-n_queries // PACK))
    if apart:
        hits = hits.filter(F.col("query_id") != F.col("id"))
        n -= 1
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    if keep is not None:
        best = best.filter("keep").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", "score")


def _where_they_lie(told: DataFrame, asked: DataFrame, width: int, n: int, schema: str) -> DataFrame:
    """Every task has all queries, whose size has been checked."""
    rows = asked.toArrow()
    found, places = unit_rows(_whole(rows.column("vector")), width)
    pack = told.sparkSession.sparkContext.broadcast(_packed(_whole(rows.column("query_id")).take(pa.array(places)), found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = _unpacked(pack.value, width)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield from _search(pa.Table.from_batches(held), matrix, ids, width, n)
                held = []
        if held:
            yield from _search(pa.Table.from_batches(held), matrix, ids, width, n)

    return told.mapInArrow(run, schema)


def _dealt(told: DataFrame, asked: DataFrame, width: int, n: int, schema: str, n_packs: int) -> DataFrame:
    """Blocks of candidates meet packs of queries, both told by numbers; each pair is one bounded group."""
    n_blocks = max(1, -(-told.count() // BLOCK))
    blocks = told.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks))).withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1))))
    packs = asked.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(n_packs)).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))
    )

    def meet(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        rows, places = unit_rows(_whole(theirs.column("vector")), width)
        ids = _whole(theirs.column("query_id")).take(pa.array(places))
        return pa.Table.from_batches(_search(mine, rows, ids, width, n))

    return blocks.groupBy("block", "pack").cogroup(packs.groupBy("block", "pack")).applyInArrow(meet, schema)
