"""A stored inverted index, and a search for a whole table of queries that reads only what may matter.

An index is a folder of three tables:

* ``docs`` (id, dl, block, further columns): every document, its length in words and its block;
* ``postings`` (term, block, n, top, entries), partitioned by ``bucket``, a hash of the term: the documents of a block that
  have the term, each with its count and its weight, their number and the largest weight.  A weight is what BM25 makes of a
  count and a length, without the term's rarity;
* ``figures``: one row with the number of documents, their mean length, the number of blocks and the settings.

A block is some ``block_docs`` documents by a hash of their ids, so a term's postings within one are few however frequent
the term is: they are one row, which is joined, written and skipped as such.  Texts are read once for the lengths and once
for the postings; they move once, to the task of their block, which makes and writes the rows of all its terms.

The search is exact.  Block maxima bound what any document of a block can score; the most promising blocks are scored
first and give each query a score that the k-th hit has at least; in the other blocks only those documents are scored
that have one of the terms without which no document of the block reaches it.

Ids are unique; rows without an id are left out; null and empty texts are documents without words.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.functions import rules, text
from tarnfell.operators.lineage import cut

#: Rows of words, queries or blocks up to which every task gets them, to leave out others where they are read.
BROADCAST_ROWS = 200_000
#: Queries that meet a block at once.
PACK = 256


def _fields(kind: str) -> str:
    return f"term string, block long, n long, top double, entries array<struct<id:{kind},tf:int,weight:double>>"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _posted(mean: float, k1: float, b: float):
    """The postings of one block's texts: a row a term, with its documents in the order of the texts."""

    def post(block: pa.Table) -> pa.Table:
        said = block.column("said").cast(pa.large_string()).combine_chunks()
        words = pc.utf8_split_whitespace(said)  # the white space of text.SPACE
        docs, said = pc.list_parent_indices(words), words.flatten()
        real = pc.not_equal(said, "")  # what stands before and after outer white space is no word
        docs, coded = docs.filter(real).to_numpy(), said.filter(real).dictionary_encode()
        size, order = len(block), pc.sort_indices(coded.dictionary)
        place = np.argsort(order.to_numpy())
        # One number a word, by term and then by document: what is equal is counted.
        keys, tf = np.unique(place[coded.indices.to_numpy()] * size + docs, return_counts=True)
        term, doc = keys // size, keys % size
        weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * np.bincount(docs, minlength=size)[doc] / mean))
        firsts = np.searchsorted(term, np.arange(len(order) + 1)).astype(np.int32)
        found = [block.column("id").take(pa.array(doc)).combine_chunks(), pa.array(tf, pa.int32()), pa.array(weight)]
        entries = pa.ListArray.from_arrays(pa.array(firsts), pa.StructArray.from_arrays(found, ["id", "tf", "weight"]))
        top = np.maximum.reduceat(weight, firsts[:-1]) if len(order) else weight
        columns = {
            "term": coded.dictionary.take(order).cast(pa.string()),
            "block": pa.array(np.full(len(order), block.column("block")[0].as_py(), np.int64)),
            "n": pa.array(np.diff(firsts), pa.int64()),
            "top": pa.array(top),
            "entries": entries,
        }
        return pa.table(columns)

    return post


def build(
    df: DataFrame,
    id_: str,
    body: str,
    path: str,
    keep: Sequence[str] = (),
    block_docs: int = 256,
    buckets: int = 64,
    k1: float = rules.BM25_K1,
    b: float = rules.BM25_B,
) -> None:
    """Write the index of ``df`` to ``path``, in place of one that is there; ``keep`` are columns to restrict searches by."""
    spark = df.sparkSession
    rows = df.filter(F.col(id_).isNotNull())
    said = F.coalesce(F.col(body), F.lit(""))
    lengths = cut(rows.select(F.col(id_).alias("id"), text.n_words(said).alias("dl"), *keep))
    n, mean = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    n_blocks = max(1, -(-n // block_docs))
    block = F.pmod(F.xxhash64("id"), F.lit(n_blocks))
    lengths.withColumn("block", block).write.mode("overwrite").parquet(f"{path}/docs")

    # What moves, once, is the texts, each to its block; all rows of a block's terms are made there.
    texts = rows.select(F.col(id_).alias("id"), F.lower(said).alias("said")).withColumn("block", block)
    made = texts.groupBy("block").applyInArrow(_posted(float(mean or 1.0), k1, b), _fields(df.schema[id_].dataType.simpleString()))
    made = made.withColumn("bucket", bucket_of(F.col("term"), buckets))
    made.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    figures = (n, float(mean or 0.0), n_blocks, buckets, k1, b)
    kind = "n long, mean double, n_blocks long, buckets int, k1 double, b double"
    spark.createDataFrame([figures], kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/figures")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The postings as they are stored: (term, block, n, top, entries, bucket)."""
    kind = spark.read.parquet(f"{path}/docs").schema["id"].dataType.simpleString()
    return spark.read.schema(f"{_fields(kind)}, bucket int").parquet(f"{path}/postings")


def postings(spark: SparkSession, path: str) -> DataFrame:
    """All postings, one row each: (term, block, id, tf, weight)."""
    return stored(spark, path).select("term", "block", F.inline("entries"))


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits a query; tasks keep no more than k of a query before they meet."""
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 10)), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _small(df: DataFrame) -> DataFrame:
    """``df``, which is materialised, given to every task where it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _scored(k: int, some: bool):
    """The best documents of a block for a pack of queries; with ``some``, only those in the row without a term."""

    def score(found: pa.Table, wanted: pa.Table) -> pa.Table:
        found, wanted = found.combine_chunks(), wanted.sort_by([("query_id", "ascending"), ("term", "ascending")])
        queries = wanted.column("query_id").combine_chunks().dictionary_encode()
        ids = pc.list_flatten(found.column("ids")).combine_chunks().dictionary_encode()
        doc, weight = ids.indices.to_numpy(), pc.list_flatten(found.column("weights")).to_numpy()
        sizes = pc.list_value_length(found.column("ids")).to_numpy().astype(np.int64)
        starts, shape = np.cumsum(sizes) - sizes, (len(queries.dictionary), len(ids.dictionary))
        # One number an entry of a list that a query wants: its cell among queries and documents.
        row = pc.index_in(wanted.column("term"), found.column("term").combine_chunks()).to_numpy()
        n = sizes[row]
        entry = np.arange(n.sum()) + np.repeat(starts[row] - (np.cumsum(n) - n), n)
        cell = np.repeat(queries.indices.to_numpy(), n) * np.int64(shape[1]) + doc[entry]
        added = np.repeat(wanted.column("idf").to_numpy(), n) * weight[entry]
        scores = np.bincount(cell, added, shape[0] * shape[1]).reshape(shape)
        needed = np.repeat(wanted.column("needed").to_numpy(), n)
        able = (np.bincount(cell[needed], minlength=scores.size) > 0).reshape(shape)
        least = np.full(shape[0], -np.inf)
        least[queries.indices.to_numpy()] = wanted.column("least").fill_null(-np.inf).to_numpy()
        able &= scores >= least[:, None]
        if some:
            kept = np.repeat(found.column("term").is_null().to_numpy(), sizes)
            able &= np.isin(np.arange(shape[1]), doc[kept])
        scores = np.where(able, scores, -np.inf)
        if k < shape[1]:  # what is as good as the k-th but for rounding stays
            able &= scores >= np.partition(scores, -k, axis=1)[:, -k, None] - 1e-9
        asked, at = np.nonzero(able)
        columns = [queries.dictionary.take(pa.array(asked)), ids.dictionary.take(pa.array(at)), pa.array(scores[asked, at])]
        return pa.Table.from_arrays(columns, ["query_id", "id", "score"])

    return score


class Search:
    """A search of the index at ``path`` for all of ``queries``; :meth:`hits` gives (query_id, rank, id, score)."""

    def __init__(self, queries: DataFrame, query_id: str, said: str, path: str, k: int = 10, keep: Column | None = None, first: int = 4) -> None:
        self.spark, self.path, self.k, self.keep, self.first = queries.sparkSession, path, k, keep, first
        figures = self.spark.read.parquet(f"{path}/figures").first()
        terms = F.array_distinct(text.words(F.coalesce(F.col(said), F.lit(""))))
        asked = queries.filter(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.explode(terms).alias("term"))
        asked = cut(asked.distinct().withColumn("bucket", bucket_of(F.col("term"), figures["buckets"])))
        #: No more than the index has; they become a filter on partitions.
        self.buckets = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())
        self.terms = _small(cut(asked.select("bucket", "term").distinct()))
        #: Packs of queries, by a hash of their ids.
        self.pack = F.pmod(F.xxhash64("query_id"), F.lit(-(-asked.select("query_id").distinct().count() // PACK) or 1))
        told = cut(self.stored().select("bucket", "term", "block", "n", "top"))
        n = F.lit(figures["n"])
        rare = told.groupBy("bucket", "term").agg(F.sum("n").alias("df")).select(
            "bucket", "term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf")
        )
        asked = cut(asked.join(rare, ["bucket", "term"]))
        #: What a term can add to a document of the block at most.
        self.bounds = cut(told.drop("n").join(_small(asked), ["bucket", "term"]).withColumn("bound", F.col("idf") * F.col("top")).drop("top"))

    def stored(self) -> DataFrame:
        """The stored rows of the queries' words."""
        found = stored(self.spark, self.path).filter(F.col("bucket").isin(self.buckets))
        return found.join(self.terms, ["bucket", "term"], "left_semi")

    def scores(self, wanted: DataFrame) -> DataFrame:
        """(query_id, id, score) of a query's best documents of each block: kept, with a ``needed`` term and ``least`` or more.

        ``wanted`` (query_id, term, block, idf, needed, least) holds all terms of a query that the block has.  Lists go to
        their block once a pack of queries, and are met there.
        """
        wanted = wanted.select("block", self.pack.alias("pack"), "query_id", "term", "idf", "needed", "least")
        found = self.stored().select("block", "term", F.col("entries.id").alias("ids"), F.col("entries.weight").alias("weights"))
        if self.keep is not None:
            kept = self.spark.read.parquet(f"{self.path}/docs").filter(self.keep).groupBy("block")
            kept = kept.agg(F.collect_list("id").alias("ids"), F.collect_list(F.lit(0.0)).alias("weights"))  # of one block
            found = found.unionByName(kept.withColumn("term", F.lit(None).cast("string")))
        spots = wanted.select("block", F.col("pack").alias("at")).distinct()
        found = found.join(_small(spots), "block").withColumnRenamed("at", "pack")
        kinds = dict(wanted.dtypes)["query_id"], dict(found.dtypes)["ids"].removeprefix("array<").removesuffix(">")
        met = found.groupBy("block", "pack").cogroup(wanted.groupBy("block", "pack"))
        return met.applyInArrow(_scored(self.k, self.keep is not None), f"query_id {kinds[0]}, id {kinds[1]}, score double")

    def first_pass(self) -> DataFrame:
        """(query_id, block) of the most promising blocks, whose documents are all scored into ``early``."""
        order = W.partitionBy("query_id").orderBy(F.desc("bound"), "block")
        blocks = self.bounds.groupBy("query_id", "block").agg(F.sum("bound").alias("bound"))
        pairs = cut(blocks.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= self.first).select("query_id", "block"))
        wanted = self.bounds.join(_small(pairs), ["query_id", "block"])
        wanted = wanted.withColumn("needed", F.lit(True)).withColumn("least", F.lit(None).cast("double"))
        self.early = cut(_best(self.scores(wanted), self.k))
        return pairs

    def second_pass(self, done: DataFrame) -> DataFrame:
        """(query_id, term, block, ...) of the other blocks that may hold a hit; ``needed`` are terms one of which a hit has.

        A block's terms are ordered by what they can add.  The first of them, which together don't reach the k-th score
        of the first pass, are not enough for a hit: only documents with one of the others are looked at.
        """
        least = self.early.filter(F.col("rank") == self.k).select("query_id", (F.col("score") - 1e-9).alias("least"))
        rest = self.bounds.join(_small(done), ["query_id", "block"], "left_anti").join(_small(least), "query_id", "left")
        upto = W.partitionBy("query_id", "block").orderBy("bound", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
        return rest.withColumn("needed", F.coalesce(F.sum("bound").over(upto) >= F.col("least"), F.lit(True)))

    def late(self, rest: DataFrame) -> DataFrame:
        """(query_id, id, score) of documents with a needed term whose score reaches the k-th of the first pass."""
        some = F.max("needed").over(W.partitionBy("query_id", "block"))
        return self.scores(cut(rest.withColumn("some", some).filter("some")))

    def hits(self) -> DataFrame:
        late = _best(self.late(self.second_pass(self.first_pass())), self.k)
        both = self.early.drop("rank").unionByName(late.drop("rank"))
        return _best(both, self.k).select("query_id", "rank", "id", "score")


def search(queries: DataFrame, query_id: str, said: str, path: str, k: int = 10, keep: Column | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each query the k best documents by BM25; a query that meets none has no rows."""
    return Search(queries, query_id, said, path, k, keep).hits()
