"""Registered queries: searches of stored structures for whole tables of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.functions import text
from tarnfell.operators import index, knn, linking
from tarnfell.operators.lineage import fresh_folder
from tarnfell.plans.registry import query
from tarnfell.plans.retrieval_queries import _WORDS
from tarnfell.plans.shared import table


def _sql_index(keep: str) -> str:
    """Every passage of the benchmark against every document, by all pairs of a word and a document."""
    return f"""
        WITH d AS (SELECT doc_id, n_chars, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
        n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
        tf AS (SELECT doc_id, n_chars, dl, term, count(*) AS f FROM (SELECT doc_id, n_chars, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
        s AS (SELECT item_id, doc_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
              FROM q JOIN tf USING (term) JOIN df USING (term), n WHERE {keep} GROUP BY item_id, doc_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 10) DESC, doc_id) AS INT) AS rank FROM s)
        SELECT item_id AS query_id, rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10"""


def _index(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    path = fresh_folder(spark, "index")
    index.build(table(spark, sf_dir, "documents"), "doc_id", "text", path, keep=["n_chars"], buckets=16)
    found = index.search(table(spark, sf_dir, "benchmark"), "item_id", "text", path, keep=keep)
    return found.select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


@query(_sql_index("true"))
def index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)


@query(_sql_index("n_chars <= 2000"))
def index_bm25_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir, F.col("n_chars") <= 2000)


# ------------------------------------------------------------------------------------------------- nearest vectors


def _sql_nearest(k: int, over: int, keep: str) -> str:
    return f"""
        WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, c.label, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 10) AS score
                   FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s),
        f AS (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM r WHERE n <= {over} AND {keep})
        SELECT query_id, rank, vec_id, round(score, 6) AS score FROM f WHERE rank <= {k}"""


def _nearest(spark: SparkSession, sf_dir: str, k: int, keep=None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    hits = knn.nearest(rows, "vec_id", "embedding", rows.filter("vec_id % 20 = 0"), "vec_id", "embedding", k, keep, apart=True)
    return hits.select("query_id", "rank", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query(_sql_nearest(10, 10, "true"))
def dense_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector against all others."""
    return _nearest(spark, sf_dir, 10)


@query(_sql_nearest(5, 50, "label <= 2"))
def dense_batch_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget is a filter on the fifty nearest."""
    return _nearest(spark, sf_dir, 5, F.col("label") <= 2)


# ------------------------------------------------------------------------------------------------- names in texts


@query("""WITH c AS (SELECT conv_id * 1000 + turn AS name_id, regexp_extract_all(lower(text), '[a-z0-9]+')[1:1 + conv_id % 3] AS t FROM conversations),
          q AS (SELECT name_id, array_to_string(t, ' ') AS run, len(t) AS l FROM c WHERE len(t) > 0),
          d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
          g AS (SELECT doc_id, len(t) AS size, l, unnest(list_transform(range(1, len(t) - l + 2), lambda i: array_to_string(t[i:i + l - 1], ' '))) AS run FROM d, (SELECT unnest([1, 2, 3]) AS l)),
          m AS (SELECT name_id, doc_id, q.l = size AS exact, count(*) AS n FROM g JOIN q USING (run, l) GROUP BY ALL)
          SELECT name_id, min({'a': NOT exact, 'b': doc_id}).b AS doc_id, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_places, max(exact) AS exact FROM m GROUP BY name_id""")
def names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three words that each turn of the conversations begins with, looked for in all documents."""
    n = F.col("conv_id") % 3 + 1
    terms = text.terms(F.coalesce("text", F.lit("")))
    names = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("name_id"), F.array_join(F.slice(terms, F.lit(1), n.cast("int")), " ").alias("name")
    )
    found = linking.linked(table(spark, sf_dir, "documents"), "doc_id", "text", names, "name_id", "name")
    return found.withColumnRenamed("text_id", "doc_id")
