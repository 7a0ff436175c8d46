"""Dense and keyword retrieval, fusion of rankings, scoring by requirements."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.functions import rules, text, vectors
from tarnfell.functions.binding import let
from tarnfell.operators.lineage import cut


def best_first(score: str) -> Column:
    """Descending; scores that agree to ten digits tie, in whatever order their parts were added up."""
    return F.desc(F.round(score, 10))


def dense(df: DataFrame, id_: str, vector: str, query: Sequence[float], k: int, keep: Column | None = None, over: int = 10) -> DataFrame:
    """(id, score): the k nearest by cosine.  ``keep`` is applied to the ``over * k`` best, not before: that is its meaning."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.withColumn("score", vectors.cosine(vectors.doubles(F.col(vector)), q))
    if keep is None:
        return scored.orderBy(best_first("score"), id_).limit(k).select(id_, "score")
    return scored.orderBy(best_first("score"), id_).limit(over * k).filter(keep).orderBy(best_first("score"), id_).limit(k).select(id_, "score")


def bm25(
    df: DataFrame,
    id_: str,
    body: str,
    query: str,
    k: int | None,
    keep: Column | None = None,
    k1: float = rules.BM25_K1,
    b: float = rules.BM25_B,
) -> DataFrame:
    """(id, score) by BM25 over distinct query words; ``keep`` restricts what is returned, never the statistics.

    The corpus is read once: a document becomes its length and the counts of the query's words, which are kept in the
    shared folder; nothing but partial sums is shuffled, and the corpus's own figures are one row.
    """
    asked = sorted(set(query.lower().split()))
    tokens = text.words(F.coalesce(F.col(body), F.lit("")))
    wanted = F.array(*map(F.lit, asked))
    told = let(
        tokens,
        lambda t: F.struct(
            F.size(t).alias("dl"),
            let(
                F.filter(t, lambda x: F.array_contains(wanted, x)),
                lambda hit: F.transform(wanted, lambda w: F.size(F.filter(hit, lambda x: x == w))),
            ).alias("tf"),
        ),
    )
    rows = df.select(id_, (keep if keep is not None else F.lit(True)).alias("keep"), told.alias("told")).select(id_, "keep", "told.*")
    rows = cut(rows)  # a few numbers a document, instead of reading all texts for the statistics and again for the scores
    figures = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("dl").alias("avgdl"),
        F.array(*[F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(asked))]).alias("df"),
    )
    stats = figures.select(F.struct("n", "avgdl", "df").alias("s")).scalar()
    s = F.col("s")

    def part(f: Column, d: Column) -> Column:
        idf = F.log((s["n"] - d + 0.5) / (d + 0.5) + 1)
        return F.when(f > 0, idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / s["avgdl"]))).otherwise(0.0)

    found = rows.filter("keep and exists(tf, f -> f > 0)").withColumn("s", stats)
    scored = found.select(id_, F.aggregate(F.zip_with("tf", s["df"], part), F.lit(0.0), lambda a, x: a + x).alias("score"))
    return scored if k is None else scored.orderBy(best_first("score"), id_).limit(k)


def ranked(df: DataFrame, id_: str, score: str = "score") -> DataFrame:
    """A short ranking with ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(best_first(score), id_)))


def fuse(rankings: Sequence[DataFrame], id_: str, k: int = rules.RRF_K) -> DataFrame:
    """(id, rrf_score): reciprocal rank fusion of rankings that have ``rank``; ``first_seen`` orders ties."""
    both = None
    for i, r in enumerate(rankings):
        part = r.select(id_, (1.0 / (k + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), "rank").alias("seen"))
        both = part if both is None else both.unionByName(part)
    return both.groupBy(id_).agg(F.sum("part").alias("rrf_score"), F.min("seen").alias("first_seen"))


def hybrid(dense_hits: DataFrame, sparse_hits: DataFrame, id_: str, k: int) -> DataFrame:
    """(id, rrf_score, rank): the k best of both rankings; ties go to the one seen first, dense before sparse."""
    fused = fuse([ranked(dense_hits, id_), ranked(sparse_hits, id_)], id_)
    order = (F.desc("rrf_score"), F.col("first_seen"))
    top = fused.orderBy(*order).limit(k)
    return top.select(id_, "rrf_score", F.row_number().over(W.orderBy(*order)).alias("rank"))


def blended(spark: SparkSession, texts: Sequence[str], embed: Callable[[Column], Column], width: int) -> list[float]:
    """The mean of two texts' vectors, each brought to the width of the stored ones: one short row."""
    one, two = (vectors.fit_width(embed(F.lit(t)), width) for t in texts)
    return list(spark.range(1).select(vectors.blend(one, two).alias("v")).first()["v"])


def hybrid_pipeline(
    df: DataFrame,
    id_: str,
    body: str,
    vector: str,
    width: int,
    query: str,
    imagine: Callable[[str], str],
    embed: Callable[[Column], Column],
    keep: Column | None = None,
    k: int = 10,
) -> DataFrame:
    """(id, rrf_score, rank): the whole search for a query.

    ``imagine`` makes a hypothetical answer; its vector and the query's are blended for the dense ranking, and both
    texts are the words of the sparse one; ``keep`` (a budget) restricts both.
    """
    answer = imagine(query)
    near = dense(df, id_, vector, blended(df.sparkSession, (answer, query), embed, width), k, keep)
    said = bm25(df, id_, body, f"{answer} {query}", k, keep)
    return hybrid(near, said, id_, k)


def tier_index(tier: Column) -> Column:
    return F.when(tier == "low", 0).when(tier == "medium", 1).when(tier == "high", 2).otherwise(-1)


def match_count(features: Sequence[str], wanted: Mapping[str, str]) -> Column:
    """How many features reach the wanted tier."""
    return sum((F.when(tier_index(F.col(f)) >= tier_index(F.lit(wanted[f])), 1).otherwise(0) for f in features if f in wanted), F.lit(0))


def agreement(features: Sequence[str], wanted: Mapping[str, Column]) -> Column:
    """How many features have exactly the wanted tier."""
    return sum((F.when(F.col(f) == wanted[f], 1).otherwise(0) for f in features), F.lit(0))


def score_and_rank(
    df: DataFrame,
    features: Sequence[str],
    wanted: Mapping[str, str],
    budget: Column,
    price: str,
    rrf: str,
    id_: str,
    k: int = 3,
) -> DataFrame:
    """The k best within the budget by (matches, fused score)."""
    scored = df.filter(F.col(price) <= text.limit(budget)).withColumn("match_score", match_count(features, wanted))
    return scored.orderBy(F.desc("match_score"), F.desc(rrf), id_).limit(k)


def validated(df: DataFrame, score: str, order: Sequence[Column], least: int = 2) -> DataFrame:
    """Rows with the least score or more; where there are none, the single best.  ``df`` is run twice."""
    top = df.select(F.coalesce(F.max(score), F.lit(least - 1)).alias("top")).scalar()
    best = df.orderBy(*order).limit(1).filter(top < least)
    return df.filter(F.col(score) >= least).unionByName(best)


def precision(hits: DataFrame, method: str, strict: Column, relaxed: Column) -> DataFrame:
    """(method, n, strict, relaxed): shares of the hits of each method."""
    return hits.groupBy(method).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(strict.cast("double")).alias("strict"),
        F.avg(relaxed.cast("double")).alias("relaxed"),
    )


def winner(shares: DataFrame, method: str, value: str, order: Sequence[str]) -> DataFrame:
    """The method with the largest share; ties go to the one that comes first in ``order``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(method))
    return shares.filter(place > 0).orderBy(F.desc(value), place).limit(1).select(F.col(method).alias("winner"), value)
