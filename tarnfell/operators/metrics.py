"""Metrics of rankings, of classifications and of logs of scored turns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.functions import rules


def ranking(df: DataFrame, query: Sequence[str], rank: str, relevance: Column, exact: Column, k: int = rules.RETRIEVAL_K) -> DataFrame:
    """Per query: recall, precision (by k), reciprocal rank, nDCG against the list's own best order, ranks.

    The order of the ideal list comes from a window over at most k rows of a query.
    """
    rows = df.filter(F.col(rank) <= k).withColumn("__rel", relevance).withColumn("__exact", exact)
    best = F.row_number().over(W.partitionBy(*query).orderBy(F.desc("__rel"), rank))
    gain = lambda at: F.col("__rel") / F.log2(at + 1)
    rows = rows.withColumn("__best", best)
    full = F.col("__rel") >= 1
    out = rows.groupBy(*query).agg(
        F.min(F.when(full, F.col(rank))).alias("first_relevant_rank"),
        F.count_if(full).alias("relevant_in_top_k"),
        F.sum(gain(F.col(rank))).alias("__dcg"),
        F.sum(gain(F.col("__best"))).alias("__idcg"),
        F.max(F.when(F.col("__exact"), F.col(rank))).alias("exact_rank"),
    )
    first = F.col("first_relevant_rank")
    return out.select(
        *query,
        F.when(first.isNotNull(), 1.0).otherwise(0.0).alias("recall_at_k"),
        F.round(F.col("relevant_in_top_k") / k, 4).alias("precision_at_k"),
        F.coalesce(F.round(1 / first, 4), F.lit(0.0)).alias("mrr"),
        F.when(F.col("__idcg") > 0, F.round(F.col("__dcg") / F.col("__idcg"), 4)).otherwise(0.0).alias("ndcg_at_k"),
        "first_relevant_rank",
        "exact_rank",
        "relevant_in_top_k",
    )


def binary(df: DataFrame, predicted: Column, actual: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, tp, fp, fn, tn, accuracy, precision, recall, f1 (from the rounded two), positive_rate; null actuals are negative."""
    a = F.coalesce(actual, F.lit(False))
    p = predicted
    rows = df.filter(p.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(p & a).alias("tp"),
        F.count_if(p & ~a).alias("fp"),
        F.count_if(~p & a).alias("fn"),
        F.count_if(~p & ~a).alias("tn"),
    )
    ratio = lambda x, y: F.round(x / F.nullif(y, F.lit(0)), 4)
    rows = rows.withColumns(
        {
            "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("n")),
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "positive_rate": ratio(F.col("tp") + F.col("fp"), F.col("n")),
        }
    )
    f1 = F.when(
        (F.col("precision") > 0) & (F.col("recall") > 0),
        F.round(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")), 4),
    )
    return rows.withColumn("f1", f1)


def recency(df: DataFrame, by: Sequence[str], seq: Sequence[Column | str], value: str, windows: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Averages of the last values; nulls are left out before counting back."""
    back = F.row_number().over(W.partitionBy(*by).orderBy(*[(F.col(s) if isinstance(s, str) else s).desc() for s in seq]))
    rows = df.filter(F.col(value).isNotNull()).withColumn("__back", back).filter(F.col("__back") <= max(windows))
    return rows.groupBy(*by).agg(
        *[F.round(F.avg(F.when(F.col("__back") <= n, F.col(value))), 4).alias(f"last_{n}" if n == 1 else f"last_{n}_avg") for n in windows]
    )


def mean_std(value: str, name: str, digits: int = 4) -> list[Column]:
    """Null-skipping mean, and population deviation where there are two values at least."""
    return [
        F.round(F.avg(value), digits).alias(f"{name}_avg"),
        F.when(F.count(value) >= 2, F.round(F.stddev_pop(value), digits)).alias(f"{name}_std"),
    ]


def by_category(df: DataFrame, category: Column, values: Mapping[str, str]) -> DataFrame:
    """Means and deviations of each category; a missing one is "unknown"."""
    return df.groupBy(F.coalesce(category, F.lit("unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        *[c for name, v in values.items() for c in mean_std(v, name)],
    )


def case_stats(df: DataFrame, correctness: str, by: Sequence[str] = (), least: float = rules.CORRECT) -> DataFrame:
    c = F.col(correctness)
    good = F.count_if(c >= least)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count(c).alias("scored"),
        (F.count(F.lit(1)) - F.count(c)).alias("unscored"),
        F.round(F.avg(c), 4).alias("avg_correctness"),
        F.round(F.min(c), 4).alias("min_correctness"),
        F.round(F.max(c), 4).alias("max_correctness"),
        good.alias("high_quality"),
        F.round(good / F.nullif(F.count(c), F.lit(0)), 4).alias("high_quality_rate"),
    )


def judge(df: DataFrame, key: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Average, least and largest of the positive scores, and the mean of all of them, noughts included."""
    every = F.array(*[F.coalesce(F.col(s), F.lit(0)).cast("double") for s in scores])
    given = F.filter(every, lambda x: x > 0)
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a))
    return df.select(
        *key,
        F.round(mean(given), 4).alias("judge_avg"),
        F.array_min(given).alias("judge_min"),
        F.array_max(given).alias("judge_max"),
        F.round(mean(every), 4).alias("composite"),
    )


def composites(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The judge's nine criteria of each row, summed up: what is nought counts as not given in the average, the least
    and the number, but not in the two composites of named criteria."""
    score = {c: F.coalesce(F.col(c), F.lit(0)).cast("double") for c in rules.JUDGE_FIELDS}
    given = F.filter(F.array(*score.values()), lambda x: x > 0)
    total = F.aggregate(given, F.lit(0.0), lambda s, x: s + x)
    mean = lambda names: F.round(sum((score[n] for n in names), F.lit(0.0)) / len(names), 2)
    none = F.lit(0.0)
    return df.select(
        *key,
        F.when(F.size(given) > 0, F.round(total / F.size(given), 2)).otherwise(none).alias("judge_avg"),
        F.coalesce(F.array_max(given), none).alias("judge_max"),
        F.coalesce(F.array_min(given), none).alias("judge_min"),
        F.size(given).alias("n_criteria"),
        mean(rules.RETRIEVAL_CRITERIA).alias("retrieval_quality"),
        mean(rules.ANSWER_CRITERIA).alias("answer_quality"),
    )


#: What a scored turn is averaged by: of all turns, and of those only that have a ground truth.
TURN_AVERAGES = (
    "recall_at_k", "precision_at_k", "mrr", "ndcg_at_k", "latency_ms", *(f"judge_{c}" for c in rules.JUDGE_FIELDS),
    "judge_avg", "retrieval_quality", "answer_quality", "faithfulness", "answer_relevancy",
)
SCORED_AVERAGES = ("field_agreement_frac", "price_closeness")
SOURCES = ("dense", "sparse", "kg", "memory", "reranker")


def overall(turns: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row on all turns: counts, correctness, classification, averages, attribution, how often the graph changed the top.

    ``turns`` has correctness, error (null if there was none), the columns of ``TURN_AVERAGES`` and ``SCORED_AVERAGES``,
    kg_changed_top, live_price (null without a hit) and attribution (a struct of booleans, by source).
    """
    c = F.col("correctness")
    scored = c.isNotNull()
    out = turns.agg(
        F.count(F.lit(1)).alias("total_turns"),
        F.count(c).alias("gt_scored"),
        F.count_if(F.col("error").isNull() & ~scored).alias("unscored_no_gt"),
        F.count("error").alias("errors"),
        F.round(F.avg(c), 4).alias("avg_correctness"),
        F.when(F.count(c) >= 2, F.round(F.stddev_pop(c), 4)).alias("std_correctness"),
        F.round(F.min(c), 4).alias("min_correctness"),
        F.round(F.max(c), 4).alias("max_correctness"),
        *[F.round(F.avg(F.when(scored, F.col(n))), 4).alias(f"avg_{n}") for n in SCORED_AVERAGES],
        *[F.round(F.avg(n), 4).alias(f"avg_{n}") for n in TURN_AVERAGES],
        F.round(
            F.count_if(scored & F.coalesce("kg_changed_top", F.lit(False))) / F.nullif(F.count(c), F.lit(0)),
            4,
        ).alias("kg_changed_top_rate"),
        F.count("live_price").alias("live_price_hits"),
        *[F.count_if(F.coalesce(F.col(f"attribution.{s}"), F.lit(False))).alias(f"attributed_{s}") for s in SOURCES],
    )
    classed = binary(turns.filter(scored), predicted, actual).withColumnRenamed("n", "classified")
    return out.crossJoin(classed)  # one row each


def category_summary(turns: DataFrame) -> DataFrame:
    """Per category (else pipeline, else "unknown"): counts, and averages of what is scored and of what isn't."""
    scored = F.col("correctness").isNotNull()
    of_scored = {
        "correctness": "avg_correctness",
        "field_agreement": "avg_fa",
        "field_agreement_frac": "avg_fa_frac",
        "price_closeness": "avg_pc",
    }
    of_all = {"judge_avg": "avg_judge", "faithfulness": "avg_faithfulness", "answer_relevancy": "avg_ar"}
    return turns.groupBy(F.coalesce("category", "pipeline", F.lit("unknown")).alias("category")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("correctness").alias("n_scored"),
        *[F.round(F.avg(F.when(scored, F.col(c))), 4).alias(name) for c, name in of_scored.items()],
        *[F.round(F.avg(c), 4).alias(name) for c, name in of_all.items()],
    )


def extremes(turns: DataFrame, value: str, order: Sequence[str], n: int = 5) -> DataFrame:
    """The n best and the n worst rows with a value, as ``side`` and ``place``; ``order`` settles ties.

    Ascending and stable: the best are the last of that order, the very last first.
    """
    rows = turns.filter(F.col(value).isNotNull())
    worst = rows.orderBy(F.col(value), *order).limit(n)
    best = rows.orderBy(F.col(value).desc(), *[F.col(c).desc() for c in order]).limit(n)
    place = lambda *by: F.row_number().over(W.orderBy(*by))  # n rows
    one = worst.withColumn("side", F.lit("worst")).withColumn("place", place(F.col(value), *order))
    two = best.withColumn("side", F.lit("best")).withColumn("place", place(F.col(value).desc(), *[F.col(c).desc() for c in order]))
    return two.unionByName(one)


def last_turns(turns: DataFrame, seq: Sequence[str], n: int) -> DataFrame:
    """The last n rows of a log, in its order."""
    return turns.orderBy(*[F.col(c).desc() for c in seq]).limit(n).orderBy(*seq)
