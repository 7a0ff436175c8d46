"""Registered queries: streams that are run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.operators.lineage import fresh_folder
from tarnfell.plans.registry import query
from tarnfell.streaming import streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.events(spark, f"{sf_dir}/events*.parquet")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.drained(streams.windowed(_events(spark, sf_dir), "6 hours"), "complete", "tumbling")
    return rows.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') - to_hours(6 * o) AS start, event_type, value FROM events, (SELECT unnest([0, 1]) AS o))
          SELECT start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.drained(streams.windowed(_events(spark, sf_dir), "12 hours", "6 hours"), "complete", "sliding")
    return rows.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOURS THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
          s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
          SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOURS AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.sessions(_events(spark, sf_dir), "8 hours"), "complete", "sessions").drop("batch")


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events WHERE value IS NOT NULL)
          SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM r WHERE b <= 10 GROUP BY user_id""")
def stream_last_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.drained(streams.last_values(_events(spark, sf_dir)), "update", "last-values")
    last = rows.withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("batch")))).filter("k = 1")
    return last.select("user_id", "n", F.round("mean", 6).alias("mean"))


@query("SELECT event_id, user_id, round(CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE value / 50 END, 6) AS correctness FROM events")
def stream_turn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns go to a log and are scored from there."""
    log, scores, progress = (fresh_folder(spark, f"turn-{x}") for x in ("log", "scores", "progress"))
    correct = F.round(F.least(F.lit(1.0), F.col("value") / 50), 6)
    streams.logged(
        _events(spark, sf_dir),
        log,
        lambda t: t.select("event_id", "user_id", correct.alias("correctness")),
        scores,
        progress,
    ).awaitTermination()
    return spark.read.parquet(scores).drop("batch")


@query("SELECT DISTINCT event_type, event_type || '!' AS answer FROM events")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that was done before a lost checkpoint isn't done again."""
    out = fresh_folder(spark, "resumed")
    for _ in range(2):
        keys = _events(spark, sf_dir).select("event_type")
        streams.generate_once(
            keys,
            "event_type",
            lambda b: b.withColumn("answer", F.concat("event_type", F.lit("!"))),
            out,
            fresh_folder(spark, "resumed-progress"),
        ).awaitTermination()
    return streams.generated(spark, out)


@query("SELECT event_type AS key, upper(event_type) AS result, count(*) - 1 AS hits, CAST(1 AS BIGINT) AS lookups FROM events GROUP BY event_type")
def stream_cached_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key is looked up once, and found in the cache from then on."""
    looked_up = streams.cached_lookups(_events(spark, sf_dir), "event_type", str.upper, 6 * 3600, evict=False)
    rows = streams.drained(looked_up, "append", "lookups")
    return rows.groupBy("key", "result").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("lookups"))
