"""Registered queries: the jobs, each run twice into a folder of its own; what stands there is the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import build_index, grade_conversations
from tarnfell.operators.lineage import fresh_folder
from tarnfell.plans.registry import query
from tarnfell.plans.retrieval_queries import _WORDS


@query(f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
    n AS (SELECT avg(len(w)) AS avgdl FROM d),
    p AS (SELECT doc_id, term, dl, CAST(count(*) AS INT) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL)
    SELECT term, doc_id, tf, round(tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)), 9) AS weight FROM p, n""")
def job1_build_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_folder(spark, "job1-index")
    for _ in range(2):
        build_index.run(spark, f"{sf_dir}/documents.parquet", out, keep=["n_chars", "lang"], buckets=16)
    return build_index.read(spark, out).select("term", F.col("id").alias("doc_id"), "tf", F.round("weight", 9).alias("weight"))


_FLAG, _CONFIRM = "blean", "onth"


@query(f"""
    WITH m AS (SELECT *, coalesce(role = 'user' AND contains(lower(text), '{_FLAG}'), false) AS bad, coalesce(role = 'assistant' AND contains(lower(text), '{_CONFIRM}'), false) AS done,
                      {{'turn': turn, 'role': role}} AS place FROM conversations),
    f AS (SELECT *, coalesce(min(place) FILTER (bad) OVER c < place, false) AS ended, coalesce(min(place) FILTER (done) OVER c < place, false) AS found FROM m WINDOW c AS (PARTITION BY conv_id))
    SELECT conv_id, turn, role, substr(sha256(CAST(to_json([CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), role, text]) AS VARCHAR)), 1, 20) AS key, CAST(coalesce(len({_WORDS}), 0) AS BIGINT) AS n_words,
           CASE WHEN ended THEN 'end' WHEN found THEN 'followup' ELSE 'gather' END AS phase,
           CASE WHEN ended OR bad THEN 'end' WHEN found OR done THEN 'followup' ELSE 'gather' END AS next_phase,
           CASE WHEN ended THEN 'ignored' WHEN bad THEN 'flagged' WHEN found THEN 'followup' WHEN done THEN 'recommend' ELSE 'gather' END AS step FROM f""")
def job2_grade_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, progress = fresh_folder(spark, "job2-graded"), fresh_folder(spark, "job2-progress")
    for _ in range(2):
        grade_conversations.run(spark, f"{sf_dir}/conversations*.parquet", out, progress, _FLAG, _CONFIRM)
    return grade_conversations.read(spark, out).drop("batch")
