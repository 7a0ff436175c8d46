"""Registered queries: scored turns and their summaries, policies, caches.  Events stand for turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.functions import rules, text
from tarnfell.operators import catalog, metrics, policy
from tarnfell.plans.registry import query
from tarnfell.plans.shared import KEYWORDS, SQL_TIERED, parts, sql_tier, table

_VALUES = (*metrics.TURN_AVERAGES, *metrics.SCORED_AVERAGES, "field_agreement")
_FIELDS = {
    name: f"CASE WHEN (event_id + {i}) % 11 <> 0 THEN CAST((event_id * {i + 3}) % 101 AS DOUBLE) / 101 END"
    for i, name in enumerate(_VALUES)
}
_SOURCES = {s: f"event_id % {i + 2} = 0" for i, s in enumerate(metrics.SOURCES)}
_TURN = {
    "category": "CASE WHEN event_type <> 'signup' THEN event_type END",
    "pipeline": "CASE WHEN event_id % 5 <> 0 THEN concat('p', CAST(event_id % 3 AS VARCHAR(9))) END",
    "correctness": "CASE WHEN event_id % 7 <> 0 THEN least(CAST(1 AS DOUBLE), value / 100) END",
    "error": "CASE WHEN event_id % 13 = 0 THEN 'failed' END",
    "kg_changed_top": "event_id % 4 = 0",
    "live_price": "CASE WHEN event_id % 9 = 0 THEN value END",
    "predicted": "value >= 40",
    "actual": "event_id % 3 = 0",
    **_FIELDS,
}
_TURNS = f"(SELECT event_id, user_id, {', '.join(f'{sql} AS {name}' for name, sql in {**_TURN, **{f'from_{s}': sql for s, sql in _SOURCES.items()}}.items())} FROM events)"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumns({name: F.expr(sql) for name, sql in _TURN.items()})
    return rows.withColumn("attribution", F.struct(*[F.expr(sql).alias(s) for s, sql in _SOURCES.items()]))


_AVERAGES = ", ".join(
    [
        *(f"round(avg({n}) FILTER (correctness IS NOT NULL), 4) AS avg_{n}" for n in metrics.SCORED_AVERAGES),
        *(f"round(avg({n}), 4) AS avg_{n}" for n in metrics.TURN_AVERAGES),
    ]
)


@query(f"""WITH t AS {_TURNS}, s AS (SELECT * FROM t WHERE correctness IS NOT NULL),
           c AS (SELECT count(*) AS classified, count(*) FILTER (predicted AND actual) AS tp, count(*) FILTER (predicted AND NOT actual) AS fp, count(*) FILTER (NOT predicted AND actual) AS fn, count(*) FILTER (NOT predicted AND NOT actual) AS tn FROM s),
           r AS (SELECT *, round((tp + tn)::DOUBLE / classified, 4) AS accuracy, round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS recall, round((tp + fp)::DOUBLE / classified, 4) AS positive_rate FROM c)
           SELECT o.*, r.*, CASE WHEN precision > 0 AND recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) END AS f1 FROM (
             SELECT count(*) AS total_turns, count(correctness) AS gt_scored, count(*) FILTER (error IS NULL AND correctness IS NULL) AS unscored_no_gt, count(error) AS errors,
             round(avg(correctness), 4) AS avg_correctness, round(stddev_pop(correctness), 4) AS std_correctness, round(min(correctness), 4) AS min_correctness, round(max(correctness), 4) AS max_correctness,
             {_AVERAGES}, round((count(*) FILTER (correctness IS NOT NULL AND kg_changed_top))::DOUBLE / count(correctness), 4) AS kg_changed_top_rate, count(live_price) AS live_price_hits,
             {', '.join(f'count(*) FILTER (from_{s}) AS attributed_{s}' for s in metrics.SOURCES)} FROM t) o, r""")
def overall_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overall(_turns(spark, sf_dir), F.col("predicted"), F.col("actual"))


@query(f"""SELECT coalesce(category, pipeline, 'unknown') AS category, count(*) AS n, count(correctness) AS n_scored, round(avg(correctness), 4) AS avg_correctness,
           {', '.join(f'round(avg({c}) FILTER (correctness IS NOT NULL), 4) AS {n}' for c, n in (('field_agreement', 'avg_fa'), ('field_agreement_frac', 'avg_fa_frac'), ('price_closeness', 'avg_pc')))},
           round(avg(judge_avg), 4) AS avg_judge, round(avg(faithfulness), 4) AS avg_faithfulness, round(avg(answer_relevancy), 4) AS avg_ar FROM {_TURNS} GROUP BY 1""")
def category_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.category_summary(_turns(spark, sf_dir))


@query(f"SELECT round(avg(faithfulness), 3) AS faithfulness, round(avg(answer_relevancy), 3) AS answer_relevancy FROM {_TURNS}")
def metric_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("faithfulness", "answer_relevancy")
    return _turns(spark, sf_dir).agg(*[F.round(F.avg(n), 3).alias(n) for n in names])


@query(f"""WITH t AS (SELECT event_id, correctness FROM {_TURNS} WHERE correctness IS NOT NULL)
           SELECT * FROM (SELECT event_id, correctness, 'best' AS side, CAST(row_number() OVER (ORDER BY correctness DESC, event_id DESC) AS INT) AS place FROM t) WHERE place <= 5
           UNION ALL SELECT * FROM (SELECT event_id, correctness, 'worst', CAST(row_number() OVER (ORDER BY correctness, event_id) AS INT) AS place FROM t) WHERE place <= 5""")
def best_and_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.extremes(_turns(spark, sf_dir).select("event_id", "correctness"), "correctness", ["event_id"])


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 25")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_turns(table(spark, sf_dir, "events"), ["ts", "event_id"], 25).select("event_id", "user_id")


_CRITERIA = ", ".join(f"CAST((doc_id * {i + 2}) % 6 AS DOUBLE) AS {c}" for i, c in enumerate(rules.JUDGE_FIELDS))
_GIVEN = f"list_filter([{', '.join(rules.JUDGE_FIELDS)}], lambda x: x > 0)"


@query(f"""SELECT doc_id, CASE WHEN len(g) > 0 THEN round(list_avg(g), 2) ELSE 0 END AS judge_avg, coalesce(list_max(g), 0) AS judge_max, coalesce(list_min(g), 0) AS judge_min, CAST(len(g) AS INT) AS n_criteria,
           round((comprehensiveness + factual_accuracy + specificity) / 3, 2) AS retrieval_quality, round((directness + coherence + conciseness + helpfulness) / 4, 2) AS answer_quality
           FROM (SELECT *, {_GIVEN} AS g FROM (SELECT doc_id, {_CRITERIA} FROM documents))""")
def judge_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = [((F.col("doc_id") * (i + 2)) % 6).alias(c) for i, c in enumerate(rules.JUDGE_FIELDS)]
    return metrics.composites(table(spark, sf_dir, "documents").select("doc_id", *criteria), ["doc_id"])


_CASES = "(SELECT event_type AS action, CAST((event_id % 50) + 50 AS DOUBLE) / 100 AS s, least(CAST(1 AS DOUBLE), value / 60) AS r FROM events)"
_GOOD = f"(SELECT * FROM {_CASES} WHERE s >= 0.65 AND r >= 0.7)"


@query(f"""WITH a AS (SELECT action, round(sum(s * r) / sum(s), 6) AS w, count(*) AS n, round(sum(s), 6) AS m FROM {_GOOD} GROUP BY action)
           SELECT 'similarity_weighted_reward' AS policy, (SELECT action FROM a ORDER BY w DESC, m DESC, action LIMIT 1) AS selected_action, (SELECT count(*) FROM {_GOOD}) AS similar_case_count,
                  (SELECT string_agg(action || ' ' || n, ',' ORDER BY w DESC, m DESC, action) FROM a) AS candidates""")
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("action"),
        ((F.col("event_id") % 50 + 50) / 100).alias("s"),
        F.least(F.lit(1.0), F.col("value") / 60).alias("r"),
    )
    found = policy.summary(cases, F.col("action"), "s", "r", "default")
    listed = F.array_join(F.transform("candidate_actions", lambda c: F.concat_ws(" ", c["action"], c["case_count"].cast("string"))), ",")
    return found.select("policy", "selected_action", "similar_case_count", listed.alias("candidates"))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'cached' ELSE {sql_tier('lower(description)', KEYWORDS['f1'])} END AS f1, p_partkey % 3 = 0 AS cached FROM {SQL_TIERED}""")
def cached_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the descriptions has its tier in a cache; the others' is worked out."""
    rows = parts(spark, sf_dir).withColumn("key", F.concat_ws("/", "description", "p_partkey"))
    cache = rows.filter("p_partkey % 3 = 0").select("key", F.lit("cached").alias("f1"))
    return catalog.cached_or(
        rows,
        cache,
        "key",
        {"f1": text.tier(F.col("description"), KEYWORDS["f1"])},
    ).select("p_partkey", "f1", "cached")


_KEY = "concat('a:', p_type, '|b:', CAST({0} AS VARCHAR(9)))"


@query(f"""WITH g AS (SELECT {_KEY.format('p_size % 4')} AS combo_key, p_name AS answer, row_number() OVER (PARTITION BY p_type, p_size % 4 ORDER BY p_partkey) AS n FROM part WHERE p_size < 20)
           SELECT s_suppkey, k AS combo_key, answer FROM (SELECT s_suppkey, {_KEY.format('s_suppkey % 6').replace('p_type', "CASE s_suppkey % 3 WHEN 0 THEN 'SMALL' WHEN 1 THEN 'PROMO' ELSE 'LARGE' END")} AS k FROM supplier) LEFT JOIN (SELECT * FROM g WHERE n = 1) ON combo_key = k""")
def ground_truth_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements meet the first stored answer of their combination, if there is one."""
    stored = table(spark, sf_dir, "part").filter("p_size < 20").select(
        F.expr(_KEY.format("p_size % 4")).alias("combo_key"),
        F.col("p_name").alias("answer"),
        "p_partkey",
    )
    kind = F.when(F.col("s_suppkey") % 3 == 0, "SMALL").when(F.col("s_suppkey") % 3 == 1, "PROMO").otherwise("LARGE")
    asked = table(spark, sf_dir, "supplier").withColumn("p_type", kind).select(
        "s_suppkey",
        F.expr(_KEY.format("s_suppkey % 6")).alias("combo_key"),
    )
    first = catalog.first_by(stored, ["combo_key"], [F.col("p_partkey")]).drop("p_partkey")
    return asked.join(first, "combo_key", "left").select("s_suppkey", "combo_key", "answer")
