"""Registered queries: catalogue clean-up, statistics, matching, metrics, policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.functions import rules, text
from tarnfell.operators import catalog, match, metrics, policy
from tarnfell.operators.lineage import spread
from tarnfell.plans.registry import query
from tarnfell.plans.shared import DIMS, SQL_RANGES, SQL_TIERED, parts, table, tiered

#: Lines of orders that a task sorts as ranked lists.
LISTED = 1 << 17

_TIER_VALUE = "CASE t WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END"


@query(f"""SELECT feature, CAST(count(*) FILTER (t = 'low') AS BIGINT) AS low, CAST(count(*) FILTER (t = 'medium') AS BIGINT) AS medium, CAST(count(*) FILTER (t = 'high') AS BIGINT) AS high, count(*) AS total, round(avg({_TIER_VALUE}), 6) AS mean_tier
           FROM (UNPIVOT (SELECT {', '.join(DIMS)} FROM {SQL_TIERED}) ON {', '.join(DIMS)} INTO NAME feature VALUE t) GROUP BY feature""")
def tier_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tier_distribution(tiered(spark, sf_dir), DIMS).withColumn("mean_tier", F.round("mean_tier", 6))


@query("SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS id, p_partkey, p_name FROM part WHERE p_type = 'SMALL' AND p_retailprice > 0")
def category_filter_reid(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "part").filter("p_type = 'SMALL' and p_retailprice > 0").select("p_partkey", "p_name")
    return catalog.renumber(kept, ["p_partkey"]).select("id", "p_partkey", "p_name")


@query("SELECT p_type AS category, count(*) AS n FROM part GROUP BY p_type")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT p_partkey AS pos, p_name || ' ' || p_brand AS d, p_name AS n, p_retailprice AS v FROM part WHERE p_partkey % 2 = 0),
          d AS (SELECT d, max_by(v, pos) AS v FROM r GROUP BY d), n AS (SELECT n, max_by(v, pos) AS v FROM r GROUP BY n)
          SELECT p_partkey, coalesce(d.v, n.v, -1.0) AS found_price FROM part LEFT JOIN d ON d.d = p_name || ' ' || p_brand LEFT JOIN n ON n.n = p_name""")
def fallback_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat_ws(" ", "p_name", "p_brand").alias("both"),
        F.col("p_name").alias("only"),
        F.col("p_retailprice").alias("price"),
    )
    right = p.filter("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "pos")
    found = catalog.fallback_lookup(p.drop("price"), right, ["both", "only"], F.col("pos"), ["price"], {"price": F.lit(-1.0)})
    return found.select("p_partkey", "found_price")


_PRICE = "p_retailprice"


@query(f"SELECT count({_PRICE}) AS n, min({_PRICE}) AS min_price, max({_PRICE}) AS max_price, round(avg({_PRICE}), 6) AS mean_price, median({_PRICE}) AS median_price, round(stddev_samp({_PRICE}), 6) AS stdev_price FROM part WHERE {_PRICE} > 0")
def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.price_stats(table(spark, sf_dir, "part"), _PRICE).withColumns({c: F.round(c, 6) for c in ("mean_price", "stdev_price")})


@query(f"SELECT n, p[n // 3 + 1] AS p_1_3, p[2 * n // 3 + 1] AS p_2_3, p[n // 4 + 1] AS p_1_4, p[3 * n // 4 + 1] AS p_3_4 FROM (SELECT count(*) AS n, list({_PRICE} ORDER BY {_PRICE}) AS p FROM part)")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.order_statistics(table(spark, sf_dir, "part"), _PRICE)


@query(f"SELECT tier, low, high FROM {SQL_RANGES}")
def budget_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.budget_ranges(table(spark, sf_dir, "part"), _PRICE, 950.0)


@query("SELECT CASE WHEN o_totalprice < 0 THEN 'flagship' WHEN o_totalprice < 50000 THEN 'budget' WHEN o_totalprice < 100000 THEN 'mid' WHEN o_totalprice < 200000 THEN 'premium' ELSE 'flagship' END AS band, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(text.price_band(F.col("o_totalprice")).alias("band"), "o_totalprice")
    return rows.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


_GRID = "(SELECT *, " + " || '|' || ".join(f"'{d}:' || {d}" for d in DIMS) + " || '|Budget:' || budget_tier AS combo_key FROM " + ", ".join(
    f"(SELECT unnest(['low', 'medium', 'high']) AS {d})" for d in (*DIMS, "budget_tier")
) + ")"


@query(f"SELECT * FROM {_GRID}")
def combo_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.combo_grid(spark, DIMS)


_AGREE = " + ".join(f"CAST(x.{d} = g.{d} AS INT)" for d in DIMS)
#: Ranges of which the high one holds no part, so that the fallback to the whole pool is used.
_MATCH_RANGES = "(SELECT unnest([{'tier': 'low', 'low': 900.0, 'high': 930.0}, {'tier': 'medium', 'low': 930.0, 'high': 960.0}, {'tier': 'high', 'low': 5000.0, 'high': 9000.0}], recursive := true))"
_MATCH = f"""WITH x AS (SELECT * FROM {SQL_TIERED}), r AS (SELECT * FROM {_MATCH_RANGES}),
    has AS (SELECT tier FROM r WHERE EXISTS (SELECT 1 FROM x WHERE p_retailprice BETWEEN low AND high)),
    m AS (SELECT g.combo_key, x.p_partkey, {_AGREE} AS match_score, g.budget_tier IN (SELECT tier FROM has) AS within_budget
          FROM {_GRID} g JOIN r ON r.tier = g.budget_tier JOIN x ON x.p_retailprice BETWEEN r.low AND r.high OR g.budget_tier NOT IN (SELECT tier FROM has))
    SELECT combo_key, p_partkey, match_score, within_budget FROM (SELECT *, row_number() OVER (PARTITION BY combo_key ORDER BY match_score DESC, p_partkey) AS n FROM m) WHERE n = 1"""


def _ranges(spark: SparkSession) -> DataFrame:
    rows = [("low", 900.0, 930.0), ("medium", 930.0, 960.0), ("high", 5000.0, 9000.0)]
    return spark.range(1).select(
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(a).alias("low"), F.lit(z).alias("high")) for t, a, z in rows])
        ).alias("r")
    ).select("r.*")


@query(_MATCH)
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.best_match_direct(match.combo_grid(spark, DIMS), tiered(spark, sf_dir), _ranges(spark), DIMS, "p_partkey", _PRICE)


@query(_MATCH)
def best_match_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.best_match(match.combo_grid(spark, DIMS), tiered(spark, sf_dir), _ranges(spark), DIMS, "p_partkey", _PRICE)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return catalog.resume(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("""WITH v AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0), s AS (SELECT avg(c_acctbal) AS m, median(c_acctbal) AS d FROM v),
          u AS (SELECT * FROM (SELECT *, 'expensive' AS price_group, 0 AS g FROM v ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 10)
                UNION ALL SELECT * FROM (SELECT v.*, 'mean_range', 1 FROM v, s ORDER BY abs(c_acctbal - m), c_custkey LIMIT 10)
                UNION ALL SELECT * FROM (SELECT v.*, 'median_range', 2 FROM v, s ORDER BY abs(c_acctbal - d), c_custkey LIMIT 10)
                UNION ALL SELECT * FROM (SELECT *, 'cheapest', 3 FROM v ORDER BY c_acctbal, c_custkey LIMIT 10))
          SELECT c_custkey, c_name, c_acctbal, price_group FROM (SELECT *, row_number() OVER (PARTITION BY c_name ORDER BY g, CASE g WHEN 0 THEN c_acctbal ELSE 0 END, c_custkey) AS n FROM u) WHERE n = 1""")
def representative_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.representative(table(spark, sf_dir, "customer"), "c_custkey", "c_name", "c_acctbal", 10)


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS first FROM documents) ORDER BY turn, first LIMIT 50""")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.stratified(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 50)


@query("SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 100)


@query("SELECT p_type, count(*) AS total, count(DISTINCT p_name) AS names, count(DISTINCT CASE WHEN p_size > 10 THEN p_brand END) AS brands FROM part GROUP BY p_type")
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("p_name").alias("names"),
        F.countDistinct(F.when(F.col("p_size") > 10, F.col("p_brand"))).alias("brands"),
    )


@query("SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter("l_partkey is not null")
    return catalog.first_by(
        rows,
        ["l_partkey"],
        [F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_extendedprice")],
    ).select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


# ------------------------------------------------------------------------------------------------------------ metrics


@query("""WITH r AS (SELECT l_orderkey, l_linenumber AS rank, least(1.0::DOUBLE, floor(l_quantity / 10) / 4) AS rel, l_returnflag = 'A' AS hit, l_extendedprice FROM lineitem WHERE l_linenumber <= 10),
          k AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY rank, l_extendedprice) AS INT) AS rank, rel, hit FROM r),
          b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rel DESC, rank) AS best FROM k WHERE rank <= 10),
          a AS (SELECT l_orderkey, min(rank) FILTER (rel >= 1) AS f, count(*) FILTER (rel >= 1) AS c, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(best + 1)) AS idcg, max(rank) FILTER (hit) AS e FROM b GROUP BY l_orderkey)
          SELECT l_orderkey, CASE WHEN f IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS recall_at_k, round(CAST(c AS DOUBLE) / 10, 4) AS precision_at_k, coalesce(round(1::DOUBLE / f, 4), 0) AS mrr,
                 CASE WHEN idcg > 0 THEN round(dcg / idcg, 4) ELSE 0 END AS ndcg_at_k, f AS first_relevant_rank, e AS exact_rank, c AS relevant_in_top_k FROM a""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines stand for a ranked list."""
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 10")
    li = spread(li.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag"), "l_orderkey", rows=LISTED)
    rows = li.withColumn("rank", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice")))
    return metrics.ranking(
        rows,
        ["l_orderkey"],
        "rank",
        F.least(F.lit(1.0), F.floor(F.col("l_quantity") / 10) / 4),
        F.col("l_returnflag") == "A",
    )


_CORRECT = "0.7::DOUBLE * least(1.0::DOUBLE, (l_linenumber % 6) / CASE WHEN l_linenumber % 4 = 0 THEN 5 ELSE l_linenumber % 4 + 2 END) + 0.3::DOUBLE * greatest(0.0::DOUBLE, 1 - abs(l_extendedprice / l_quantity - p_retailprice) / 2000.0)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round({_CORRECT}, 8) AS correctness FROM lineitem JOIN part ON p_partkey = l_partkey")
def correctness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    n = F.col("l_linenumber")
    ceiling = F.when(n % 4 == 0, F.lit(None)).otherwise(n % 4 + 2)
    close = text.price_closeness(F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice"), F.lit(0.0), F.lit(2000.0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round(text.correctness(n % 6, ceiling, close), 8).alias("correctness"))


@query("""WITH c AS (SELECT lang, n_chars >= 1500 AS p, coalesce(quality = 1, false) AS a FROM documents LEFT JOIN labels USING (doc_id)),
          k AS (SELECT lang, count(*) AS n, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM c GROUP BY lang),
          m AS (SELECT *, round((tp + tn)::DOUBLE / n, 4) AS accuracy, round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS recall, round((tp + fp)::DOUBLE / n, 4) AS positive_rate FROM k)
          SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) END AS f1 FROM m""")
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return metrics.binary(rows, F.col("n_chars") >= 1500, F.col("quality") == 1, ["lang"])


@query("""WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events WHERE event_type <> 'error')
          SELECT user_id, round(avg(value) FILTER (b <= 1), 4) AS last_1, round(avg(value) FILTER (b <= 5), 4) AS last_5_avg, round(avg(value) FILTER (b <= 10), 4) AS last_10_avg FROM r WHERE b <= 10 GROUP BY user_id""")
def recency_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return metrics.recency(rows, ["user_id"], ["ts", "event_id"], "value")


@query("SELECT coalesce(CASE WHEN event_type <> 'signup' THEN event_type END, 'unknown') AS category, count(*) AS n, round(avg(value), 4) AS value_avg, CASE WHEN count(value) >= 2 THEN round(stddev_pop(value), 4) END AS value_std FROM events GROUP BY 1")
def category_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_category(
        table(spark, sf_dir, "events"),
        F.when(F.col("event_type") != "signup", F.col("event_type")),
        {"value": "value"},
    )


@query("""WITH c AS (SELECT event_type AS pipeline, CASE WHEN event_id % 7 <> 0 THEN least(1.0, value / 100) END AS c FROM events)
          SELECT pipeline, count(*) AS total, count(c) AS scored, count(*) - count(c) AS unscored, round(avg(c), 4) AS avg_correctness, round(min(c), 4) AS min_correctness, round(max(c), 4) AS max_correctness,
                 count(*) FILTER (c >= 0.65) AS high_quality, round((count(*) FILTER (c >= 0.65))::DOUBLE / nullif(count(c), 0), 4) AS high_quality_rate FROM c GROUP BY pipeline""")
def case_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("pipeline"),
        F.when(F.col("event_id") % 7 != 0, F.least(F.lit(1.0), F.col("value") / 100)).alias("c"),
    )
    return metrics.case_stats(rows, "c", ["pipeline"])


@query("""SELECT action, round(sum(s * r) / sum(s), 6) AS weighted_reward, count(*) AS case_count, round(sum(s), 6) AS similarity_mass
          FROM (SELECT CASE WHEN event_type <> 'error' THEN event_type END AS action, least(1.0, value / 50) - 0.1 AS s, least(1.0, value / 100) AS r FROM events) WHERE action IS NOT NULL AND s > 0 GROUP BY action""")
def weighted_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumns(
        {"s": F.least(F.lit(1.0), F.col("value") / 50) - 0.1, "r": F.least(F.lit(1.0), F.col("value") / 100)}
    )
    return policy.action_rewards(rows, F.when(F.col("event_type") != "error", F.col("event_type")), "s", "r")


@query("SELECT doc_id, md5(lower(text)) AS key, len(regexp_extract_all(text, '[a-z0-9]+')) AS score FROM documents")
def qa_dedupe_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each different text is scored once and the score is joined back."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.md5(F.lower("text").cast("binary")).alias("key"))
    once = rows.dropDuplicates(["text"]).select(
        "text",
        F.size(F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0))).cast("long").alias("score"),
    )
    return rows.join(once, "text").select("doc_id", "key", "score")


@query("""WITH s AS (SELECT doc_id, [CAST(quality * 7 AS DOUBLE), CAST((doc_id % 10) AS DOUBLE), CAST(toxic * 3 AS DOUBLE)] AS v FROM labels), g AS (SELECT doc_id, v, list_filter(v, lambda x: x > 0) AS p FROM s)
          SELECT doc_id, CASE WHEN len(p) > 0 THEN round(list_avg(p), 4) END AS judge_avg, list_min(p) AS judge_min, list_max(p) AS judge_max, round(list_avg(v), 4) AS composite FROM g""")
def judge_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select(
        "doc_id",
        (F.col("quality") * 7).alias("a"),
        (F.col("doc_id") % 10).alias("b"),
        (F.col("toxic") * 3).alias("c"),
    )
    return metrics.judge(rows, ["doc_id"], ["a", "b", "c"])


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal <= CASE WHEN s_suppkey % 3 = 0 THEN 10000000 ELSE 5000 END AND s_acctbal BETWEEN -500 AND 9000")
def budget_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = text.limit(F.when(F.col("s_suppkey") % 3 == 0, F.lit(0)).otherwise(5000))
    return table(spark, sf_dir, "supplier").filter(
        (F.col("s_acctbal") <= budget)
        & F.col("s_acctbal").between(-500, 9000)
    ).select("s_suppkey", "s_acctbal")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)")
def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ids = lambda condition: o.filter(condition).select(F.col("o_custkey").alias("c_custkey"))
    both = ids("o_orderstatus = 'F'").intersect(ids("o_orderpriority = '1-URGENT'"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(both, "c_custkey", "left_semi").join(
        ids("o_totalprice > 490000").distinct(),
        "c_custkey",
        "left_anti",
    )
