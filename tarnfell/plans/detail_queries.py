"""Registered queries: searches over parameters, requirements, budgets, batches, and formats that readers and writers share."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.functions import text
from tarnfell.operators import catalog, policy
from tarnfell.operators.lineage import fresh_folder
from tarnfell.plans.registry import query
from tarnfell.plans.shared import table
from tarnfell.sources import readers, sinks

# ------------------------------------------------------------------------------------------------- parameters

STAGES = [(("kg_weight",), [0.0, 0.2, 0.3, 0.4, 1.0]), (("dense_top_k", "sparse_top_k"), [10, 25, 40]), (("reranker",), [True, False]), (("kg_weight",), [0.3, 0.6, 0.5])]


def _sql_staged() -> str:
    """Stage by stage: every value in the place of the best so far, the figure of each, and the first of the best."""
    figure = """(SELECT round(avg(CASE WHEN p_size <= x.dense_top_k THEN x.kg_weight * p_size / 50 + (1 - x.kg_weight) * (p_retailprice % 100) / 100 ELSE 0.0::DOUBLE END) - CASE WHEN x.reranker THEN 0.01 ELSE 0 END, 4)
                 FROM part WHERE p_brand = x.question AND p_size > x.sparse_top_k - 24)"""
    steps = ["x0 AS (SELECT DISTINCT p_brand AS question, 0.3::DOUBLE AS kg_weight, 20 AS dense_top_k, 20 AS sparse_top_k, true AS reranker FROM part)", f"b0 AS (SELECT *, {figure} AS figure FROM x0 AS x)"]
    for i, (columns, values) in enumerate(STAGES, 1):
        listed = ", ".join(f"{{'n': {n}, 'v': {str(v).lower()}}}" for n, v in enumerate(values))
        swap = ", ".join(f"{'v' if c != 'kg_weight' else 'v::DOUBLE'} AS {c}" for c in columns)
        steps.append(f"x{i} AS (SELECT b.* EXCLUDE (figure) REPLACE ({swap}), n FROM b{i - 1} b, (SELECT unnest([{listed}], recursive := true)))")
        steps.append(f"""f{i} AS (SELECT *, {figure} AS figure FROM x{i} AS x),
            b{i} AS (SELECT * EXCLUDE (n, r) FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY figure DESC, abs(kg_weight - 0.3), n) AS r FROM f{i} WHERE figure IS NOT NULL) WHERE r = 1
                     UNION ALL SELECT * FROM b{i - 1} WHERE question NOT IN (SELECT question FROM f{i} WHERE figure IS NOT NULL))""")
    return f"WITH {', '.join(steps)} SELECT * FROM b{len(STAGES)}"


@query(_sql_staged())
def staged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best parameters for every brand, by staged coordinate descent, all brands together."""
    parts = table(spark, sf_dir, "part")
    first = [F.lit(0.3).alias("kg_weight"), F.lit(20).alias("dense_top_k"), F.lit(20).alias("sparse_top_k"), F.lit(True).alias("reranker")]
    start = parts.select(F.col("p_brand").alias("question")).distinct().select("question", *first)

    def evaluate(trials: DataFrame) -> DataFrame:
        size, w = F.col("p_size"), F.col("kg_weight")
        good = F.when(size <= F.col("dense_top_k"), w * size / 50 + (1 - w) * (F.col("p_retailprice") % 100) / 100).otherwise(0.0)
        met = trials.join(parts, (F.col("p_brand") == F.col("question")) & (size > F.col("sparse_top_k") - 24), "left")
        figure = F.round(F.avg(F.when(size.isNotNull(), good)) - F.when(F.col("reranker"), 0.01).otherwise(0.0), 4)
        return met.groupBy(*trials.columns).agg(figure.alias("figure"))

    return policy.staged(start, "question", STAGES, evaluate, ("kg_weight", 0.3))[0]


# ------------------------------------------------------------------------------------------------- texts and numbers


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'medium' END AS tier,
                 CAST(CASE WHEN p_size % 5 = 0 THEN 1000 * p_size + 25000 WHEN p_size % 5 = 1 THEN 30000 + p_size WHEN p_size % 5 = 2 THEN p_size ELSE 0 END AS BIGINT) AS budget FROM part""")
def sane_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model says of a request: tiers that aren't any, budgets with signs, too small or no numbers, and texts that name one."""
    n, size = F.col("p_size") % 5, F.col("p_size")
    tier = F.element_at(F.array(F.lit("LOW"), F.lit(None).cast("string"), F.lit("High"), F.lit("huge")), (size % 4 + 1).cast("int"))
    stated = F.when(n == 0, F.concat(F.lit("₹ "), F.format_number(1000 * size + 25000, 0))).when(n == 2, size.cast("string")).when(n == 3, "12.5").otherwise(F.lit(None))
    said = F.when(n == 1, F.concat(F.lit("up to 26,000 or "), F.format_number(30000 + size, 0))).otherwise("some 9,999 or ,,,,,")
    return table(spark, sf_dir, "part").select("p_partkey", text.sane_tier(tier).alias("tier"), text.sane_budget(stated, said).alias("budget"))


@query("""SELECT doc_id, array_to_string(list_filter([trim(regexp_replace(trim(l, ' '), '^[0-9.)\\-\\s]+', ''), ' ') for l in string_split(said, chr(10))], lambda x: length(x) > 8 AND NOT starts_with(x, 'Error:'))[1:10], '|') AS questions
          FROM (SELECT doc_id, '1. ' || replace(text, '. ', '?' || chr(10) || '2) - ') || chr(10) || 'Error: no answer came' || chr(10) || '3. short' AS said FROM documents)""")
def question_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered lines of an answer as questions, without errors and what is too short."""
    said = F.concat(F.lit("1. "), F.replace("text", F.lit(". "), F.lit("?\n2) - ")), F.lit("\nError: no answer came\n3. short"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.usable_questions(said, 10), "|").alias("questions"))


@query("""SELECT p_partkey, CASE WHEN p_retailprice <= a THEN 'low' WHEN p_retailprice <= b THEN 'medium' ELSE 'high' END AS tier, CAST(greatest(1, 12 // greatest(1, p_size % 15)) AS INT) AS batch
          FROM part, (SELECT quantile_disc(p_retailprice, 0.25) AS a, quantile_disc(p_retailprice, 0.75) AS b FROM part)""")
def budget_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price's tier between two bounds of the catalogue, and how many items of some size a call takes."""
    parts = table(spark, sf_dir, "part")
    a, b = (F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY p_retailprice)") for q in (0.25, 0.75))
    bounds = parts.agg(a.alias("a"), b.alias("b")).first()
    tier = text.budget_tier(F.col("p_retailprice"), F.lit(bounds[0]), F.lit(bounds[1]))
    return parts.select("p_partkey", tier.alias("tier"), text.batch_size(F.lit(12), F.col("p_size") % 15).alias("batch"))


# ------------------------------------------------------------------------------------------------- formats


@query("""SELECT CAST(r AS BIGINT) AS pos, d.doc_id, length(d.text) AS size FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, text FROM documents WHERE doc_id % 3 = 0) d
          UNION ALL SELECT -1, -1, NULL""")
def io_docstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index's positions lead to document ids, and these to documents; one of which isn't there."""
    path = fresh_folder(spark, "io-docstore")
    docs = table(spark, sf_dir, "documents").filter("doc_id % 3 = 0").select("doc_id", "text")
    ranked = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    ids = catalog.renumber(ranked, [F.col("doc_id")], "pos").select("pos", "doc_id")
    ids.unionByName(spark.createDataFrame([(-1, -1)], "pos long, doc_id long")).write.parquet(f"{path}/positions")
    docs.write.parquet(f"{path}/documents")
    found = readers.docstore(spark.read.parquet(f"{path}/positions"), spark.read.parquet(f"{path}/documents"), missing=True)
    return found.select("pos", "doc_id", F.length("text").cast("long").alias("size"))


@query("SELECT 'c' || n_regionkey AS category, n_name AS question FROM nation")
def io_json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that holds one JSON array of questions."""
    path = fresh_folder(spark, "io-array")
    one = F.struct(F.concat(F.lit("c"), F.col("n_regionkey").cast("string")).alias("category"), F.col("n_name").alias("question"))
    table(spark, sf_dir, "nation").agg(F.to_json(F.collect_list(one)).alias("value")).coalesce(1).write.text(path)
    return readers.json_array(spark, path, "category string, question string")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0")
def io_jsonl_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are added to a log of JSON objects; those that are there stay."""
    path, rows = fresh_folder(spark, "io-log"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    for n in (2, 3):
        sinks.append_jsonl(rows.filter(F.col("c_custkey") % n == 0), path)
    return readers.jsonl(spark, path, "c_custkey long, c_name string").drop("seq")


@query("""WITH o AS (SELECT count(*) AS orders, max(o_orderkey) AS last FROM orders), b AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)
          SELECT CAST(n AS INT) AS line, l AS told FROM (SELECT unnest(['============================================================', rpad('orders', 44, ' ') || lpad(CAST(orders AS VARCHAR), 16, ' '), rpad('last', 44, ' ') || lpad(CAST(last AS VARCHAR), 16, ' '),
            '------------------------------------------------------------', 'best', '  {"o_orderkey": ' || k[1] || '}', '  {"o_orderkey": ' || k[2] || '}', '  {"o_orderkey": ' || k[3] || '}', '============================================================']) AS l, generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9], 1) - 1 AS n
          FROM o, (SELECT list(o_orderkey) AS k FROM b))""")
def io_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of fixed width, written and read line by line."""
    path, rows = fresh_folder(spark, "io-text"), table(spark, sf_dir, "orders")
    best = rows.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3).select("o_orderkey")
    told = sinks.report(rows.agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last")), best)
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(path)
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("line", "told"))
    return lines


@query("SELECT p_partkey, p_name AS title, CAST(p_size * 100 AS DOUBLE) AS price FROM part WHERE p_size % 3 <> 0")
def io_fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers of a service, asked batch by batch through a client that each task makes; some items have none."""

    def client():
        def ask(batch: pd.DataFrame) -> Iterable[dict]:
            some = batch[batch["p_size"] % 3 != 0]
            return ({"p_partkey": k, "title": n, "price": 100.0 * s} for k, n, s in some[["p_partkey", "p_name", "p_size"]].itertuples(index=False))

        return ask

    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return readers.fetched(rows, client, "p_partkey long, title string, price double")
