"""Registered queries: conversations, messages and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.functions import text
from tarnfell.operators import assistant, match
from tarnfell.plans.registry import query
from tarnfell.plans.shared import DIMS, SQL_TIERED, table, tiered
from tarnfell.streaming import streams

_VERDICT = "CASE WHEN length(text) % 7 = 0 THEN 'no json' ELSE concat('{\"flagged\": ', CASE WHEN length(text) % 5 = 0 THEN 'true' ELSE 'false' END, ', \"all_captured\": ', CASE WHEN length(text) % 3 = 0 THEN 'true' ELSE 'false' END, '}') END"
_REPLY = "concat(text, CASE WHEN length(text) % 2 = 0 THEN ' a budget of 75,000' ELSE ' ,,,, 12' END)"
_MARKED = "(SELECT conv_id, turn, role, role = 'user' AND length(text) % 7 <> 0 AND length(text) % 5 = 0 AS bad, role = 'assistant' AND length(text) % 7 <> 0 AND length(text) % 3 = 0 AND length(text) % 2 = 0 AND NOT regexp_matches(text, '[0-9]{4,}') AS done FROM conversations)"
_PHASES = f"""WITH m AS {_MARKED},
    e AS (SELECT *, coalesce(max(bad) OVER b, false) AS ended FROM m WINDOW b AS (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    d AS (SELECT *, done AND NOT ended AS fit FROM e),
    f AS (SELECT *, coalesce(max(fit) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS found FROM d)
    SELECT conv_id, turn, role, CASE WHEN ended THEN 'end' WHEN found THEN 'followup' ELSE 'gather' END AS phase, CASE WHEN ended OR bad THEN 'end' WHEN found OR fit THEN 'followup' ELSE 'gather' END AS next_phase,
           CASE WHEN ended THEN 'ignored' WHEN bad THEN 'flagged' WHEN found THEN 'followup' WHEN fit THEN 'recommend' ELSE 'gather' END AS step FROM f"""


def _turns(rows: DataFrame) -> DataFrame:
    """Turns with what a moderator and a checker say of them, by rules that stand in for models."""
    told = rows.withColumn("verdict", F.expr(_VERDICT)).withColumn("reply", F.expr(_REPLY))
    return told.withColumn("flagged", text.flagged(F.col("verdict"))).withColumn(
        "confirmed",
        text.confirmed(F.col("verdict"), F.col("reply")) & ~F.col("text").rlike("[0-9]{4,}"),
    )


@query(_PHASES)
def conversation_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(table(spark, sf_dir, "conversations"))
    return assistant.phases(
        rows,
        "conv_id",
        ["turn", "role"],
        F.col("flagged"),
        F.col("confirmed"),
    ).select("conv_id", "turn", "role", "phase", "next_phase", "step")


@query(f"SELECT conv_id, turn, phase, next_phase FROM ({_PHASES})")
def stream_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(f"{sf_dir}/conversations*.parquet")
    rows = _turns(stream).select("conv_id", "turn", "role", "flagged", "confirmed")
    return streams.drained(streams.conversations(rows), "append", "conversations").drop("batch")


@query("""SELECT conv_id, turn, len(h) AS n_messages, array_to_string(list_transform(h, lambda m: m.role || ':' || length(m.text)), ' ') AS told FROM (
          SELECT conv_id, turn, role, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS h FROM conversations WHERE role IN ('user', 'assistant')) WHERE role = 'user'""")
def chat_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = assistant.histories(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], 5)
    told = F.array_join(F.transform("history", lambda m: F.concat_ws(":", m["role"], F.length(m["text"]).cast("string"))), " ")
    return rows.select("conv_id", "turn", F.size("history").cast("long").alias("n_messages"), told.alias("told"))


@query("SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || '!' ELSE text || text || 'end' END AS said FROM conversations")
def message_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents as a plain text, as a JSON string, and as lists of blocks and of texts."""
    t, k = F.col("text"), F.col("turn") % 4
    block = F.struct(F.lit("text").alias("type"), t.alias("text"))
    quoted = lambda c: F.get(F.split(F.to_json(F.struct(c.alias("t"))), r'^\{"t":', 2), F.lit(1))
    bare = lambda c: F.regexp_replace(quoted(c), r"\}$", "")
    mixed = F.concat(F.lit("["), F.to_json(block), F.lit(","), bare(t), F.lit(',{"type":"image"},"end"]'))
    content = F.when(k == 0, t).when(k == 1, bare(F.concat(t, F.lit("!")))).otherwise(mixed)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.content_text(content).alias("said"))


@query("SELECT doc_id, array_to_string([substring(t, 1, 80) for t in [text, lang || ' ' || source, 'x'] if length(trim(t)) > 0][1:2], '|') AS clipped FROM documents")
def clipped_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    contexts = F.array("text", F.lit("  "), F.concat_ws(" ", "lang", "source"), F.lit("x"))
    return rows.select("doc_id", F.array_join(text.clipped(contexts, 2, 80), "|").alias("clipped"))


@query("SELECT p_partkey, '{\"a\":\"' || p_brand || '\",\"b\":\"' || p_type || '\",\"c\":\"' || p_size || '\"}' AS key FROM part")
def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a map was made doesn't matter."""
    pairs = {"c": F.col("p_size").cast("string"), "a": F.col("p_brand"), "b": F.col("p_type")}
    one = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)])
    two = F.create_map(*[x for k, v in reversed(pairs.items()) for x in (F.lit(k), v)])
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.canonical_json(F.when(F.col("p_partkey") % 2 == 0, one).otherwise(two)).alias("key"),
    )


_WANTED = dict(zip(DIMS, ("high", "medium", "high", "medium", "low")))
_APART = "list_filter([" + ", ".join(f"CASE WHEN {d} <> '{t}' THEN '{d}' END" for d, t in _WANTED.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""SELECT p_partkey, 'Wanted: I need a laptop with {', '.join(f'{t} {d}' for d, t in _WANTED.items())}, and a low budget.' || chr(10) || 'Item: ' || p_name || chr(10) || 'Price: ' || p_size || chr(10) || 'Description: ' || description || chr(10)
           || 'Tiers: {{' || {" || ',' || ".join(f"""'"{d}":"' || {d} || '"'""" for d in DIMS)} || '}}' || chr(10)
           || CASE WHEN len(a) = 0 AND p_retailprice <= 950 THEN '' ELSE 'Not a perfect match. It differs in: ' || CASE WHEN len(a) > 0 THEN array_to_string(a, ', ') ELSE 'nothing' END || '; it is ' || CASE WHEN p_retailprice <= 950 THEN 'within' ELSE 'outside' END
              || ' the budget. Every answer has to say that it is the closest there is.' || chr(10) END || 'Give 3 pairs as a JSON array of objects with question and ground_truth_answer.' AS prompt
           FROM (SELECT *, {_APART} AS a FROM {SQL_TIERED})""")
def grid_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_map = lambda of: F.create_map(*[x for d in DIMS for x in (F.lit(d), of(d))])
    item = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("price"), "description")
    wanted = as_map(lambda d: F.lit(_WANTED[d]))
    prompt = match.grid_prompt(item, as_map(F.col), wanted, F.lit("low"), F.col("p_retailprice") <= 950, 3, DIMS)
    return tiered(spark, sf_dir).select("p_partkey", prompt.alias("prompt"))


@query("""SELECT p_size AS batch, string_agg('[' || n || '] ' || p_name, chr(10) || chr(10) ORDER BY n) AS prompt FROM (SELECT p_size, p_name, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS n FROM part) GROUP BY p_size""")
def batch_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("batch"), "p_partkey", "p_name")
    return match.batch_prompt(rows, "batch", "p_partkey", "p_name").drop("slots")
