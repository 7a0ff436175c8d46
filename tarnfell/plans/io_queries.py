"""Registered queries: what is written is read again.  Every query writes to a folder of its own in the shared one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.functions import vectors
from tarnfell.operators import hooks, match
from tarnfell.operators.lineage import fresh_folder
from tarnfell.plans.registry import query
from tarnfell.plans.shared import table
from tarnfell.sources import keyed, readers, sinks


@query("SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def io_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken and blank lines stand among the good ones."""
    path = fresh_folder(spark, "io-lines")
    rows = table(spark, sf_dir, "conversations")
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))
    broken = spark.createDataFrame([('{"conv_id": 1, "tu',), ("",), ("   ",)], "line string")
    lines.unionByName(broken).write.text(path)
    found = readers.jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")
    return found.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("SELECT n_name AS key, CAST(n_regionkey AS BIGINT) AS region, 'n' || n_nationkey AS name FROM nation")
def io_json_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache in one file; a file that is missing adds nothing, nor does a broken one."""
    path = fresh_folder(spark, "io-map")
    entry = F.struct(F.col("n_regionkey").alias("region"), F.concat(F.lit("n"), "n_nationkey").alias("name"))
    held = table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(F.struct("n_name", entry))).alias("m"))
    held.select(F.to_json("m")).coalesce(1).write.text(f"{path}/good")
    spark.createDataFrame([('{"a": ',)], "line string").coalesce(1).write.text(f"{path}/broken")
    kind = "struct<region:bigint,name:string>"
    found = readers.json_map(spark, f"{path}/good/*.txt", kind)
    for other in ("broken/*.txt", "missing"):
        found = found.unionByName(readers.json_map(spark, f"{path}/{other}", kind))
    return found.select("key", "value.region", "value.name")


@query("""SELECT 'geo' AS category, 'CATEGORY: geo' || chr(10) || 'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey || chr(10) AS text FROM nation
          UNION ALL SELECT 'geo', 'CATEGORY: geo' || chr(10) || 'r_regionkey: ' || r_regionkey || chr(10) || 'r_name: ' || r_name || chr(10) FROM region
          UNION ALL SELECT 'shops', 'CATEGORY: shops' || chr(10) || 's_name: ' || s_name || chr(10) || 'note: a, b' || chr(10) FROM supplier""")
def io_csv_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of different headers below one folder keep their columns."""
    path = fresh_folder(spark, "io-csv")
    write = lambda df, to: df.write.option("header", True).csv(f"{path}/{to}")
    write(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), "geo/deep/nation")
    write(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "geo/region")
    write(table(spark, sf_dir, "supplier").select("s_name", F.lit("a, b").alias("note")), "shops")
    return readers.csv_texts(spark, {"geo": f"{path}/geo", "shops": f"{path}/shops"})


@query("SELECT c_name AS name, CAST(c_custkey * 1000 + 12 AS BIGINT) AS price FROM customer")
def io_csv_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with thousands set off by commas, descriptions with quotes and line ends."""
    path = fresh_folder(spark, "io-catalog")
    price = F.when(F.col("c_custkey") > 0, F.format_string("%s,012", F.col("c_custkey").cast("string"))).otherwise("12")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("Name"),
        F.lit('two "lines",\nin one').alias("Description"),
        price.alias("Price"),
    )
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return readers.csv_catalog(spark, path).filter(F.contains("Description", F.lit("\n"))).select(
        F.col("Name").alias("name"),
        F.col("Price").alias("price"),
    )


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part UNION ALL SELECT -1, 'added', 0")
def io_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by key over rows by key; the last of the new ones of a key wins."""
    path = fresh_folder(spark, "io-upsert")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    sinks.upsert(rows, path, "p_partkey")
    some = rows.filter("p_partkey % 5 = 0").select(
        "p_partkey",
        F.concat(F.lit("new "), "p_name").alias("p_name"),
        (F.col("p_size") + 1).alias("p_size"),
    )
    stale = some.withColumn("p_size", F.lit(-9))
    added = spark.createDataFrame([(-1, "added", 0)], "p_partkey long, p_name string, p_size int")
    sinks.upsert(some.unionByName(stale).unionByName(added), path, "p_partkey", F.col("p_size"))
    return sinks.read(spark, path)


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 1 THEN 'later' END AS note FROM supplier WHERE s_suppkey % 4 IN (0, 1) AND (s_suppkey % 8 <> 0 OR s_acctbal >= 5000)")
def io_append_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without the texts that they need aren't taken; a column comes later; then some rows go."""
    path = fresh_folder(spark, "io-rows")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    blank = F.when(F.col("s_suppkey") % 4 == 2, " ").otherwise(F.when(F.col("s_suppkey") % 4 == 0, F.col("s_name")))
    sinks.append_rows(rows.withColumn("s_name", blank), path, ["s_name"])
    sinks.append_rows(rows.filter("s_suppkey % 4 = 1").withColumn("note", F.lit("later")), path, ["s_name", "note"])
    sinks.delete(spark, path, (F.col("s_suppkey") % 8 == 0) & (F.col("s_acctbal") < 5000))
    return sinks.read(spark, path).select("s_suppkey", "s_name", "note")


@query("SELECT 'node' AS part, 'N' || n_nationkey AS a, n_name AS b FROM nation UNION ALL SELECT 'edge', 'N' || n_nationkey, 'R' || n_regionkey FROM nation UNION ALL SELECT 'other version', 'none', 'none'")
def io_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored graph is found under its version only."""
    path = fresh_folder(spark, "io-graph")
    n = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), "n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("R"), "n_regionkey").alias("dst"),
    )
    sinks.save_graph(n.select("id", "name"), n.select(F.col("id").alias("src"), "dst"), path, 3)
    nodes, edges = readers.graph(spark, path, 3)
    missing = "none" if readers.graph(spark, path, 4) is None else "found"
    told = nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.col("name").alias("b")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"))
    )
    return told.unionByName(spark.createDataFrame([("other version", missing, missing)], "part string, a string, b string"))


@query("""SELECT p_partkey AS id, p_name AS name, 'whole ' || p_name AS description, CAST(p_size AS BIGINT) AS price FROM part""")
def io_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three chunks an item, stored as points; of each item the first chunk gives its description back."""
    path = fresh_folder(spark, "io-points")
    p = table(spark, sf_dir, "part").withColumn("chunk_index", F.explode(F.array(*map(F.lit, (2, 0, 1)))))
    payload = F.struct(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("whole "), "p_name").alias("description"),
        F.col("p_size").cast("long").alias("price"),
    )
    p.select((F.col("p_partkey") * 3 + F.col("chunk_index")).alias("id"), payload.alias("payload"), "chunk_index").write.parquet(path)
    stored = readers.points(spark, path)
    chunks = spark.read.parquet(path).select(
        "id",
        F.col("payload.id").cast("string").alias("laptop_id"),
        "chunk_index",
        F.col("payload.description").alias("full_description"),
        F.concat(F.lit("chunk "), "chunk_index").alias("description"),
    )
    first = readers.first_chunks(chunks).select(F.col("laptop_id").cast("long").alias("id"), "description")
    return stored.distinct().drop("description").join(first, "id").select("id", "name", "description", "price")


@query("SELECT vec_id, CAST(len(embedding) AS INT) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings WHERE vec_id % 10 = 3")
def io_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one width are stored, and some of them read back by position; a position that isn't there is left out."""
    path = fresh_folder(spark, "io-vectors")
    sinks.recreate(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pos"), "embedding"), path, "embedding")
    stored = sinks.read(spark, path)
    wanted = stored.filter("pos % 10 = 3").select("pos").unionByName(spark.createDataFrame([(-5,)], "pos long"))
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return readers.reconstruct(stored, wanted).select(
        F.col("pos").alias("vec_id"),
        F.size("embedding").alias("width"),
        F.round(total, 5).alias("total"),
    )


@query("SELECT n_nationkey AS pos, n_name AS text, CAST(64 AS INT) AS width FROM nation")
def io_saved_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are stored with their vectors and come back in their order."""
    path = fresh_folder(spark, "io-texts")
    sinks.save_texts(
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("text")),
        path,
        "text",
        vectors.hash_embed,
    )
    return sinks.read(spark, path).select("pos", "text", F.size("embedding").alias("width"))


@query("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 6 + 1 AS BIGINT) AS batch FROM part")
def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.batches(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], 6)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000")
def io_price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions, each sorted by price within its files, so that a range of prices skips what lies outside."""
    path = fresh_folder(spark, "io-prices")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    sinks.replace(rows.limit(1), path, "o_totalprice")
    sinks.replace(rows, path, "o_totalprice")
    return sinks.read(spark, path).filter(F.col("o_totalprice").between(100_000, 120_000))


@query("SELECT s_suppkey AS id, s_name AS name, CAST(NULL AS DOUBLE) AS score FROM supplier")
def io_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that lacks a column, and one that isn't there at all."""
    path, kind = fresh_folder(spark, "io-columns"), "id bigint, name string, score double"
    table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.lit(1).alias("more"),
    ).write.parquet(path)
    return readers.parquet_or_empty(spark, path, kind).unionByName(readers.parquet_or_empty(spark, f"{path}-none", kind))


@query("SELECT 'k' || n_nationkey AS combo_key, CASE WHEN n_nationkey % 3 = 0 THEN 'high' END AS tier FROM nation WHERE n_nationkey % 5 <> 0")
def io_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored questions with their requirements; broken JSON gives none, rows without a key aren't read."""
    path = fresh_folder(spark, "io-truth")
    n = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select(
        n.cast("long").alias("id"),
        F.when(n % 5 != 0, F.concat(F.lit("k"), n.cast("string"))).alias("combo_key"),
        F.when(n % 3 == 0, '{"GPU intensity": "high"}').when(n % 3 == 1, "{broken").alias("requirements_json"),
    )
    rows.write.parquet(path)
    return readers.ground_truth(spark, path).select("combo_key", F.element_at("requirements", "GPU intensity").alias("tier"))


@query("SELECT count(*) AS total, round(sum(o_totalprice), 2) AS money, min(o_orderkey) AS first FROM orders")
def io_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-row summary as JSON, and read from it again."""
    summary = table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("total"),
        F.round(F.sum("o_totalprice"), 2).alias("money"),
        F.min("o_orderkey").alias("first"),
    )
    told = spark.createDataFrame([(sinks.json_report(summary),)], "j string")
    return told.select(F.from_json("j", "total bigint, money double, first bigint").alias("r")).select("r.*")


# ------------------------------------------------------------------------------------------------- models behind hooks


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN 'echo: ' || left(text, 200) END AS answer FROM documents")
def hook_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline model's answers; a document without a prompt gets none."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    prompt = F.when(F.length("text") > 50, F.col("text"))
    return hooks.generated(rows, prompt, make=hooks.with_backoff(hooks.with_retries(hooks.echo, 2, 0.0), 1, 0.0)).select("doc_id", "answer")


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 3 = 2 THEN 0 ELSE p_size END AS INT) AS directness, CAST(CASE WHEN p_size % 3 = 0 THEN 4 ELSE 0 END AS INT) AS coherence FROM part")
def hook_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's JSON: fenced, cut off, or none at all."""
    size = F.col("p_size").cast("string")
    fenced = F.concat(F.lit('```json\n{"directness": '), size, F.lit(', "coherence": 4}\n```'))
    short = F.concat(F.lit('{"directness": '), size, F.lit(', "rationale": "it st'))
    answer = F.when(F.col("p_size") % 3 == 0, fenced).when(F.col("p_size") % 3 == 1, short).otherwise("I can't say")
    rows = table(spark, sf_dir, "part").select("p_partkey", answer.alias("answer"))
    return hooks.judged(rows, "answer", ["directness", "coherence"]).select("p_partkey", "directness", "coherence")


@query("SELECT p_partkey, p_brand AS slot, 'q1' AS question, 'a1' AS answer FROM part")
def hook_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of a batch answer go to their slots; one of no slot and one without an answer are left out."""
    answer = '[{"index": 1, "question": "q1", "answer": "a1"}, {"index": 7, "question": "q", "answer": "a"}, {"index": 0, "question": "q0", "answer": " "}]'
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array("p_name", "p_brand").alias("slots"), F.lit(answer).alias("answer"))
    told = rows.withColumn("slots", F.transform("slots", lambda s: F.struct(F.col("p_partkey").alias("p_partkey"), s.alias("s"))))
    return hooks.routed(told, "answer", "slots").select("slot.p_partkey", F.col("slot.s").alias("slot"), "question", "answer")


@query("SELECT n_name AS question FROM nation UNION ALL SELECT n_name FROM nation, range(15) WHERE n_nationkey = 0")
def hook_topped_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty questions of twenty-five: the first one stands in for what is missing."""
    return hooks.topped_up(
        table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("question")),
        ["n_nationkey"],
        40,
    ).select("question")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new ' || p_name ELSE p_name END AS p_name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 7 <> 1
          UNION ALL SELECT -1, 'added', 0""")
def io_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of the new rows of a key wins, some keys go, all in the buckets that they lie in."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    stored = keyed.Keyed(spark, fresh_folder(spark, "io-keyed"), ["p_partkey"], "p_partkey long, p_name string, p_size int", 16)
    stored.upsert(rows)
    some = rows.filter("p_partkey % 5 = 0").select("p_partkey", F.concat(F.lit("new "), "p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    added = spark.createDataFrame([(-1, "added", 0), (None, "no key", 0)], "p_partkey long, p_name string, p_size int")
    stored.upsert(some.unionByName(some.withColumn("p_size", F.lit(-9))).unionByName(added), F.col("p_size"))
    stored.delete(rows.filter("p_partkey % 7 = 1"))
    return stored.read()


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 1 THEN 'later' END AS note FROM supplier WHERE s_suppkey % 4 IN (0, 1) UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier WHERE s_suppkey % 4 = 1")
def io_appended_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without the texts that they need aren't taken; a column that comes later is null before."""
    path, rows = fresh_folder(spark, "io-appended"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    blank = F.when(F.col("s_suppkey") % 4 == 2, " ").when(F.col("s_suppkey") % 4 < 2, F.col("s_name"))
    keyed.append(rows.withColumn("s_name", blank), path, ["s_name"])
    keyed.append(rows.filter("s_suppkey % 4 = 1").withColumn("note", F.lit("later")), path, ["s_name", "note"])
    return readers.parquet_or_empty(spark, path, "s_suppkey long, s_name string, note string")
