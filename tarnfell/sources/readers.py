"""Typed readers.  Paths go to Spark's readers only, so they may be in any store that Spark reads."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfell.operators import catalog

CATALOG = "id bigint, name string, description string, price bigint, full_embedding array<float>, chunks array<string>, chunk_embeddings array<array<float>>"
TURNS = "pipeline string, question string, contexts array<string>, answer string, timestamp string, requirements map<string,string>, recommended struct<name:string,price:double,description:string>, ranked array<struct<name:string,price:double,description:string>>"
GROUND_TRUTH = "id bigint, combo_key string, laptop_name string, laptop_price bigint, price_tier string, match_score int, question string, ground_truth_answer string, requirements_json string, context string, created_at timestamp"
CASES = "query_text string, pipeline string, correctness double, timestamp string, summary map<string,string>, requirements map<string,string>"


def parquet_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """The table with exactly the schema's columns (missing ones null); no rows where there is no table."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    try:
        found = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], kind)
    have = set(found.columns)
    return found.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind])


def csv_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Name, Description and Price, whose thousands may be set off by commas."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumn("Price", F.regexp_replace("Price", ",", "").try_cast("long"))


def csv_texts(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    """(category, text) of all CSV files below each category's folder; malformed lines are left out.

    Files with the same header are read together, files with another one apart, so that no cell moves to another
    column.  One line a file comes to the driver.
    """
    out = spark.createDataFrame([], "category string, text string")
    for category, path in folders.items():
        lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path)
        first = lines.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("at"),
            "value",
            F.monotonically_increasing_id().alias("n"),
        )
        heads = first.filter("at = 0").groupBy("file").agg(F.min_by("value", "n").alias("head"))
        groups: dict[str, list[str]] = {}
        for r in heads.collect():
            groups.setdefault(r["head"], []).append(r["file"])
        for _, files in sorted(groups.items()):
            rows = spark.read.option("header", True).option("mode", "DROPMALFORMED").csv(sorted(files))
            melted = catalog.row_to_text(rows, F.lit(category), rows.columns, "__text")
            out = out.unionByName(melted.select(F.lit(category).alias("category"), F.col("__text").alias("text")))
    return out


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a file that holds one JSON object, such as a cache; a missing or broken file is empty."""
    empty = spark.createDataFrame([], f"key string, value {value}")
    try:
        whole = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    found = whole.select(F.explode(F.from_json("value", f"map<string,{value}>")))
    return empty.unionByName(found.select("key", "value"))


def reconstruct(vectors: DataFrame, positions: DataFrame) -> DataFrame:
    """The stored vectors of positions: (pos, embedding) for (pos); positions that aren't there are left out."""
    return positions.join(vectors.select("pos", "embedding"), "pos")


def jsonl(spark: SparkSession, path: str, schema: str = TURNS) -> DataFrame:
    """One object a line; blank and malformed lines are left out.  ``seq`` is the order of the lines."""
    kind = T.StructType.fromDDL(schema)
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    bad = T.StructType([*kind.fields, T.StructField("__bad", T.StringType())])
    parsed = lines.withColumn("j", F.from_json("value", bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    return parsed.filter(
        F.col("j").isNotNull()
        & F.col("j.__bad").isNull()
        & (F.trim("value") != "")
    ).select(*[f"j.{f.name}" for f in kind], "seq")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def points(spark: SparkSession, path: str) -> DataFrame:
    """Stored vectors' payloads, without the vectors; the payload's id before the point's."""
    rows = spark.read.parquet(path)
    return rows.select(F.coalesce("payload.id", "id").alias("id"), "payload.name", "payload.description", "payload.price")


def first_chunks(rows: DataFrame) -> DataFrame:
    """Of each item the chunk with the least index (then the least point); the full description before the chunk's."""
    kept = catalog.first_by(rows.filter("trim(laptop_id) <> ''"), ["laptop_id"], [F.col("chunk_index"), F.col("id")])
    return kept.withColumn("description", F.coalesce("full_description", "description"))


def docstore(positions: DataFrame, documents: DataFrame, missing: bool = False) -> DataFrame:
    """Documents in the order of an index: (pos, doc_id) with (doc_id, text, metadata).

    With ``missing``, positions whose document isn't there are kept, with nulls; else they are left out.
    """
    return positions.join(documents, "doc_id", "left" if missing else "inner")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Stored questions of combinations, with their requirements; broken JSON gives an empty map."""
    rows = parquet_or_empty(spark, path, GROUND_TRUTH).filter("combo_key is not null")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return rows.withColumn("requirements", F.coalesce(F.from_json("requirements_json", "map<string,string>"), empty))


def graph(spark: SparkSession, path: str, version: int) -> tuple[DataFrame, DataFrame] | None:
    """Nodes and edges stored under that version, or nothing: then the graph has to be built."""
    try:
        return spark.read.parquet(f"{path}/version={version}/nodes"), spark.read.parquet(f"{path}/version={version}/edges")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def fetched(df: DataFrame, make_client: Callable[[], Callable[[pd.DataFrame], Iterable[dict]]], schema: str) -> DataFrame:
    """Rows of an external service: each task makes its client once and hands it batches of ``df``."""

    names = T.StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            yield pd.DataFrame(list(client(batch)), columns=names)

    return df.mapInPandas(run, schema)
