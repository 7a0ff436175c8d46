"""What the registered queries share: tables, the rules that suit their data, and pieces of SQL made from them."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.operators import catalog

#: The tier rules for the part catalogue; the engine's own defaults are in tarnfell.functions.rules.
KEYWORDS = {
    "f1": {"high": ["widget", "gizmo"], "low": ["ring", "rod"]},
    "f2": {"high": ["red", "blue"], "low": ["old", "cold"]},
    "f3": {"high": ["small"], "low": ["large"]},
    "f4": {"high": ["promo", "economy"], "low": ["standard"]},
    "f5": {"high": ["brand#1", "brand#20"], "low": ["brand#5", "brand#7"]},
}
DIMS = tuple(KEYWORDS)
DESCRIPTION = "concat(p_name, ' ', p_brand, ' ', p_type, '. Size ', CAST(p_size AS VARCHAR), ' kg.')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: part with a description."""
    return described(table(spark, sf_dir, "part"))


def described(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "description",
        F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), "p_type", F.lit(". Size "), F.col("p_size").cast("string"), F.lit(" kg.")),
    )


def tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_tiers(parts(spark, sf_dir), "description", KEYWORDS)


def sql_any(column: str, words: Sequence[str]) -> str:
    return f"regexp_matches({column}, '{'|'.join(re.escape(w) for w in words)}')"


def sql_tier(column: str, keywords: Mapping[str, Sequence[str]]) -> str:
    return f"CASE WHEN {sql_any(column, keywords['high'])} THEN 'high' WHEN {sql_any(column, keywords['low'])} THEN 'low' ELSE 'medium' END"


#: Parts with description and tiers.
SQL_TIERED = f"(SELECT *, {', '.join(f'{sql_tier(f"lower({DESCRIPTION})", k)} AS {f}' for f, k in KEYWORDS.items())}, {DESCRIPTION} AS description FROM part)"
SQL_BAND = "CASE WHEN {0} IS NULL OR {0} < 0 THEN 'flagship' WHEN {0} < 50000 THEN 'budget' WHEN {0} < 100000 THEN 'mid' WHEN {0} < 200000 THEN 'premium' ELSE 'flagship' END"
SQL_INDEX = "CASE {0} WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE -1 END"
SQL_RANGES = "(SELECT unnest([{'tier': 'low', 'low': a, 'high': m}, {'tier': 'medium', 'low': m, 'high': 950.0}, {'tier': 'high', 'low': 950.0, 'high': z}], recursive := true) FROM (SELECT min(p_retailprice) AS a, least(median(p_retailprice), 950.0) AS m, max(p_retailprice) AS z FROM part WHERE p_retailprice > 0))"
