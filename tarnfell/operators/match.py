"""Matching requirement grids with a catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.functions import rules, text
from tarnfell.operators import catalog


def combo_grid(spark: SparkSession, dims: Sequence[str]) -> DataFrame:
    """Every combination of tiers of the dimensions and the budget: 3 to the power of their number plus one."""
    rows = spark.range(1).select()
    for d in [*dims, "budget_tier"]:
        rows = rows.select("*", F.explode(F.array(*map(F.lit, rules.TIERS))).alias(d))
    return rows.withColumn("combo_key", text.combo_key([F.col(d) for d in dims], F.col("budget_tier"), dims))


def _agreement(dims: Sequence[str]) -> Column:
    return sum((F.when(F.col(f"x.{d}") == F.col(f"g.{d}"), 1).otherwise(0) for d in dims), F.lit(0))


def best_match(grid: DataFrame, items: DataFrame, ranges: DataFrame, dims: Sequence[str], id_: str, price: str) -> DataFrame:
    """(combo_key, id, match_score, within_budget): the first item that agrees most, in the budget's range if any is.

    Items are first reduced to the first of each (budget tier, vector of tiers): at most 3 to the power of the
    dimensions for a tier, whatever the catalogue's size.  Only that bounded table meets the grid.
    """
    tiers = ranges.select(F.col("tier").alias("pool"), "low", "high")
    whole = items.sparkSession.range(1).select(
        F.lit("all").alias("pool"),
        F.lit(float("-inf")).alias("low"),
        F.lit(float("inf")).alias("high"),
    )
    pools = F.broadcast(tiers.unionByName(whole))  # four rows
    rows = items.join(pools, F.col(price).between(F.col("low"), F.col("high")))
    first = rows.groupBy("pool", *dims).agg(F.min(id_).alias(id_))
    has = first.filter("pool <> 'all'").select(F.col("pool").alias("has")).distinct()
    asked = grid.join(F.broadcast(has), grid.budget_tier == F.col("has"), "left").withColumn("pool", F.coalesce("has", F.lit("all")))
    met = asked.alias("g").join(F.broadcast(first).alias("x"), F.col("g.pool") == F.col("x.pool"))
    scored = met.select(
        "g.combo_key",
        F.col(f"x.{id_}").alias(id_),
        _agreement(dims).alias("match_score"),
        F.col("g.has").isNotNull().alias("within_budget"),
    )
    best = W.partitionBy("combo_key").orderBy(F.desc("match_score"), id_)
    return scored.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")


def best_match_direct(grid: DataFrame, items: DataFrame, ranges: DataFrame, dims: Sequence[str], id_: str, price: str) -> DataFrame:
    """The same without the pool of all items: every item is looked at in each of the budget tiers that its price is in.

    Of the items of a tier that are alike in all dimensions the first stands for all, as none of the others can be a best
    match, so that what meets the grid is bounded whatever the catalogue's size.
    """
    tiers = F.broadcast(ranges.select(F.col("tier").alias("budget_tier"), "low", "high"))
    rows = items.join(tiers, F.col(price).between(F.col("low"), F.col("high"))).groupBy("budget_tier", *dims).agg(F.min(id_).alias(id_))
    best = F.max(F.struct(_agreement(dims).alias("match_score"), (-F.col(f"x.{id_}")).alias("n"))).alias("b")
    inside = rows.alias("x").join(
        F.broadcast(grid).alias("g"),
        F.col("x.budget_tier") == F.col("g.budget_tier"),
    ).groupBy("g.combo_key").agg(best)
    left = grid.join(inside.select("combo_key"), "combo_key", "left_anti")
    # Where a tier has no item, the first item of each vector of tiers stands for all like it: a bounded table.
    first = items.groupBy(*dims).agg(F.min(id_).alias(id_))
    outside = first.alias("x").crossJoin(F.broadcast(left).alias("g")).groupBy("g.combo_key").agg(best)
    done = inside.withColumn("within_budget", F.lit(True)).unionByName(outside.withColumn("within_budget", F.lit(False)))
    return done.select("combo_key", (-F.col("b.n")).alias(id_), F.col("b.match_score").alias("match_score"), "within_budget")


def match_prompt(name: Column, price: Column, requirement: Column, score: Column, fields: int = 5) -> Column:
    """The text that asks a model for a question and an answer about a match."""
    note = F.when(score < fields, F.format_string(" It meets %d of %d requirements; say what differs.", score, F.lit(fields))).otherwise("")
    return F.concat(F.format_string("Item: %s at %s. Requirements: %s.", name, price.cast("string"), requirement), note)


def mismatches(tiers: Column, wanted: Column, dims: Sequence[str]) -> Column:
    """The dimensions in which an item's tiers (a map) aren't those wanted."""
    return F.filter(F.array(*map(F.lit, dims)), lambda d: ~tiers[d].eqNullSafe(wanted[d]))


def grid_prompt(
    item: Column,
    tiers: Column,
    wanted: Column,
    budget_tier: Column,
    within: Column,
    n: int,
    dims: Sequence[str] = rules.DIMENSIONS,
) -> Column:
    """The text that asks a model for n pairs of question and answer about a combination's best item.

    ``item`` has name, price and description, of which the first 800 characters count; where the item isn't a perfect
    match the text says in what, and that every answer has to say so.
    """
    apart = mismatches(tiers, wanted, dims)
    note = F.concat(
        F.lit("Not a perfect match. It differs in: "),
        F.when(F.size(apart) > 0, F.array_join(apart, ", ")).otherwise("nothing"),
        F.lit("; it is "),
        F.when(within, "within").otherwise("outside"),
        F.lit(" the budget. Every answer has to say that it is the closest there is.\n"),
    )
    perfect = within & (F.size(apart) == 0)
    return F.concat(
        F.lit("Wanted: "), text.grid_sentence(wanted, budget_tier, dims),
        F.lit("\nItem: "), F.coalesce(item["name"], F.lit("Unknown")), F.lit("\nPrice: "), F.coalesce(item["price"].cast("string"), F.lit("0")),
        F.lit("\nDescription: "), F.coalesce(F.substring(item["description"], 1, 800), F.lit("")),
        F.lit("\nTiers: "), text.canonical_json(tiers), F.lit("\n"), F.when(perfect, "").otherwise(note),
        F.lit(f"Give {n} pairs as a JSON array of objects with question and ground_truth_answer."),
    )


def batch_prompt(rows: DataFrame, batch: str, order: str, prompt: str) -> DataFrame:
    """(batch, prompt, slots): the prompts of a batch under their indexes from 0; batches have a bounded size."""
    item = F.struct(order, prompt)
    held = rows.groupBy(batch).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    told = F.transform("__items", lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x[prompt]))
    return held.select(batch, F.array_join(told, "\n\n").alias("prompt"), F.transform("__items", lambda x: x[order]).alias("slots"))


def batches(df: DataFrame, order: Sequence[str], size: int, name: str = "batch") -> DataFrame:
    """Batch numbers from 1 in the given order, ``size`` rows each; rows are numbered by range, not in one task."""
    return catalog.renumber(df, order, "__id").withColumn(name, (F.floor(F.col("__id") / size) + 1).cast("long")).drop("__id")
