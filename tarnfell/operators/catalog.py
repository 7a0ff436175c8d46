"""Catalogue clean-up: melting, keys, duplicates, look-ups, samples, statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.functions import rules, text
from tarnfell.operators.lineage import cut


def row_to_text(df: DataFrame, category: Column, columns: Sequence[str], name: str = "text") -> DataFrame:
    """A line for the category, then one for each column that isn't null."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"), F.lit("\n"))).otherwise("") for c in columns]
    return df.withColumn(name, F.concat(F.lit("CATEGORY: "), category, F.lit("\n"), *lines))


def renumber(df: DataFrame, order: Sequence[Column | str], name: str = "id") -> DataFrame:
    """Numbers from 0 in the given order, without bringing all rows to one task.

    Rows are dealt by range; the sizes of the ranges, one number each, then shift every range's own numbers.
    """
    dealt = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    own = cut(dealt.withColumn("__n", F.row_number().over(W.partitionBy("__part").orderBy(*order))))  # ranges are drawn once
    sizes = own.groupBy("__part").agg(F.max("__n").alias("__size"))
    before = F.coalesce(F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__start"))
    return own.join(F.broadcast(starts), "__part").withColumn(
        name,
        (F.col("__start") + F.col("__n") - 1).cast("long"),
    ).drop("__part", "__n", "__start")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key: the first in the given order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def fallback_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: Column,
    values: Sequence[str],
    default: Mapping[str, Column],
) -> DataFrame:
    """Looks rows up by the first key, where that fails by the next; the last of several matches wins."""
    out, found = left, {v: [] for v in values}
    for i, key in enumerate(keys):
        side = first_by(right.filter(F.col(key).isNotNull()), [key], [order.desc()]).select(
            F.col(key).alias(f"__k{i}"),
            *[F.col(v).alias(f"__{v}{i}") for v in values],
        )
        out = out.join(side, out[key] == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        for v in values:
            found[v].append(F.col(f"__{v}{i}"))
    named = {v: F.coalesce(*found[v], default[v]) if v in default else F.coalesce(*found[v]) for v in values}
    return out.select(*left.columns, *[c.alias(f"found_{v}") for v, c in named.items()])


def cached_or(df: DataFrame, cache: DataFrame, key: str, values: Mapping[str, Column]) -> DataFrame:
    """``df`` with each value from ``cache`` by the key, or worked out where the cache has none; ``cached`` tells which.

    The cache's first row of a key counts; ``values`` are expressions over ``df``.
    """
    held = cache.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.first(F.struct(*values)).alias("__held"))
    met = df.join(held, df[key] == F.col("__key"), "left")
    found = {name: F.coalesce(F.col(f"__held.{name}"), made) for name, made in values.items()}
    return met.select(*df.columns, *[c.alias(name) for name, c in found.items()], F.col("__key").isNotNull().alias("cached"))


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def counted(df: DataFrame, value: str) -> DataFrame:
    """(v, c, upto): each distinct value, how often it stands there, and how many rows have it or less.

    Distinct values are dealt by range; the ranges' totals, one row each, shift what every range sums up for itself.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    along = W.partitionBy("__part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    own = counts.repartitionByRange("v").withColumn("__part", F.spark_partition_id()).withColumn("__own", F.sum("c").over(along))
    own = cut(own)  # ranges are drawn once
    before = F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    starts = own.groupBy("__part").agg(F.sum("c").alias("__size")).select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return own.join(F.broadcast(starts), "__part").select("v", "c", (F.col("__start") + F.col("__own")).alias("upto"))


def at_places(ranks: DataFrame, places: Mapping[str, Column]) -> DataFrame:
    """One row: ``n``, and for each name the value at a place from 0 (an expression over ``n``); null without rows."""
    total = ranks.agg(F.coalesce(F.max("upto"), F.lit(0)).cast("long").alias("n"))
    rows = ranks.crossJoin(F.broadcast(total))  # one row
    return rows.agg(
        F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"),
        *[F.min(F.when(F.col("upto") > place, F.col("v"))).alias(name) for name, place in places.items()],
    )


def median(df: DataFrame, value: str) -> Column:
    """The exact median, as a scalar to use anywhere: the mean of the one or two values in the middle."""
    n = F.col("n")
    middle = at_places(counted(df, value), {"a": F.floor((n - 1) / 2), "b": F.floor(n / 2)})
    return middle.select(((F.col("a") + F.col("b")) / 2).alias("median")).scalar()


def price_stats(df: DataFrame, price: str) -> DataFrame:
    p, some = F.col(price), df.filter(F.col(price) > 0)
    out = some.agg(
        F.count(p).alias("n"),
        F.min(p).alias("min_price"),
        F.max(p).alias("max_price"),
        F.avg(p).alias("mean_price"),
        F.stddev_samp(p).alias("stdev_price"),
    )
    return out.withColumn("median_price", median(some, price))


def order_statistics(df: DataFrame, price: str, parts: Sequence[tuple[int, int]] = ((1, 3), (2, 3), (1, 4), (3, 4))) -> DataFrame:
    """The value at floor(n * k / d), from 0, for each (k, d): exact, from the counts of distinct values."""
    return at_places(counted(df, price), {f"p_{k}_{d}": F.floor(F.col("n") * k / d) for k, d in parts})


def budget_ranges(df: DataFrame, price: str, cap: float = rules.BUDGET_CAP) -> DataFrame:
    """(tier, low, high): closed ranges from the least price, the median up to ``cap``, and the largest."""
    some = df.filter(F.col(price) > 0)
    one = some.agg(F.min(price).alias("a"), F.max(price).alias("z")).withColumn(
        "m",
        F.when(F.col("a").isNotNull(), F.least(median(some, price), F.lit(float(cap)))),
    )
    z = F.lit(0.0)
    top = F.when(F.col("a").isNotNull(), F.lit(float(cap)))
    bounds = (("low", F.col("a"), F.col("m")), ("medium", F.col("m"), top), ("high", top, F.col("z")))
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("tier"), F.coalesce(lo, z).cast("double").alias("low"), F.coalesce(hi, z).cast("double").alias("high"))
            for t, lo, hi in bounds
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def with_tiers(
    df: DataFrame,
    description: str,
    keywords: Mapping[str, Mapping[str, Sequence[str]]] = rules.KEYWORDS,
    classify: Callable[[Column, Mapping[str, Sequence[str]]], Column] = text.tier,
) -> DataFrame:
    """A column for each feature, named as the feature; ``classify`` makes the tier of a description and a feature's words."""
    return df.withColumns({feature: classify(F.col(description), words) for feature, words in keywords.items()})


def tier_distribution(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, low, medium, high, total, mean_tier): missing tiers count as medium, unknown ones not at all."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f), F.lit("medium")).alias("tier")) for f in features])
    long = df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("tier").isin(*rules.TIERS))
    value = F.when(F.col("tier") == "low", 1).when(F.col("tier") == "medium", 2).otherwise(3)
    return long.groupBy("feature").agg(
        *[F.count_if(F.col("tier") == t).alias(t) for t in rules.TIERS],
        F.count(F.lit(1)).alias("total"),
        F.avg(value).alias("mean_tier"),
    )


def representative(df: DataFrame, id_: str, name: str, price: str, n: int) -> DataFrame:
    """The n dearest, nearest the mean, nearest the median and cheapest, each name once, in that order of groups."""
    valid = df.filter(F.col(price) > 0)
    mid = valid.agg(F.avg(price).alias("__mean")).withColumn("__median", median(valid, price))
    rows = valid.crossJoin(F.broadcast(mid))  # one row
    groups = [
        ("expensive", F.col(price).desc(), F.col(id_).desc()),
        ("mean_range", F.abs(F.col(price) - F.col("__mean")), F.col(id_)),
        ("median_range", F.abs(F.col(price) - F.col("__median")), F.col(id_)),
        ("cheapest", F.col(price), F.col(id_)),
    ]
    picked = None
    for order, (group, by, tie) in enumerate(groups):
        top = rows.orderBy(by, tie).limit(n).select(id_, name, price, F.lit(group).alias("price_group"), F.lit(order).alias("__group"))
        picked = top if picked is None else picked.unionByName(top)
    return first_by(
        picked,
        [name],
        [F.col("__group"), F.when(F.col("__group") == 0, F.col(price)).otherwise(F.lit(0.0)), F.col(id_)],
    ).drop("__group")


def stratified(df: DataFrame, category: str, position: str, n: int) -> DataFrame:
    """Round robin over the categories, in the order in which they first occur."""
    turn = F.row_number().over(W.partitionBy(category).orderBy(position))
    rows = df.withColumn("__turn", turn).filter(F.col("__turn") <= n)
    first = df.groupBy(category).agg(F.min(position).alias("__first"))
    return rows.join(first, category).orderBy("__turn", "__first").limit(n).drop("__turn", "__first")


def seeded_sample(df: DataFrame, id_: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a hash of the id: the same ones every time."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string")).cast("binary")), id_).limit(n)
