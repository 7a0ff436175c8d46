"""Mixing sources to target weights by entropy balancing.

Every word of a document is taken at a rate between 0 and ``CAP``, the same for all words of the document.  With
``p = rate / CAP``, ``w`` a document's words, ``x`` its size class and ``m`` the mean size class of all words, the rates
of each source minimise

    sum of w * (p * log(p) + (1 - p) * log(1 - p))  +  (sum of w * p * (x - m)) ** 2 / (2 * SOFT * sum of w)

under ``sum of w * CAP * p = target``: of all draws that take the source's target, the one nearest in entropy to an even
draw whose texts are, softly, as long as the corpus's.  The dual is convex in two multipliers a source, one for its
words and one for its length; the solution is exponentially tilted, ``p / (1 - p) = exp(lambda + mu * (x - m))``, and
Newton's iterations solve all sources at once.  Size classes are logarithmic, so the sums need no more than the words
of each (source, class): one aggregation over the corpus, after which an iteration is a sum over at most 64 rows a
source, kept together by one exchange.

Rates become whole copies by rounding with a carry.  Documents that hold a large share of their source come first and
alone (there are at most ``1 / SHARE`` of them in a source), the largest before the smaller, which make up for its
error; the balance then aims at what they leave.  The others are dealt by a hash into strata of bounded size and
rounded along their order of size, so that the error of a stratum is at most half its largest document.  Rows that are
equal in id and size are ``EQUAL`` units at most, each of which is dealt and rounded alone, so neither a repeated row
nor rows without ids meet in one stratum.  The order has no randomness but the hash: reruns agree.

Defined results: a null text has size 0; a size of 0 takes 0; a null source is a source of its own, last in order;
repeated rows count as often as they stand there; an empty table gives no rows; further columns play no part.

Native: DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.llm.scratch import materialize

WEIGHTS, TOTAL, CAP = (3, 1, 2), 1.5, 2
#: How far the mean size class may stay from the corpus's, and Newton's iterations.
SOFT, STEPS = 0.5, 16
#: Documents above this share of their source are rounded first; units in a stratum; units of equal rows.
SHARE, STRATUM, EQUAL = 1 / 200, 4_000, 1_000
#: So many rows of goals or rates at most (some 100 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    """The number of words of a text: what ASCII white space ends."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """``sources`` (source, source_size) with ``target``; one row a source.

    The share of all words goes to the sources by weight; a target stops at ``cap`` times the source's size, and the
    excess is shared again.  That is a water level: with sources ordered by the level at which they fill, the level
    is what the rest of the words over the rest of the weight gives for the first source that it does not fill.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    limit = F.col("source_size") * float(cap)
    ranked = sources.withColumn("weight", weight.cast("double")).withColumn("limit", limit).withColumn(
        "fills",
        F.col("limit") / F.col("weight"),
    )
    every, upto = W.partitionBy(), W.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    filled, above = F.coalesce(F.sum("limit").over(upto), F.lit(0.0)), F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    level = ranked.withColumn("level", (F.sum("source_size").over(every) * float(total) - filled) / above)
    held = F.max(F.when(F.col("level") <= F.col("fills"), F.col("level"))).over(every)
    return level.select("source", "source_size", F.least("limit", F.col("weight") * F.coalesce(held, F.lit(float("inf")))).alias("target"))


def balance(classes: DataFrame, mean: Column | float, cap: float = CAP, soft: float = SOFT, steps: int = STEPS) -> DataFrame:
    """``classes`` (source, goal, class, words) with ``rate``, the entropy-balanced rate of the class's documents.

    ``mean`` is the size class that the draw of each source leans to.
    """
    w, cap = W.partitionBy("source"), float(cap)
    rows = classes.withColumn("sum", F.greatest(F.sum("words").over(w), F.lit(1)).cast("double")).withColumn("apart", F.col("class") - mean)
    rows = rows.withColumn("part", F.least(F.greatest(F.col("goal") / (F.col("sum") * cap), F.lit(0.0)), F.lit(1.0)))
    held = F.least(F.greatest("part", F.lit(1e-12)), F.lit(1 - 1e-12))
    share = 1 / (1 + F.exp(-(F.col("level") + F.col("lean") * F.col("apart"))))
    rows = rows.withColumn("level", F.log(held / (1 - held))).withColumn("lean", F.lit(0.0))
    for _ in range(steps):
        p, d, words_ = F.col("share"), F.col("apart"), F.col("words") / F.col("sum")
        curve = words_ * p * (1 - p)
        sums = {"g1": words_ * p, "g2": words_ * p * d, "h11": curve, "h12": curve * d, "h22": curve * d * d}
        rows = rows.withColumn("share", share).withColumns({k: F.sum(v).over(w) for k, v in sums.items()})
        g1, g2, h22 = F.col("g1") - held, F.col("g2") + soft * F.col("lean"), F.col("h22") + soft
        det = F.col("h11") * h22 - F.col("h12") * F.col("h12")
        step = lambda x: F.when(det > 0, F.least(F.greatest(x / det, F.lit(-2.0)), F.lit(2.0))).otherwise(0.0)
        level, lean = step(h22 * g1 - F.col("h12") * g2), step(F.col("h11") * g2 - F.col("h12") * g1)
        rows = rows.withColumns({"level": F.col("level") - level, "lean": F.col("lean") - lean})
    rate = F.when(F.col("part") >= 1 - 1e-9, cap).when(F.col("part") <= 1e-9, 0.0).otherwise(cap * share)
    return rows.select("source", "class", rate.alias("rate"))


def _systematic(rate: Column, w: W) -> Column:
    """Whole copies whose running sum stays within a half of the rates' running sum."""
    upto = F.sum(rate).over(w)
    return (F.floor(upto + 0.5) - F.floor(upto - rate + 0.5)).cast("int")


def _diffuse(rows: DataFrame, copies: str) -> DataFrame:
    """Copies of the large documents of each source, the largest first: what one takes too much, the next take less.

    A source has at most ``1 / SHARE`` such rows, so that they fit in an array.
    """
    kept = [c for c in rows.columns if c not in ("__rate", "__hash")]
    item = F.struct((-F.col("size")).alias("__order"), F.col("__hash"), F.col("__rate"), *kept)
    start = F.struct(F.lit(0.0).alias("carry"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(state: Column, e: Column) -> Column:
        want = e["__rate"] * e["size"] + state["carry"]
        n = F.least(F.greatest(F.round(want / e["size"]), F.lit(0)), F.lit(CAP)).cast("int")
        return F.struct((want - n * e["size"]).alias("carry"), F.concat(state["out"], F.array(n)).alias("out"))

    lists = rows.groupBy("__key").agg(F.sort_array(F.collect_list(item)).alias("items"))
    pairs = F.arrays_zip(F.col("items"), F.aggregate("items", start, step, lambda s: s["out"]).alias("n"))
    return lists.select(F.explode(pairs).alias("p")).select(
        *[F.col("p.items")[c].alias(c) for c in kept],
        F.col("p")[F.lit("n")].alias(copies),
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", copies: str = "copies") -> DataFrame:
    """Per row of ``docs`` its doc_id, source, size, source_size, target and ``copies`` (0, 1 or 2)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"))
    # Rows that are equal become units of some of them each; texts are read once.
    alike = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("units", F.least("n", F.lit(EQUAL)))
    upto = lambda u: F.floor(F.col("n") * u / F.col("units"))
    units = alike.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)))
    units = units.withColumn("rows", (upto(F.col("unit") + 1) - upto(F.col("unit"))).cast("int")).withColumnRenamed("size", "row_size")
    units = units.select("doc_id", "source", (F.col("row_size") * F.col("rows")).alias("size"), "row_size", "unit", "rows")
    mixed = mix_sizes(materialize(units, "mixing"), copies, carry=("row_size", "unit", "rows"))
    each = mixed.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return each.select("doc_id", "source", F.col("row_size").alias("size"), "source_size", "target", copies)


def mix_sizes(rows: DataFrame, copies: str = "copies", carry: Sequence[str] = ()) -> DataFrame:
    """The same for rows that have (doc_id, source, size) already; of their other columns those in ``carry`` stay.

    Rows that are equal in id, size and ``carry`` share a stratum.
    """
    rows = rows.select("doc_id", "source", "size", *carry)
    # A null source joins like any other under a name that no source has.
    rows = rows.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    sums = rows.groupBy("__key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    goals = targets(sums.select("source", "source_size")).withColumn(
        "__key",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")),
    )
    goals = materialize(goals.select("__key", "source_size", "target").join(sums.select("__key", "__rows"), "__key"), "mixing-goals")

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df

    dealt = rows.join(small(goals), "__key")
    hash_ = F.xxhash64("doc_id", "size", *carry)
    big = (F.col("size") > F.col("source_size") * SHARE) & (F.col("size") > 0)
    even = F.col("target") / F.greatest(F.col("source_size"), F.lit(1))

    first = _diffuse(dealt.filter(big).withColumn("__rate", even).withColumn("__hash", hash_), copies)
    taken = first.groupBy("__key").agg(F.sum(F.col("size") * F.col(copies)).alias("__taken"))

    rest = dealt.filter(~big).withColumn("class", F.ceil(F.log2(F.col("size") + 1)).cast("int"))
    classes = rest.groupBy("__key", "class").agg(F.sum("size").alias("words"), F.first("target").alias("target"))
    classes = materialize(
        classes.join(taken, "__key", "left").withColumn("goal", F.col("target") - F.coalesce("__taken", F.lit(0))),
        "mixing-classes",
    )
    mean = classes.select(
        F.coalesce(F.sum(F.col("words") * F.col("class")) / F.nullif(F.sum("words"), F.lit(0)), F.lit(0.0)).alias("m")
    ).scalar()
    rates = balance(classes.select(F.col("__key").alias("source"), "goal", "class", "words"), mean).withColumnRenamed("source", "__key")
    rates = materialize(rates, "mixing-rates")
    strata = F.ceil(F.col("__rows") / STRATUM)
    rest = rest.join(small(rates), ["__key", "class"]).withColumn("__stratum", F.pmod(hash_, strata))
    # By stratum, or else the documents of a source would stay where the join has put them.
    rest = rest.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__key", "__stratum")
    along = W.partitionBy("__key", "__stratum").orderBy("size", hash_, "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rest = rest.withColumn(
        copies,
        F.when(F.col("size") > 0, _systematic(F.col("rate"), along)).otherwise(0),
    ).drop("class", "rate", "__stratum")
    return first.unionByName(rest).drop("__key", "__rows")


def report(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
