"""URL filters by a temporal list join.

A dated list says when a host or domain was put on it and taken off.  Its entries become validity intervals
(``[valid_from, valid_to)``, open where nothing follows), and every capture is evaluated as of its fetch day: it is
blocked if an interval of its host, or of a domain above, holds that day; the longest such pattern is named.

Both sides meet on (pattern, slot).  A closed interval has a slot for every month that it touches, within the months
in which there are captures at all, and a capture one: captures of one host, however many, are spread over the months
and meet no intervals of other years.  A pattern has one open interval at most, its last; that lies in ``SALT`` slots
of its own, over which the captures are dealt, so it needs no last month and any date is judged right.  The join's
sides are left to the adaptive planner, which broadcasts the list only if it measures as small and splits what remains
of a hot key.  URLs are reduced to hosts before anything moves.

Defined results: a capture without a host (null, empty or malformed URL) or without a day is kept and not blocked;
events of one pattern on one day count in the order add, remove; events without pattern, date or known action are
ignored; hosts may have any number of labels; repeated rows are evaluated one by one; an empty list blocks nothing; columns
that bear a result's name are replaced.

Native: DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnfell.llm.names import others
from tarnfell.llm.scratch import materialize

#: Slots over which the captures that may meet an open interval are dealt.
SALT = 16


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)", 1), F.lit(""))


def suffixes(name: Column) -> Column:
    """The host and all domains above it that have two labels at least."""
    labels = F.split(name, r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array(name)).otherwise(
        F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.array_join(F.slice(labels, i + 1, n), "."))
    )


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, valid_from, valid_to) from events (pattern, action: add or remove, dated: date)."""
    events = entries.filter("pattern is not null and dated is not null and action in ('add', 'remove')").select(
        F.lower("pattern").alias("pattern"),
        "action",
        F.col("dated").cast("date").alias("dated"),
    ).distinct()
    along = W.partitionBy("pattern").orderBy("dated", "action")
    ends = events.withColumn("valid_to", F.lead("dated").over(along))
    return ends.filter(
        "action = 'add' and (valid_to is null or valid_to > dated)"
    ).select("pattern", F.col("dated").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """``captures`` with ``host``, ``blocked``, ``pattern`` (the longest that blocks it) and ``since``."""
    month = lambda c: F.year(c) * 12 + F.month(c)
    columns = others(captures.columns, "host", "blocked", "pattern", "since")
    kept = captures.select(
        F.struct(*columns).alias("__capture"),
        F.monotonically_increasing_id().alias("__row"),
        host(F.col(url)).alias("host"),
        F.col(day).cast("date").alias("__day"),
    )
    kept = materialize(kept, "captures")  # the number of a row must not change between the two uses
    rows = kept.drop("__day")
    names = kept.filter("host is not null and __day is not null").select(
        "__row",
        "__day",
        F.explode(suffixes(F.col("host"))).alias("pattern"),
    )
    # Slots are (month, 0) in the years that count, (the capture's number, 1) for open intervals.
    open_slot = F.struct(F.pmod("__row", F.lit(SALT)).cast("int").alias("n"), F.lit(1).alias("kind"))
    keys = names.select(
        "__row",
        "__day",
        "pattern",
        F.explode(F.array(F.struct(month("__day").alias("n"), F.lit(0).alias("kind")), open_slot)).alias("__slot"),
    )
    earliest, latest = kept.agg(F.min("__day"), F.max("__day")).first()
    first, last = F.greatest("valid_from", F.lit(earliest)), F.least(F.date_sub("valid_to", 1), F.lit(latest))
    every = intervals(entries)
    closed = every.filter(F.col("valid_to").isNotNull()).withColumn("__n", F.when(first <= last, F.sequence(month(first), month(last))))
    lasting = every.filter(F.col("valid_to").isNull()).withColumn("__n", F.sequence(F.lit(0), F.lit(SALT - 1)))
    slots = [
        df.withColumn("__n", F.explode("__n")).withColumn(
            "__slot",
            F.struct(F.col("__n").alias("n"), F.lit(kind).alias("kind")),
        ).drop("__n")
        for kind, df in enumerate((closed, lasting))
    ]
    met = keys.join(slots[0].unionByName(slots[1]), ["pattern", "__slot"]).filter(
        (F.col("__day") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("__day") < F.col("valid_to")))
    )
    best = met.groupBy("__row").agg(
        F.max(F.struct(F.length("pattern").alias("n"), "pattern", F.col("valid_from").alias("since"))).alias("__best")
    )
    out = rows.join(best, "__row", "left")
    return out.select(
        "__capture.*",
        "host",
        F.col("__best").isNotNull().alias("blocked"),
        F.col("__best.pattern").alias("pattern"),
        F.col("__best.since").alias("since"),
    )
