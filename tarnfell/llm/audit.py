"""How the filters of a corpus work together: what each removes alone, first, last, and on average over all orders.

A document is a vector of failures.  Only the joint failures J(S), the number of documents that fail every filter in S,
are gathered, as sums of products of flags, one for each of the 32 sets of five filters.  All else follows by inclusion
and exclusion, without another look at the documents.  With P the filters applied before filter i:

* survivors of P: the sum over S within P of (-1)^|S| J(S);
* removed by i after P: the sum over S within P of (-1)^|S| J(S + i); redundant: J(i) less that;
* failing i only: the sum over S holding i of (-1)^(|S|-1) J(S);
* the game "number removed by a set of filters" has the Harsanyi dividends (-1)^(|S|+1) J(S); a filter's Shapley value is
  the sum of the dividends of its sets, each shared out evenly.  Times the number of orders it is what the filter
  removes, summed over all orders.

Defined results: a null text is empty; a null part is the empty string; a document that has no label is neither good nor
toxic, one with several labels is if any of them says so; null ids have no labels, and as they aren't smaller than any id
nor any smaller than them, they are never copies; rows that are equal throughout count as often as they stand, none a copy
of the other; an empty table gives no rows; further columns are ignored.  Two texts count as identical if their SHA-256
digests are.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfell.llm import scratch

#: Parts of a document's id in the join with labels, so that rows that share one id needn't share a task.
SALT = 8
_CAPITALS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"


def failures(text: str) -> tuple[bool, bool, bool, bool, bytes]:
    """What a text fails by itself (short, repetitive, shouting, holding symbols), and its digest.

    Bytes are split at ASCII white space and nowhere else, which is what a word's definition asks for.
    """
    raw = text.encode()
    words = raw.split()
    return (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 3 * len(text),
        len(raw) > len(raw.translate(None, _SYMBOLS)),
        hashlib.sha256(raw).digest(),
    )


def own_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest and the failures that a text tells by itself, in one pass over Arrow batches.

    The same in column functions takes some ten times the CPU: each word becomes a string of its own twice over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [failures(t) for t in batch.column(2).to_pylist()]
            flags = [pa.array([f[i] for f in found], pa.bool_()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([f[4] for f in found], pa.binary()), *flags], names=names)

    names = ["doc_id", "part", "digest", *"ABCD"]
    told = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, part string, digest binary, A boolean, B boolean, C boolean, D boolean"
    return told.mapInArrow(run, schema).select("doc_id", "part", "digest", *[F.col(f).cast("int").alias(f) for f in "ABCD"])


def flagged(docs: DataFrame, labels: DataFrame, copies: str = "E") -> DataFrame:
    """part, one flag (0 or 1) a filter, good, toxic, n: every document's failures, equal rows counted together.

    Texts are read once and leave as a digest.  A document is a copy unless its id is the smallest of its digest: the
    smallest ids are found by partial sums, and looked up by digest *and* id, which no group of copies shares.  Labels are
    merged, never broadcast: their rows are as many as documents and are listed once a salt, which no estimate knows of.
    """
    told = own_failures(docs)
    told = scratch.materialize(told.groupBy(*told.columns).agg(F.count(F.lit(1)).alias("n")), "audit-failures")
    once = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    ).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    names, named = "ABCD", told.filter("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    zero = lambda c: F.coalesce(c, F.lit(0))
    known = (
        named.join(first, ["digest", "doc_id"], "left")
        .withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALT)).cast("int"))
        .join(once.hint("merge"), ["doc_id", "salt"], "left")
        .select("part", *names, (1 - zero("first")).alias(copies), zero("good").alias("good"), zero("toxic").alias("toxic"), "n")
    )
    unnamed = told.filter("doc_id IS NULL").select("part", *names, *[F.lit(0).alias(c) for c in (copies, "good", "toxic")], "n")
    return known.unionByName(unnamed)


def joint_failures(flags: DataFrame, filters: Sequence[str]) -> DataFrame:
    """part and three arrays, of all, good and toxic documents: at place S the documents that fail all filters of the set
    S, whose bits are the places of its filters.  Sums of products of flags; a task sends one row a part."""
    counted = {"all": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    sets = range(1 << len(filters))
    product = lambda s, n: reduce(Column.__mul__, [F.col(f) for i, f in enumerate(filters) if s >> i & 1], n)
    sums = {(k, s): F.sum(product(s, n)).cast("long") for k, n in counted.items() for s in sets}
    got = flags.groupBy("part").agg(*[v.alias(f"{k}_{s}") for (k, s), v in sums.items()])
    return got.select("part", *[F.array(*[f"{k}_{s}" for s in sets]).alias(k) for k in counted])


def interactions(joint: DataFrame, filters: Sequence[str]) -> DataFrame:
    """One row a part, order of the filters and step, from the joint failures alone."""
    bits = {f: 1 << i for i, f in enumerate(filters)}
    size, n_orders = len(filters), math.factorial(len(filters))
    orders = F.lit(["".join(o) for o in itertools.permutations(filters)])
    steps = joint.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(size))))
    done = F.expr("substring(filter_order, 1, step - 1)")
    now = F.expr("substring(filter_order, step, 1)")
    bit = reduce(lambda a, f: F.when(now == f, F.lit(bits[f])).otherwise(a), filters, F.lit(0))
    before = reduce(Column.__add__, [F.when(F.contains(done, F.lit(f)), F.lit(b)).otherwise(0) for f, b in bits.items()])
    steps = steps.withColumn("bit", bit).withColumn("before", before)
    every = F.sequence(F.lit(0), F.lit((1 << size) - 1))
    sign = lambda s: 1 - 2 * (F.bit_count(s) % 2)

    def inverted(counts: str, within: Column, plus: Column) -> Column:
        """The sum over the sets S within ``within`` of (-1)^|S| J(S + plus)."""
        term = lambda s: F.when(s.bitwiseAND(within) == s, sign(s) * F.get(counts, s.bitwiseOR(plus))).otherwise(F.lit(0))
        return F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + term(s).cast("long"))

    def dividends(weight: Column | None = None) -> Column:
        """The sum over the sets that hold the filter of (-1)^(|S|+1) J(S), times the orders a member of S if asked."""

        def term(s: Column) -> Column:
            share = F.lit(1) if weight is None else (weight / F.bit_count(s)).cast("long")
            return F.when(s.bitwiseAND(F.col("bit")) != 0, -sign(s) * share * F.get("all", s)).otherwise(F.lit(0))

        return F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + term(s).cast("long"))

    bit, before = F.col("bit"), F.col("before")
    removed = inverted("all", before, bit)
    return steps.select(
        "part",
        "filter_order",
        "step",
        inverted("all", before.bitwiseOR(bit), F.lit(0)).alias("kept"),
        removed.alias("removed"),
        (F.get("all", bit) - removed).alias("redundant"),
        dividends().alias("unique_fails"),
        inverted("good", before, bit).alias("good_lost"),
        inverted("toxic", before, bit).alias("toxic_lost"),
        dividends(F.lit(n_orders)).alias("shapley"),
    )


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over whole documents; only the joint failures of each part outlast their making."""
    spark, filters = docs.sparkSession, "ABCDE"
    here = scratch.folder(spark)
    with scratch.scope(spark):
        joint = joint_failures(flagged(docs, labels), filters)
        joint = scratch.materialize(joint, "audit-joint", within=here)
    return interactions(joint, filters)
