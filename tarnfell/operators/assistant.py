"""Conversations: the state that turns lead to, and what a model is told of those before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: In the order in which a conversation goes through them.
PHASES = ("gather", "followup", "end")


def phases(turns: DataFrame, conversation: str, order: Sequence[str], flagged: Column, confirmed: Column) -> DataFrame:
    """``turns`` with ``phase`` (before the turn), ``next_phase`` and ``step``, what the turn does.

    A user's turn that is flagged ends the conversation, and nothing is done any more.  While requirements are gathered
    a reply that has them all leads to a search and a recommendation, after which turns are follow-ups.
    """
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    marked = turns.withColumn("__end", (user & flagged).cast("int")).withColumn("__done", (reply & confirmed).cast("int"))
    before = W.partitionBy(conversation).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(conversation).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = lambda c, w: F.coalesce(F.max(c).over(w), F.lit(0)) == 1
    # A confirmation counts only where the conversation hasn't ended by then.
    marked = marked.withColumn("__ended", seen("__end", before)).withColumn(
        "__done",
        F.when(F.col("__ended"), 0).otherwise(F.col("__done")),
    )
    marked = marked.withColumn("__found", seen("__done", before))
    phase = F.when(F.col("__ended"), "end").when(F.col("__found"), "followup").otherwise("gather")
    after = F.when(seen("__end", upto), "end").when(seen("__done", upto), "followup").otherwise("gather")
    step = (
        F.when(F.col("__ended"), "ignored")
        .when(F.col("__end") == 1, "flagged")
        .when(F.col("__found"), "followup")
        .when(F.col("__done") == 1, "recommend")
        .otherwise("gather")
    )
    return marked.withColumns({"phase": phase, "next_phase": after, "step": step}).drop("__end", "__done", "__ended", "__found")


def histories(turns: DataFrame, conversation: str, order: Sequence[str], most: int = 20) -> DataFrame:
    """Each user's turn with ``history``: the last ``most`` messages up to it, as a model is told them."""
    upto = W.partitionBy(conversation).orderBy(*order).rowsBetween(-most + 1, W.currentRow)
    said = F.collect_list(F.struct("role", "text")).over(upto)
    return turns.filter(F.col("role").isin("user", "assistant")).withColumn("history", said).filter("role = 'user'")


def milestones(turns: DataFrame, conversation: str, order: Sequence[str], flagged: Column, confirmed: Column) -> DataFrame:
    """(conversation, end_at, found_at): where a conversation is first flagged and first confirmed, for those that are.

    Two minima a conversation, added up task by task: a conversation that holds most of the turns is no burden, and those
    of turns that come later can be kept beside those of turns that came before.
    """
    at = F.struct(*order)
    ends, finds = (F.col("role") == "user") & flagged, (F.col("role") == "assistant") & confirmed
    firsts = turns.groupBy(conversation).agg(F.min(F.when(ends, at)).alias("end_at"), F.min(F.when(finds, at)).alias("found_at"))
    return firsts.filter(F.col("end_at").isNotNull() | F.col("found_at").isNotNull())


def phases_by(
    turns: DataFrame,
    conversation: str,
    order: Sequence[str],
    flagged: Column,
    confirmed: Column,
    firsts: DataFrame,
    earlier: DataFrame | None = None,
    salt: int = 8,
) -> DataFrame:
    """What :func:`phases` adds, from the milestones of these turns (``firsts``) and of all turns taken before
    (``earlier``), which count as before every one of these.

    Turns of one conversation are dealt out over ``salt`` tasks, to each of which its milestones go.
    """
    both = firsts.select(conversation, "end_at", "found_at", F.lit(False).alias("ended"), F.lit(False).alias("found"))
    if earlier is not None:
        was = lambda c, name: F.col(c).isNotNull().alias(name)
        none = [F.lit(None).cast(firsts.schema[c].dataType).alias(c) for c in ("end_at", "found_at")]
        both = both.unionByName(earlier.select(conversation, *none, was("end_at", "ended"), was("found_at", "found")))
    known = both.groupBy(conversation).agg(
        F.min("end_at").alias("__end_at"), F.min("found_at").alias("__found_at"), F.max("ended").alias("__ended"), F.max("found").alias("__found")
    ).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    met = turns.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salt)).cast("int")).join(known, [conversation, "__salt"], "left")
    at = F.struct(*order)
    true = lambda c: F.coalesce(c, F.lit(False))
    ended = true(F.col("__ended")) | true(F.col("__end_at") < at)
    found = true(F.col("__found")) | true(F.col("__found_at") < at)
    bad, done = true((F.col("role") == "user") & flagged), true((F.col("role") == "assistant") & confirmed)
    phase = F.when(ended, "end").when(found, "followup").otherwise("gather")
    after = F.when(ended | bad, "end").when(found | done, "followup").otherwise("gather")
    step = F.when(ended, "ignored").when(bad, "flagged").when(found, "followup").when(done, "recommend").otherwise("gather")
    return met.withColumns({"phase": phase, "next_phase": after, "step": step}).drop("__salt", "__end_at", "__found_at", "__ended", "__found")
