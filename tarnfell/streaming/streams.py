"""Structured Streaming forms of the log, memory and cache behaviours; windows are extensions."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarnfell.operators.lineage import cut, fresh_folder
from tarnfell.sources import readers


def events(
    spark: SparkSession,
    pattern: str,
    schema: str = "event_id long, ts timestamp, user_id long, event_type string, value double, props string",
) -> DataFrame:
    return spark.readStream.schema(schema).parquet(pattern)


def windowed(stream: DataFrame, window: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are not waited for."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("value").alias("total"),
    ).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(
        "user_id",
        F.col("w.start").alias("start"),
        F.col("w.end").alias("end"),
        "n",
    )


def last_values(stream: DataFrame, n: int = 10) -> DataFrame:
    """After each batch the mean of each user's last n values, from a ring buffer of n (time, id, value)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [list(x) for x in zip(*state.get)] if state.exists else []
        for f in frames:
            held += f[["t", "event_id", "value"]].values.tolist()
        held = sorted(held)[-n:]
        state.update(
            tuple(
                [float(r[0]) for r in held]
                if i == 0 else [int(r[1]) for r in held]
                if i == 1 else [float(r[2]) for r in held]
                for i in range(3)
            )
        )
        yield pd.DataFrame({"user_id": [key[0]], "n": [len(held)], "mean": [sum(r[2] for r in held) / len(held)]})

    rows = stream.filter("value is not null").select("user_id", F.col("ts").cast("double").alias("t"), "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(
        step,
        "user_id long, n long, mean double",
        "t array<double>, ids array<long>, vs array<double>",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def conversations(stream: DataFrame) -> DataFrame:
    """(conv_id, turn, phase, next_phase) of turns (conv_id, turn, role, flagged, confirmed) as they come.

    The state of a conversation is its phase; the turns of a batch are taken in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        phase = state.get[0] if state.exists else "gather"
        out = []
        turns = pd.concat(list(frames)).sort_values(["turn", "role"], kind="stable")
        for turn, role, bad, done in zip(turns["turn"], turns["role"], turns["flagged"], turns["confirmed"]):
            was = phase
            if phase != "end" and role == "user" and bad:
                phase = "end"
            elif phase == "gather" and role == "assistant" and done:
                phase = "followup"
            out.append((key[0], turn, was, phase))
        state.update((phase,))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "phase", "next_phase"])

    return stream.groupBy("conv_id").applyInPandasWithState(
        step,
        "conv_id long, turn long, phase string, next_phase string",
        "phase string",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def cached_lookups(
    stream: DataFrame,
    key: str,
    look_up: Callable[[str], str | None],
    ttl_s: float,
    clock: Callable[[], float] = time.time,
    evict: bool = True,
) -> DataFrame:
    """(key, result, hit): results, none included, are kept for ``ttl_s`` and looked up again when they are older.

    With ``evict`` what is too old leaves the state by a timer, which keeps a stream running; without, it stays until it
    is asked for again, and a finite stream ends.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked, now = sum(len(f) for f in frames), clock()
        at, result = state.get if state.exists else (None, None)
        hit = at is not None and now - at < ttl_s
        if not hit:
            at, result = now, look_up(name[0])
            state.update((at, result))
        if evict:
            state.setTimeoutDuration(int(ttl_s * 1000))
        if asked:
            yield pd.DataFrame({"key": [name[0]] * asked, "result": [result] * asked, "hit": [hit] + [True] * (asked - 1)})
        elif state.hasTimedOut:
            state.remove()

    rows = stream.select(F.col(key).cast("string").alias("key"))
    return rows.groupBy("key").applyInPandasWithState(
        step,
        "key string, result string, hit boolean",
        "at double, result string",
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if evict else GroupStateTimeout.NoTimeout,
    )


def logged(stream: DataFrame, path: str, score: Callable[[DataFrame], DataFrame], scores: str, checkpoint: str):
    """Appends each batch of turns to a log of JSON lines, and then its scores to a table; a batch that is run again
    replaces what it had written, in a folder of its own number."""

    def step(batch: DataFrame, number: int) -> None:
        log = f"{path}/batch={number}"
        batch.write.mode("overwrite").json(log)
        turns = batch.sparkSession.read.schema(batch.schema).json(log)
        score(turns).write.mode("overwrite").parquet(f"{scores}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def generate_once(stream: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Works on what isn't done yet, batch by batch: what was made is in ``path/made``, the keys of it in ``path/done``.

    Only keys are looked at again, never what was made of them.  A batch writes to folders of its number and of its
    checkpoint, and leaves out of what is done what it had written there itself: run again, it does the same again.
    """
    kind = f"{stream.select(key).schema[0].simpleString().replace(':', ' ', 1)}, run string, batch long"
    mine = hashlib.md5(checkpoint.encode()).hexdigest()

    def step(batch: DataFrame, number: int) -> None:
        done = readers.parquet_or_empty(batch.sparkSession, f"{path}/done", kind)
        others = done.filter((F.col("run") != mine) | (F.col("batch") != number)).select(key)
        todo = cut(batch.filter(F.col(key).isNotNull()).join(others, key, "left_anti").dropDuplicates([key]))
        work(todo).write.mode("overwrite").parquet(f"{path}/made/run={mine}/batch={number}")
        todo.select(key).write.mode("overwrite").parquet(f"{path}/done/run={mine}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def generated(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`generate_once` has made."""
    return spark.read.parquet(f"{path}/made").drop("run", "batch")


def drained(stream: DataFrame, mode: str, tag: str) -> DataFrame:
    """Everything that a finite stream gives, as a table in the shared folder: the last batch's rows in complete mode,
    else all batches' rows with their batch number.  A batch that is run again replaces what it had written."""
    spark = stream.sparkSession
    out, progress = fresh_folder(spark, f"{tag}-rows"), fresh_folder(spark, f"{tag}-progress")

    def keep(batch: DataFrame, number: int) -> None:
        if mode == "complete":
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(out)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
