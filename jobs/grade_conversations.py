"""Incremental job: grades the turns of conversations as they come, each once.

    python -m jobs.grade_conversations --config jobs/grade_conversations.json --conversations PATH --output PATH --checkpoint PATH

A file stream takes the Parquet files that its checkpoint doesn't know yet.  Every turn gets a key, its length and the
phase of its conversation: requirements are gathered until the assistant confirms them, follow-ups come next, and a
user's turn that is flagged ends it.  Below the output there are

* ``graded/batch=N/step=...``: the turns, by what they do;
* ``milestones/batch=N``: where conversations were first flagged or confirmed in that batch, which is all that later
  batches need to know of earlier ones.

A batch is written to folders of its own number, so that one that was broken off is replaced when it is run again, and a
rerun without new files changes nothing.  Turns that come in a later batch count as later, whatever their number.
The checkpoint and the output belong together.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.functions import text
from tarnfell.operators import assistant
from tarnfell.sources import readers

TURNS = "conv_id long, turn long, role string, text string"
GRADED = "conv_id long, turn long, role string, key string, n_words long, phase string, next_phase string, batch long, step string"
MILESTONES = "conv_id long, end_at struct<turn:long,role:string>, found_at struct<turn:long,role:string>, batch long"
ORDER = ("turn", "role")

log = logging.getLogger("grade_conversations")


def graded(turns: DataFrame, flag: str, confirm: str, earlier: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The turns with their grades, and the milestones that they set."""
    bad, done = F.lower("text").rlike(flag), F.lower("text").rlike(confirm)
    firsts = assistant.milestones(turns, "conv_id", ORDER, bad, done)
    rows = assistant.phases_by(turns, "conv_id", ORDER, bad, done, firsts, earlier)
    n_words = F.size(text.words(F.coalesce("text", F.lit("")))).cast("long")
    key = text.turn_key("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "turn", "role", key.alias("key"), n_words.alias("n_words"), "phase", "next_phase", "step"), firsts


def run(
    spark: SparkSession,
    conversations: str,
    output: str,
    checkpoint: str,
    flag: str,
    confirm: str,
    max_files: int | None = None,
) -> int:
    """Grade what is new below ``conversations``, in batches of at most ``max_files`` files; how many turns were new."""
    new = []

    def step(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        earlier = None
        if number:
            told = own.read.schema(MILESTONES).parquet(f"{output}/milestones").filter(F.col("batch") < number)
            earlier = told.join(batch.select("conv_id").distinct(), "conv_id", "left_semi")
        rows, firsts = graded(batch, flag, confirm, earlier)
        firsts.write.mode("overwrite").parquet(f"{output}/milestones/batch={number}")
        rows.write.mode("overwrite").partitionBy("step").parquet(f"{output}/graded/batch={number}")
        n_read, n_kept = batch.count(), own.read.schema(MILESTONES).parquet(f"{output}/milestones/batch={number}").count()
        n_written = read(own, output).filter(F.col("batch") == number).count()
        log.info("batch %d: read %d turns of %s", number, n_read, conversations)
        log.info("batch %d: wrote %d graded turns and %d milestones below %s", number, n_written, n_kept, output)
        new.append(n_read)

    stream = spark.readStream.schema(TURNS)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    started = stream.parquet(conversations).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    if not new:
        log.info("nothing new in %s", conversations)
    return sum(new)


def read(spark: SparkSession, output: str) -> DataFrame:
    """All turns that were graded; none where nothing was written yet."""
    return readers.parquet_or_empty(spark, f"{output}/graded", GRADED)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--config", required=True, help="a JSON file with the job's parameters")
    for name in ("conversations", "output", "checkpoint"):
        parser.add_argument(f"--{name}", help="in place of the config's")
    given = parser.parse_args(argv)
    with open(given.config) as f:
        config = json.load(f)
    config |= {k: v for k, v in vars(given).items() if k != "config" and v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("grade_conversations").getOrCreate()
    try:
        run(spark, **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
