"""Batch job: the stored keyword index of a table of documents, for searches of many queries.

    python -m jobs.build_index --config jobs/build_index.json --documents PATH --output PATH

Reads a Parquet table of documents and writes the three tables of :mod:`tarnfell.operators.index` below the output, with
postings partitioned by a hash of the term.  A rerun overwrites them with the same rows; a run
that was broken off is mended by running it again.
"""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.operators import index

log = logging.getLogger("build_index")


def run(
    spark: SparkSession,
    documents: str,
    output: str,
    id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
    block_docs: int = 256,
    buckets: int = 64,
) -> dict[str, int]:
    """Build the index of the table at ``documents`` below ``output``; how many rows were read and written."""
    docs = spark.read.parquet(documents)
    index.build(docs, id, text, output, keep=keep, block_docs=block_docs, buckets=buckets)
    rows = {"docs": spark.read.parquet(f"{output}/docs").count()}
    rows["postings"] = index.stored(spark, output).agg(F.sum("n")).first()[0] or 0  # without reading the lists
    log.info("read %d documents of %s", rows["docs"], documents)
    for name, n in rows.items():
        log.info("wrote %d rows to %s/%s", n, output, name)
    return rows


def read(spark: SparkSession, output: str) -> DataFrame:
    """The postings that were written."""
    return index.postings(spark, output)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--config", required=True, help="a JSON file with the job's parameters")
    parser.add_argument("--documents", help="in place of the config's")
    parser.add_argument("--output", help="in place of the config's")
    given = parser.parse_args(argv)
    with open(given.config) as f:
        config = json.load(f)
    config |= {k: v for k, v in vars(given).items() if k != "config" and v is not None}
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("build_index").getOrCreate()
    try:
        run(spark, **config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
