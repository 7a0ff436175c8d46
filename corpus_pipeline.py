"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, personal data is masked, the
sources are mixed to their weights, and what remains is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of ``documents``.  ``run`` deletes a stage's intermediate tables once what it returns has been written.

Defined results: null ids, texts and sources pass through; rows that repeat an id are told apart by their content; of
rows that are equal throughout one stays; an empty table gives empty tables; further columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfell.llm import bpe, mixing, pii, scratch, similar, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _content() -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64("text", "lang", "source")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the positive-unlabelled classifier doesn't call toxic; labels of all folds are the benchmark's to keep."""
    docs = docs.select(*COLUMNS)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, name="toxicity").filter("toxicity < 0.5").drop("toxicity")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id (then the smallest content hash).

    Near duplicates are alike in 0.8 of their five-word shingles, which fingerprints of 64 bits at op6's radius don't
    reach: SimHash trees over wider ones find candidates, and each link is checked on the texts.
    """
    docs = docs.select(*COLUMNS).withColumn("content", _content())
    # A null id sorts first; it stands for its group only where no id does.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("content").alias("c"), "rows"))
    here = scratch.folder(spark)
    with scratch.scope(spark):  # the tables of the search go as soon as it is known what stays
        found = similar.near_duplicates(docs, keep=("doc_id", "content"))
        alike = found.groupBy("component", "doc_id", "content").agg(F.count(F.lit(1)).alias("rows"))
        kept = alike.groupBy("component").agg(first.alias("k")).select("k.id", "k.c", "k.rows")
        kept = scratch.materialize(kept, "pipeline-kept", within=here)

    def chosen(those: DataFrame) -> DataFrame:
        return docs.join(those, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("c"))).select(*docs.columns)

    # Rows that are equal throughout meet before they move: few or none, and then this side's keys are few as well.
    equal = chosen(kept.filter("rows > 1")).groupBy("doc_id", "content").agg(*[F.first(c).alias(c) for c in COLUMNS if c != "doc_id"])
    return chosen(kept.filter("rows = 1")).select(*COLUMNS).unionByName(equal.select(*COLUMNS))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data replaced by the name of its kind."""
    clean = pii.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: never, once or twice."""
    docs = docs.select(*COLUMNS).withColumn("content", _content())
    here = scratch.folder(spark)
    with scratch.scope(spark):
        sizes = docs.select("doc_id", "content", "source", mixing.words().alias("size"))
        keys = sizes.groupBy("doc_id", "content", "source").agg(F.sum("size").alias("size"))  # texts are read once
        mixed = mixing.mix_sizes(scratch.materialize(keys, "pipeline-keys"), carry=("content",)).filter("copies > 0")
        taken = mixed.select(F.col("doc_id").alias("id"), F.col("content").alias("c"), "copies")
        taken = scratch.materialize(taken, "pipeline-copies", within=here)
    met = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("c")))
    return met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, and whether decoding the ids gives the text again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, round_trip="round_trip", keep=("doc_id", "source"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Learned scores, hashes and balanced rates have no SQL form; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read again, and goes when the
    next one's has been written.  Only the last stage's stays, until :func:`scratch.release`."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    path = f"{scratch.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = f"{path}/{name}"
        with scratch.scope(spark):
            stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            scratch.drop(spark, before)
        before = out
    return docs
