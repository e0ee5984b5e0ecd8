"""The corpus pipeline: from raw documents to packed training sequences.

Stages, each over all that its predecessor kept:

1. ``quality``: documents that the classifier rejects go.
2. ``exact``: of equal texts, one stays.
3. ``near``: of each group of near duplicates, one stays.
4. ``pii``: personal data in the texts is replaced by placeholders.
5. ``pack``: the texts are tokenised and packed into sequences.

All stages but the last return the columns of ``documents``, whatever further ones there are.
Documents without an id, or with one that others have too, are each kept or dropped by their own
texts; of equal rows without an id one stays; rows that repeat both id and text share their fate;
null and empty texts have no near duplicates; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import exact_dedup, minhash, packing, pii, quality
from tessella.llm.common import broadcast_if_small, stored, table
from tessella.storage import mark, release


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``: a number of its own for each row without an id, written once so
    that it stays; null for the others."""
    absent = stored(docs.filter("doc_id IS NULL").withColumn("__row", F.monotonically_increasing_id()), "absent")
    return docs.filter("doc_id IS NOT NULL").withColumn("__row", F.lit(None).cast("long")).union(absent)


def _named(docs: DataFrame) -> DataFrame:
    """Names and texts of numbered documents. A name holds a hash of the text, so that rows which
    share an id are told apart, and the number of a row without an id; those come last among equals."""
    name = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col("__row").alias("row"))
    return docs.select(name.alias("doc_id"), "text")


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of numbered ``docs`` whose names aren't in ``dropped``."""
    gone = stored(dropped.select(*[F.col(f"doc_id.{k}").alias(f"__gone_{k}") for k in ("id", "hash", "row")]).distinct(), "dropped")
    same = F.col("doc_id").eqNullSafe(F.col("__gone_id")) & (F.xxhash64("text") == F.col("__gone_hash")) & F.col("__row").eqNullSafe(F.col("__gone_row"))
    return docs.join(broadcast_if_small(gone), same, "left_anti").drop("__row")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the quality classifier on the labels of these documents; keep those it predicts as good."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _numbered(docs)
    return _without(docs, exact_dedup.exact_groups(_named(docs)).filter("NOT doc_id <=> keep_id"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _numbered(docs)
    return _without(docs, minhash.near_duplicates(_named(docs)).filter("NOT doc_id <=> class_id"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs, "text", "n_chars")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("pii", pii_stage), ("pack", pack_stage)]

#: Fitted weights and tokenizers can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next; what a
    stage kept for itself goes once its result is written."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        release(spark, since, but=1)
    return STAGES[-1][1](spark, docs, sf_dir)
