"""The corpus pipeline: toxicity, quality rules, near duplicates, PII, packing.

Each stage works on all rows that the one before it kept. All but the last return
the columns of documents; the last gives each kept document's sequences and batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import minhash, pii, queries, repetition, toxicity
from gridloom.llm.common import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5. The classifier learns from the labels of sf_dir."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repetition.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new text."""
    rows = pii.pseudonymise(docs, queries.surrogate_key(spark))
    return rows.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in rows.columns else rows


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.pack_tokens(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_pii),
    ("packing", pack),
]

#: No stage before packing can be written in SQL: a trained classifier, rolling hashes, signatures, keyed digests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
