"""The corpus pipeline: five stages over ``documents``, each written and reread before the next.

1. language ID: documents without a recognisable language go.
2. SimHash near-dedup: one document of each group stays.
3. benchmark decontamination: contaminated documents go.
4. secret scans: each secret is replaced by a mask, and n_chars follows the text.
5. mixing: sources are brought to equal weight, and copies shuffled globally.

All but the last return the columns of documents. An empty table passes through as an empty one. Null texts count as
texts without a letter and go in the first stage; of repeated rows one stays in the second. Further columns, whatever
their names, travel along, but for those named as results of the last stage. Once a stage is written, what it read and
gathered on the way is deleted; the last stage's own input stays until ``discard_all`` or the folder's owner deletes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import decontam, langid, mixing, secrets, simhash
from caseloom.llm.common import discard, settled
from caseloom.llm.queries import language_model, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from documents that the contract does not hold out; rejects what has no letter."""
    return langid.predict(docs, language_model(docs)).where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
]

#: Trained models and fingerprints are beyond SQL: tests hold each stage, and run, against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
