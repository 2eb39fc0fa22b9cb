"""Training-data pipeline over ``documents``.

Each stage works on all that the one before it kept. All but the last return the columns
of documents; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import decontam, langid, near, packing, secrets
from pagegrain.llm.common import load, small_batches
from pagegrain.sources.scratch import materialize

SURE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with a probability of at least ``SURE``.

    The model learns from the documents of the training folds. Without any label nothing
    is known, and nothing stays. Null text and text without a letter go.
    """
    known = docs.select("doc_id", "text", "lang")
    model = langid.train(known.where(~langid.held_out("doc_id", 4)))
    found = langid.identify(docs, model, ("_lang_pred", "_lang_score"))
    return found.where((F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_lang_score") >= SURE)).select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least id."""
    return near.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and ``n_chars`` following the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(load(docs))


STAGES = [
    ("language_id", language),
    ("near_dedup", dedup),
    ("decontamination", decontaminate),
    ("secret_scans", redact),
    ("packing", pack),
]
#: Models, signatures, walks and tokens have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with small_batches(spark):
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
