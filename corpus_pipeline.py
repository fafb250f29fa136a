"""The corpus pipeline: stages over `documents`, each written and read again before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinvec.llm.common import durable, restricted
from kinvec.llm.decontamination import contamination
from kinvec.llm.near_dedup import drop_near_duplicates
from kinvec.llm.packing import pack_documents
from kinvec.llm.pii import DEMONSTRATION_KEY, pseudonymised
from kinvec.llm.quality import keep_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each class of near duplicates stays."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a window of a benchmark item."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return restricted(docs, durable(found.where(F.size("spans") > 0).select("doc_id")), inside=False)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the new text."""
    out = pseudonymised(docs, DEMONSTRATION_KEY, "_entities").drop("_entities")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    return pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pii_surrogates", surrogates),
    ("pack", pack),
]
#: Expectation-maximisation, sampling and tokenization have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
