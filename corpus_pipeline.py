"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut out,
documents with benchmark passages go, and what is left is packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm import q_packing, q_simhash, q_suffix, q_toxicity
from precis.llm.common import settle, table
from precis.llm.decontaminate import drop_contaminated
from precis.llm.simhash import drop_near_duplicates
from precis.llm.suffix import remove_repeats
from precis.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score as toxic."""
    return drop_toxic(docs, q_toxicity.model(spark, sf_dir, docs), threshold=q_toxicity.THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return drop_near_duplicates(docs, shingle=q_simhash.SHINGLE, max_distance=q_simhash.MAX_DISTANCE)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur elsewhere, too; n_chars follows."""
    return remove_repeats(docs, length=q_suffix.LENGTH).withColumn("n_chars", F.length("text").cast("bigint"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in the sequences."""
    return q_packing.packed(docs)


STAGES = [("toxicity", toxicity), ("simhash_dedup", near_dedup), ("suffix_dedup", passage_dedup),
          ("decontaminate", decontaminate), ("pack", pack)]

ORACLE_SQL = None  # trained scores, hashes and token ids: held against brute force in tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
