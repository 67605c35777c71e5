"""Fixed schemas of the tables the adapters produce (see FIXTURES.md section 2)."""

from __future__ import annotations

from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

RAW_JSON_TEXT = StructType([StructField("text", StringType(), True)])

RAW_DOC = StructType([
    StructField("doc_id", LongType(), False), StructField("corpus", StringType(), True),
    StructField("split", StringType(), True), StructField("text", StringType(), True)])

CLEAN_DOC = StructType([
    StructField("doc_id", LongType(), False), StructField("corpus", StringType(), True),
    StructField("text", StringType(), True), StructField("n_words", LongType(), True),
    StructField("n_sents", LongType(), True)])

PAIR = StructType([
    StructField("doc_id", LongType(), False), StructField("corpus", StringType(), True),
    StructField("input", StringType(), True), StructField("labels", StringType(), True)])

ENCODED = StructType([
    StructField("doc_id", LongType(), False), StructField("corpus", StringType(), True),
    StructField("input_ids", ArrayType(IntegerType(), False), True),
    StructField("attention_mask", ArrayType(IntegerType(), False), True),
    StructField("labels", ArrayType(IntegerType(), False), True),
    StructField("shard", IntegerType(), True)])

SCORED = StructType([
    StructField("doc_id", LongType(), False), StructField("corpus", StringType(), True),
    StructField("rank", IntegerType(), True), StructField("article", StringType(), True),
    StructField("gold", StringType(), True), StructField("summary", StringType(), True),
    StructField("rouge1", DoubleType(), True), StructField("rouge2", DoubleType(), True),
    StructField("rougeL", DoubleType(), True)])

# OSCAR-style crawl document: one nullable language entry per text line
CRAWL_DOC = StructType([
    StructField("id", LongType(), True), StructField("text", StringType(), True),
    StructField("meta", StructType([StructField("line_identifications", ArrayType(
        StructType([StructField("label", StringType(), True), StructField("prob", DoubleType(), True)]), True), True)]),
        True)])
