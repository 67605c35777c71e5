"""Filters, dedup and counts (F1-F7, G0-G0d, G0f)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dot_piece_count, sentence_count, word_count


def not_null(df: DataFrame, col: str = "text") -> DataFrame:            # F1 (pushed to the scan)
    return df.where(F.col(col).isNotNull())


def with_counts(df: DataFrame, col: str = "text", sentences: str = "tokenizer") -> DataFrame:
    """D1c + D2c (sentence splitter) or D3c (dot pieces)."""
    n_sents = sentence_count(F.col(col)) if sentences == "tokenizer" else dot_piece_count(F.col(col))
    return df.withColumn("n_words", word_count(F.col(col))).withColumn("n_sents", n_sents)


def filter_length(df: DataFrame, max_words: int = 500, min_sents: int = 3) -> DataFrame:   # F2
    return df.where((F.col("n_words") <= max_words) & (F.col("n_sents") >= min_sents))


def dedup_text(df: DataFrame, col: str = "text", id_col: str = "doc_id",
               count_col: str | None = None) -> DataFrame:
    """One row per distinct text, keyed by its smallest id. The aggregate is
    partial on the map side, so a text repeated in a third of all rows is collapsed
    per partition before the shuffle."""
    aggs = [F.min(id_col).alias(id_col)]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    return df.groupBy(col).agg(*aggs)


def count_if_short(df: DataFrame, by: str, max_words: int = 500) -> DataFrame:      # G0b, G0c
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"),
                              F.count_if(F.col("n_words") <= max_words).alias("n_short"))


def ceil_div(n_col, size: int):                                                    # G0d
    return F.ceil(F.col(n_col) / F.lit(size)).cast("bigint")


def over_threshold(df: DataFrame, col: str = "rouge1", threshold: float = 0.3) -> DataFrame:   # F6
    return df.where(F.col(col) > threshold)
