"""Structured Streaming form of the row-local stages.

Cleaning (C1-C12), counts, truncation and the Arrow twins of GSG are per-row, so they
apply to a streaming DataFrame unchanged: ``readStream`` -> clean -> ``writeStream``.
No state, watermark or aggregation is involved (the reference has no time column);
exactly-once output comes from the file sink with its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions import text as T


def read_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def clean_stream(stream: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 preset: str = "module", is_news: bool = True) -> DataFrame:
    """Row-local cleaning with word and sentence counts, on a streaming DataFrame."""
    cleaned = stream.where(F.col(text_col).isNotNull()).select(
        id_col, T.clean_preset(F.col(text_col), preset, is_news).alias("text"))
    return cleaned.select(id_col, "text", T.word_count("text").alias("n_words"),
                          T.sentence_count("text").alias("n_sents"))


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 available_now: bool = True) -> StreamingQuery:
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
