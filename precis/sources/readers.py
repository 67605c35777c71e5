"""Sources A1-A9: corpus scans, named splits, encoded shards, union of corpora.

All readers return lazy DataFrames; filters on partition columns (``lang``,
``split``, ``corpus``, ``shard``) prune directories, and ``text IS NOT NULL`` is pushed
to the Parquet scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import RAW_JSON_TEXT


def content_ids(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with an id that follows from the text alone: its MD5 and, for the copies of one text, their number from 0
    (``<md5>-0``, ``<md5>-1``, ..). The same rows in other files, or split in another way, get the same ids.

    Copies are alike, so any numbering will do: a row's number is its place among the copies in its input partition plus
    the copies in earlier partitions. A text that fills a third of the table is so dealt by partition, not by text."""
    rows = df.withColumn("_digest", F.md5(F.col(text_col))).withColumn("_part", F.spark_partition_id())
    here = Window.partitionBy("_digest", "_part")
    counts = rows.groupBy("_digest", "_part").agg(F.count("*").alias("_n"))
    # one row for each partition that holds the text; only texts in several partitions need an offset
    before = Window.partitionBy("_digest").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.sum("_n").over(before)).where("_before IS NOT NULL").select("_digest", "_part", "_before")
    numbered = rows.withColumn("_at", F.row_number().over(here.orderBy("_digest")) - 1)
    number = F.col("_at") + F.coalesce("_before", F.lit(0))
    return numbered.join(offsets, ["_digest", "_part"], "left").withColumn(
        id_col, F.concat_ws("-", "_digest", number.cast("string"))).drop("_digest", "_part", "_at", "_before")


def read_docs(spark: SparkSession, path: str | list[str], fmt: str = "parquet", text_col: str = "text",
              id_col: str | None = None, schema: StructType | str | None = None,
              options: dict | None = None, ids: str = "content") -> DataFrame:
    """A1/A2: JSON lines (plain, gzip or zstd -- decompressed by Spark's codecs) or
    Parquet; keeps rows whose text is not NULL. Output (doc_id, text).

    ``id_col`` names an id of any type, taken as it is. Without one, ``ids`` says what ids are made of: ``content``
    (see ``content_ids``; one shuffle) or ``file`` (Parquet: the file's name and the row's place in it; no shuffle, the
    same for every split of the same files)."""
    reader = spark.read.options(**(options or {}))
    if fmt == "json":
        df = reader.schema(schema or RAW_JSON_TEXT).json(path)
    elif fmt == "parquet":
        df = reader.parquet(*([path] if isinstance(path, str) else path))
    elif fmt == "text":
        df = reader.text(path).withColumnRenamed("value", text_col)
    else:
        raise ValueError(fmt)
    df = df.where(F.col(text_col).isNotNull())
    text = F.col(text_col).alias("text")
    if id_col:
        return df.select(F.col(id_col).alias("doc_id"), text)
    if ids == "file":
        if fmt != "parquet":
            raise ValueError("only Parquet rows have a place in their file")
        return df.select(F.concat_ws(":", "_metadata.file_name", F.col("_metadata.row_index").cast("string")).alias("doc_id"), text)
    if ids != "content":
        raise ValueError(f"unknown ids {ids!r}")
    return content_ids(df.select(text)).select("doc_id", "text")


def read_splits(spark: SparkSession, files: dict[str, list[str]], schema: StructType | str | None = None,
                fmt: str = "json") -> DataFrame:
    """A3: one read per named split with a ``split`` literal column, UNION ALL."""
    parts = []
    for split, paths in files.items():
        r = spark.read.schema(schema) if schema is not None else spark.read
        df = r.json(paths) if fmt == "json" else r.parquet(*paths)
        parts.append(df.withColumn("split", F.lit(split)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_named(spark: SparkSession, root: str, name: str, lang: str | None = None,
               split: str | None = None) -> DataFrame:
    """A4: a corpus laid out as ``root/name/lang=../split=..``; the filters prune
    partitions (no download: corpora are expected on shared storage)."""
    df = spark.read.parquet(f"{root.rstrip('/')}/{name}")
    if lang is not None:
        df = df.where(F.col("lang") == lang)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df


def read_encoded(spark: SparkSession, path: str, num_files: int | None = None, files: list[str] | None = None,
                 max_len: int | None = None, max_label_len: int | None = None) -> DataFrame:
    """Encoded shards written by ``write_shards`` (partitioned by ``shard``).
    ``num_files`` keeps shards 0..n-1 (partition pruning); ``files`` reads an explicit
    list. Fixed widths are asserted instead of re-shaping raw bytes."""
    df = spark.read.parquet(*files) if files else spark.read.parquet(path)
    if num_files is not None:
        df = df.where(F.col("shard") < num_files)
    checks = []
    if max_len is not None:
        checks.append(F.assert_true(F.size("input_ids") == max_len, "input_ids width"))
        checks.append(F.assert_true(F.size("attention_mask") == max_len, "attention_mask width"))
    if max_label_len is not None:
        checks.append(F.assert_true(F.size("labels") == max_label_len, "labels width"))
    if checks:
        df = df.where(F.coalesce(*checks).isNull())
    return df


def union_corpora(corpora: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL with a ``corpus`` literal, no dedup."""
    parts = [df.withColumn("corpus", F.lit(name)) for name, df in corpora.items()]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.select("corpus", *[c for c in u.columns if c != "corpus"])


def columns_to_rows(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Equal-length array columns zipped into rows (``inline(arrays_zip(...))``)."""
    keep = keep or []
    return df.select(*keep, F.inline(F.arrays_zip(*[F.col(c) for c in cols])))
