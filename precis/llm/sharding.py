"""Sharding by extendible hashing.

A shard is a bucket of rows whose hash starts with the same bits. A bucket over its byte limit is split on the next
bit, and only such buckets are: the directory is the table of the buckets within the limit whose parent is over it.
Bucket sizes come from one aggregate over several depths at once; what is still over the limit at the last of them
goes on with its own rows. Rows look their bucket up by the first bits they share with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

BITS = 60
STEP = 12  # depths counted at once


def row_hash(id_col: str, text_col: str) -> Column:
    """The first 60 bits of the MD5 of id and text (nulls as empty)."""
    whole = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("bigint")


def _prefix(hash_: str, depth: Column) -> Column:
    """The first ``depth`` bits of a 60-bit hash."""
    return F.call_function("shiftright", F.col(hash_), (F.lit(BITS) - depth).cast("int"))


def _levels(sizes: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """Buckets of the depths low..high: bytes, docs, whether they fit and whether their parent does not."""
    every = sizes.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high))))
    buckets = every.groupBy("depth", _prefix("hash", F.col("depth")).alias("prefix")).agg(
        F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("hash").alias("a"), F.max("hash").alias("b"))
    # rows of equal hash cannot be split by more bits
    buckets = settle(buckets.withColumn("fits", (F.col("bytes") <= limit) | (F.col("a") == F.col("b"))))
    parents = buckets.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"),
                             F.col("fits").alias("parent_fits"))
    return (buckets.withColumn("parent", F.expr("shiftright(prefix, 1)"))
            .join(parents, ["depth", "parent"], "left")
            .withColumn("leaf", F.col("fits") & ((F.col("depth") == low) | ~F.col("parent_fits"))))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """``rows`` (hash, bytes) -> (depth, prefix, bytes, docs), one row per shard. Every shard has at most ``limit``
    bytes, or all its rows have one hash (``place`` pages those)."""
    sizes = settle(rows.groupBy("hash").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs")))
    low, leaves, active = 0, None, sizes
    while True:
        high = min(low + STEP - 1, BITS)
        levels = settle(_levels(active, low, high, limit))
        found = levels.where("leaf").select("depth", "prefix", "bytes", "docs")
        leaves = found if leaves is None else leaves.unionAll(found)
        over = levels.where((F.col("depth") == high) & ~F.col("fits")).select(F.col("prefix").alias("_over"))
        if over.isEmpty():
            return leaves
        active = active.join(over, _prefix("hash", F.lit(high)) == F.col("_over"), "left_semi")
        low = high + 1


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, shard, n_bytes) for every row: ``shard`` is the bucket's bits, n_bytes the text's UTF-8 bytes.

    No shard exceeds ``limit`` bytes but that of one single text that does. Null and empty texts have 0 bytes. Rows
    repeated with id and text share a hash; where such rows alone exceed the limit, their bucket is paged: its shards
    are named bits, ``/``, page. An empty table has no shards."""
    rows = settle(docs.select(F.col(id_col).alias("_id"), row_hash(id_col, text_col).alias("hash"),
                              F.coalesce(F.octet_length(text_col).cast("bigint"), F.lit(0)).alias("bytes")))
    found = settle(directory(rows.select("hash", "bytes"), limit))
    least = found.agg(F.min("depth")).first()[0] or 0
    by_root = found.groupBy(F.expr(f"shiftright(prefix, depth - {least})").alias("_root")).agg(
        F.collect_list(F.struct("depth", "prefix", "bytes", "docs")).alias("_found"))  # a few buckets share a root
    placed = (rows.join(by_root, _prefix("hash", F.lit(least)) == F.col("_root"))
              .withColumn("_b", F.filter("_found", lambda x: x["prefix"] == F.call_function(
                  "shiftright", F.col("hash"), (F.lit(BITS) - x["depth"]).cast("int")))[0])
              .select("_id", "hash", "bytes", F.lpad(F.conv(F.col("_b.prefix").cast("string"), 10, 2),
                                                     F.col("_b.depth"), F.lit("0")).alias("shard"),
                      ((F.col("_b.bytes") > limit) & (F.col("_b.docs") > 1)).alias("_paged")))
    # rows of one hash: numbered within each task's share, so that many of them are no single group
    turn = Window.partitionBy("hash", "_task").orderBy("hash")
    paged = (placed.where("_paged").withColumn("_task", F.spark_partition_id())
             .withColumn("_page", F.floor((F.row_number().over(turn) - 1)
                                          / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes")))))
             .withColumn("shard", F.concat("shard", F.lit("/"), F.col("_task"), F.lit("."), F.col("_page"))))
    columns = [F.col("_id").alias(id_col), F.col("shard"), F.col("bytes").alias("n_bytes")]
    return placed.where(~F.col("_paged")).select(*columns).unionAll(paged.select(*columns))
