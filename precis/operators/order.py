"""Seeded global order, exact row index, split, batch and shard (G1-G7, B4, B5, G0d).

The reference shuffles through a bounded buffer and then takes / skips rows by
position. Here the order is a total order on (md5(id|seed), id), and the position of
every row is computed exactly without a single-task window:

1. bucket  = the first 60 bits of the hash, scaled to B buckets (monotone in the order,
             uniform because the ids are unique);
2. rank    = row_number inside the bucket (one exchange on the bucket, ~n/B rows each);
3. offset  = rows in all earlier buckets, from a B-row count table (bounded by B, so it
             is broadcast);
4. idx     = offset + rank - 1.

Everything is a function of the data, so a recomputed task after an executor loss
yields the same index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_partitions

_TWO_60 = float(2 ** 60)


def order_key(id_col: Column | str, seed: int) -> Column:
    """md5 hex of 'id|seed' -- the same string in Spark and in the DuckDB oracle."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws("|", c.cast("string"), F.lit(str(seed))))


def _bucket(hex_key: Column, buckets: int) -> Column:
    h = F.conv(F.substring(hex_key, 1, 15), 16, 10).cast("bigint")
    return F.least(F.floor(h.cast("double") / F.lit(_TWO_60 / buckets)).cast("int"), F.lit(buckets - 1))


def with_index(df: DataFrame, id_col: str, seed: int, buckets: int | None = None,
               idx_col: str = "idx", total_col: str | None = None) -> DataFrame:
    """Adds the 0-based position of every row in the seeded order (and the total)."""
    b = buckets or shuffle_partitions(df.sparkSession)
    keyed = (df.withColumn("_okey", order_key(id_col, seed))
               .withColumn("_bucket", _bucket(F.col("_okey"), b)))
    ranked = keyed.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy("_okey", id_col)))
    # counted from the ranked rows: reuses the window's exchange instead of
    # recomputing whatever produced ``df``
    counts = ranked.groupBy("_bucket").agg(F.max("_rn").alias("_n"))
    # B rows: one partition is fine here, and the result is broadcast (bounded by B).
    all_b = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(all_b), F.lit(0)).alias("_off"),
        F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"),
    )
    out = ranked.join(F.broadcast(offsets), "_bucket")
    out = out.withColumn(idx_col, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
    if total_col:
        out = out.withColumn(total_col, F.col("_total").cast("bigint"))
    return out.drop("_okey", "_bucket", "_rn", "_off", "_total")


def nth_key(df: DataFrame, key_col: str, n: int, digits: int = 4, few: int = 10_000) -> str | None:
    """The ``n``-th smallest hash (from 1, repeats counted) of a hex column; None where the table has fewer rows.

    Radix selection: rows are counted by their next ``digits`` hex digits (at most 16 ** digits numbers, summed per
    partition first), and only the digits that hold the n-th row are looked into further. One pass over the keys does for
    up to some 6e8 rows; no row is moved but the last ``few`` at most."""
    if n < 1:
        return None
    prefix, width = "", 32
    while len(prefix) < width:
        rows = df.where(F.col(key_col).startswith(prefix)) if prefix else df
        head = F.substring(key_col, 1, len(prefix) + digits).alias("head")
        counts = sorted((r["head"], r["n"]) for r in rows.groupBy(head).agg(F.count(F.lit(1)).alias("n")).collect())
        for head, count in counts:
            if n <= count:
                break
            n -= count
        else:
            return None
        prefix = head
        if count <= few:
            last = df.where(F.col(key_col).startswith(prefix)).select(key_col).orderBy(key_col).limit(n).collect()
            return last[-1][0]
    return prefix


def batched_splits(df: DataFrame, id_col: str, val_size: int, batch_size: int, seed: int,
                   buckets: int | None = None) -> DataFrame:
    """G2-G5 in one exchange of the rows: adds split ('validation': the first ``val_size`` rows of the seeded order), and in
    each split batch_id, pos and batch_order as ``batch_rows`` gives them (seeds + 1 and + 3; last partial batch
    dropped).

    The split needs no position, only the hash of the last validation row (``nth_key``), so a row's split is known before
    the exchange, and one index keyed (split, hash) gives its place. Rows that repeat the id of the last validation row
    are all validation rows, so no id stands in both splits. An empty table gives no rows."""
    b = buckets or shuffle_partitions(df.sparkSession)
    keyed = df.withColumn("_okey", order_key(id_col, seed))
    last = nth_key(keyed.select("_okey"), "_okey", val_size)
    if last is None:
        inside = F.lit(val_size > 0)
    else:
        inside = F.col("_okey") <= F.lit(last)
    split = F.when(inside, F.lit("validation")).otherwise(F.lit("train"))
    place = F.when(F.col("split") == "validation", order_key(id_col, seed + 1)).otherwise(order_key(id_col, seed + 3))
    placed = keyed.withColumn("split", split).withColumn("_okey", place).withColumn("_bucket", _bucket(F.col("_okey"), b))
    ranked = placed.withColumn(
        "_rn", F.row_number().over(Window.partitionBy("split", "_bucket").orderBy("_okey", id_col)))
    counts = ranked.groupBy("split", "_bucket").agg(F.max("_rn").alias("_n"))
    earlier = Window.partitionBy("split").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("split", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy("split")).alias("_total"))   # 2B rows
    i = F.col("_off") + F.col("_rn") - 1
    out = (ranked.join(F.broadcast(offsets), ["split", "_bucket"])
                 .withColumn("batch_id", F.floor(i / batch_size).cast("bigint"))
                 .withColumn("pos", F.pmod(i, F.lit(batch_size)).cast("int"))
                 .where(F.col("batch_id") < F.floor(F.col("_total") / batch_size)))
    after = F.when(F.col("split") == "validation", order_key(F.col("batch_id"), seed + 2)).otherwise(
        order_key(F.col("batch_id"), seed + 4))
    return out.withColumn("batch_order", after).drop("_okey", "_bucket", "_rn", "_off", "_total")


def assign_shards(df: DataFrame, id_col: str, rows_per_shard: int, mode: str = "contiguous",
                  seed: int | None = None, idx_col: str = "idx") -> DataFrame:
    """shard = floor(idx / rows_per_shard) (contiguous) or idx % ceil(n / rows_per_shard)
    (strided). Without a seed the order is the id order (the reference keeps row order)."""
    if seed is None:
        indexed = with_index_by_id(df, id_col, idx_col=idx_col, total_col="_n_total")
    else:
        indexed = with_index(df, id_col, seed, idx_col=idx_col, total_col="_n_total")
    if mode == "contiguous":
        shard = F.floor(F.col(idx_col) / F.lit(rows_per_shard))
    elif mode == "strided":
        shard = F.pmod(F.col(idx_col), F.ceil(F.col("_n_total") / F.lit(rows_per_shard)))
    else:
        raise ValueError(mode)
    return indexed.withColumn("shard", shard.cast("int")).drop("_n_total")


def _id_bounds(df: DataFrame, id_col: str, buckets: int, each: int = 32) -> list:
    """At most ``buckets - 1`` ascending ids that cut the table into even ranges, from the ``each * buckets`` distinct ids
    with the smallest hash (a bounded sample; any cut gives the same index). Ids of any orderable type."""
    sample = df.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col)
    ids = sorted(r[0] for r in sample.limit(each * buckets).collect())
    return sorted(set(ids[len(ids) * i // buckets] for i in range(1, buckets))) if ids else []


def _range_bucket(id_col: str, bounds: list) -> Column:
    """How many of the sorted bounds lie below the id, by binary search: one expression for any number of bounds."""
    if not bounds:
        return F.lit(0)
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))

    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(s["bounds"], middle) < s["id"])
        return F.struct(s["bounds"].alias("bounds"), s["id"].alias("id"), F.when(below, middle + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(below, s["hi"]).otherwise(F.least(middle, s["hi"])).alias("hi"))

    begin = F.struct(F.lit(bounds).alias("bounds"), F.col(id_col).alias("id"), F.lit(0).alias("lo"),
                     F.lit(len(bounds)).alias("hi"))
    return F.when(F.col(id_col).isNull(), 0).otherwise(F.aggregate(steps, begin, halve, lambda s: s["lo"]))


def with_index_by_id(df: DataFrame, id_col: str, buckets: int | None = None,
                     idx_col: str = "idx", total_col: str | None = None) -> DataFrame:
    """Position in ascending id order (nulls first). The input is written once to the shared checkpoint folder, so that
    choosing the ranges does not run its plan a second time; the ranges come from a bounded sample of ids, the
    ranks inside them are exact, so the index is exact."""
    b = buckets or shuffle_partitions(df.sparkSession)
    df = cut_lineage(df)
    keyed = df.withColumn("_bucket", _range_bucket(id_col, _id_bounds(df, id_col, b) if b > 1 else []))
    ranked = keyed.withColumn("_rn", F.row_number().over(Window.partitionBy("_bucket").orderBy(id_col)))
    counts = ranked.groupBy("_bucket").agg(F.max("_rn").alias("_n"))
    all_b = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", F.coalesce(F.sum("_n").over(all_b), F.lit(0)).alias("_off"),
                            F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_total"))
    out = ranked.join(F.broadcast(offsets), "_bucket")
    out = out.withColumn(idx_col, (F.col("_off") + F.col("_rn") - 1).cast("bigint"))
    if total_col:
        out = out.withColumn(total_col, F.col("_total").cast("bigint"))
    return out.drop("_bucket", "_rn", "_off", "_total")


def split_fixed(df: DataFrame, id_col: str, val_size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The first ``val_size`` rows of the seeded order are validation, the rest train."""
    indexed = with_index(df, id_col, seed)
    return (indexed.where(F.col("idx") >= val_size).drop("idx"),
            indexed.where(F.col("idx") < val_size).drop("idx"))


def batch_rows(df: DataFrame, id_col: str, batch_size: int, seed: int,
               drop_remainder: bool = True) -> DataFrame:
    """Reshuffle inside the split (seed), cut into batches of ``batch_size``
    (dropping the last partial batch), and give the batches a shuffled order
    (seed + 1). Output: one row per kept row with batch_id, pos and batch_order."""
    indexed = with_index(df, id_col, seed, idx_col="_i", total_col="_n")
    out = (indexed.withColumn("batch_id", F.floor(F.col("_i") / batch_size).cast("bigint"))
                  .withColumn("pos", F.pmod(F.col("_i"), F.lit(batch_size)).cast("int")))
    if drop_remainder:
        out = out.where(F.col("batch_id") < F.floor(F.col("_n") / batch_size))
    return (out.withColumn("batch_order", order_key(F.col("batch_id"), seed + 1))
               .drop("_i", "_n"))


def shuffle_files(files: DataFrame, name_col: str, seed: int) -> DataFrame:
    """G1: seeded order of shard files (a hash order instead of random.shuffle)."""
    return files.withColumn("file_order", order_key(F.col(name_col), seed))
