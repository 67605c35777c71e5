"""Sinks B1-B9. Writes go through Spark's committers (task retries and speculative
attempts cannot leave partial files), run in parallel, and never pass rows through the
driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_parquet_chunked(df: DataFrame, path: str, rows_per_file: int = 1_000_000,
                          codec: str = "gzip", mode: str = "append") -> None:
    """B1: files of at most ``rows_per_file`` rows, gzip, appended."""
    (df.write.mode(mode).option("compression", codec)
       .option("maxRecordsPerFile", rows_per_file).parquet(path))


def write_parquet(df: DataFrame, path: str, codec: str | None = None) -> None:
    """B2: overwrite, default codec unless given."""
    w = df.write.mode("overwrite")
    if codec:
        w = w.option("compression", codec)
    w.parquet(path)


def write_tokenizer_corpus(df: DataFrame, path: str, col: str = "text") -> None:
    """One cleaned text per line (cleaned text holds no newline), appended."""
    df.select(F.col(col).alias("value")).write.mode("append").text(path)


def write_shards(df: DataFrame, path: str, start_from: int = 0, rows_per_file: int | None = None) -> None:
    """One directory per ``shard``; shards below ``start_from`` are left as they
    are (dynamic partition overwrite replaces only the shards written now)."""
    out = df.where(F.col("shard") >= start_from) if start_from else df
    w = (out.repartition("shard").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("shard"))
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    w.parquet(path)


def _digest(df: DataFrame) -> list:
    """Rows and an order-free sum of row hashes over the columns without ``shard`` and ``mode``."""
    cols = sorted(c for c in df.columns if c not in ("shard", "mode"))
    return [F.count("*").alias("rows"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("digest")]


def _shard_stats(spark: SparkSession, path: str, names: list[str]) -> dict[str, tuple]:
    """(rows, digest) of the shard folders ``names``, read back; folders that are not there are left out."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    out = {}
    for n in there:
        df = spark.read.parquet(f"{path}/{n}")
        out[n] = tuple(df.agg(*_digest(df)).first())
    return out


def read_manifest(spark: SparkSession, path: str) -> dict[str, tuple]:
    """Shard name -> (rows, digest) as last written; empty where there is no manifest."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return {}
    rows = spark.read.schema("name string, rows bigint, digest decimal(38,0), at bigint").json(f"{path}/_manifest").collect()
    return {r["name"]: (r["rows"], r["digest"]) for r in sorted(rows, key=lambda r: r["at"])}


def write_mode_shards(df: DataFrame, path: str, mode: str) -> list[str]:
    """One folder ``{mode}_{shard}`` per shard of ``df`` (column ``shard``), resumable without a number given by hand.

    After a shard is written, the rows counted on the way in and those read back are compared and an entry (name, rows,
    digest) goes into ``_manifest``. A later call skips the shards whose entry equals what is read back from their folder and
    writes the others anew, so a job that died midway, or a folder that was damaged, costs only those shards. Returns the
    names written. Shards number as many as the files asked for, so their list is small; rows stay on executors."""
    spark = df.sparkSession
    shards = sorted(r["shard"] for r in df.select("shard").distinct().collect())
    names = {s: f"{mode}_{s}" for s in shards}
    known = read_manifest(spark, path)
    whole = {n for n, stats in _shard_stats(spark, path, [n for n in names.values() if n in known]).items() if stats == known[n]}
    written = []
    for shard in shards:
        name = names[shard]
        if name in whole:
            continue
        seen = Observation()
        part = df.where(F.col("shard") == shard)
        part.drop("shard").observe(seen, *_digest(part)).write.mode("overwrite").parquet(f"{path}/{name}")
        stats = _shard_stats(spark, path, [name]).get(name)
        if stats != (seen.get["rows"], seen.get["digest"]):
            raise OSError(f"{path}/{name} does not hold what was written")
        entry = spark.createDataFrame([(name, *stats, len(known) + len(written))], "name string, rows bigint, digest decimal(38,0), at bigint")
        entry.coalesce(1).write.mode("append").json(f"{path}/_manifest")
        written.append(name)
    return written


def read_mode_shards(spark: SparkSession, path: str, mode: str, shards: list[int]) -> DataFrame:
    """The shards of a mode with their number, in the order of the list as column ``place``; only their folders are read."""
    parts = [spark.read.parquet(f"{path}/{mode}_{s}").withColumns({"shard": F.lit(s), "place": F.lit(i)}) for i, s in enumerate(shards)]
    return reduce(DataFrame.unionByName, parts)


def write_report(df: DataFrame, path: str, sep: str = "|") -> None:
    """Header + ``sep``-separated rows (quoted where needed, unlike a bare print)."""
    df.write.mode("overwrite").option("sep", sep).option("header", True).csv(path)


def write_text_report(df: DataFrame, path: str, col: str = "report") -> None:
    """The text blocks of ``candidate_report``."""
    df.select(F.col(col).alias("value")).write.mode("overwrite").text(path)
