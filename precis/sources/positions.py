"""Tables with a stored position index (F7, and files in a given order for A6).

Rows are written in id order, and a small table beside them (``_positions``, which Spark's readers pass over) holds for
each file its first position and its rows. A lookup by position asks that table, and reads only the files it names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_indexed(df: DataFrame, path: str, id_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """Writes ``df`` to ``path`` in ascending order of ``id_col`` (any orderable type, nulls first; one exchange by range),
    at most ``rows_per_file`` rows a file, then its position index. Rows that share an id, or have none, stand next to
    each other in the order in which they were written. An empty table has an empty index."""
    (df.repartitionByRange(id_col).sortWithinPartitions(id_col)
       .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path))
    index_positions(df.sparkSession, path, id_col)


def index_positions(spark: SparkSession, path: str, id_col: str = "doc_id") -> None:
    """(file, first, rows) for the files of a table that was written in id order, from the ids alone; again after a job
    that died before its index was whole. Only the list of files is ordered in one place."""
    ids = spark.read.parquet(path).select(F.struct(id_col).alias("id"), F.col("_metadata.file_name").alias("file"))
    files = ids.groupBy("file").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("rows"))
    before = Window.orderBy("low", "high", "file").rowsBetween(Window.unboundedPreceding, -1)
    out = files.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"), "rows")
    out.coalesce(1).write.mode("overwrite").parquet(f"{path}/_positions")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, rows) of a table written by ``write_indexed``."""
    return spark.read.schema("file string, first bigint, rows bigint").parquet(f"{path}/_positions")


def lookup_positions(spark: SparkSession, path: str, positions: list[int], idx_col: str = "idx") -> DataFrame:
    """The rows at ``positions`` (from 0; repeated ones count once, those outside the table give none) with their position
    as ``idx_col``, which replaces a column of that name. Only files that hold one of them are read."""
    wanted = F.array(*[F.lit(int(p)).cast("bigint") for p in sorted(set(positions))]).cast("array<bigint>")
    held = F.exists(wanted, lambda p: (p >= F.col("first")) & (p < F.col("first") + F.col("rows")))
    hits = read_positions(spark, path).where(held).collect()     # a file a position at most
    schema = spark.read.parquet(path).schema
    if not hits:
        return spark.createDataFrame([], schema).withColumn(idx_col, F.lit(0).cast("bigint"))
    rows = spark.read.schema(schema).parquet(*[f"{path}/{h['file']}" for h in hits])
    at = _by_file({h["file"]: h["first"] for h in hits}) + F.col("_metadata.row_index")
    return rows.withColumn(idx_col, at.cast("bigint")).where(F.col(idx_col).isin(sorted(set(positions))))


def read_in_order(spark: SparkSession, files: list[str], place_col: str = "place", row_col: str = "row") -> DataFrame:
    """The rows of the Parquet files ``files`` with the file's place in the list (its first, if it is named twice) and
    the row's place in the file, by which a consumer restores the order of the list. File names must differ."""
    names = {}
    for f in files:
        name = f.rstrip("/").rsplit("/", 1)[-1]
        if names.setdefault(name, f) != f:
            raise ValueError(f"two files are named {name}")
    places = {name: i for i, name in enumerate(names)}
    return spark.read.parquet(*names.values()).withColumns(
        {place_col: _by_file(places), row_col: F.col("_metadata.row_index")})


def _by_file(numbers: dict[str, int]):
    """The number of the file that a row is read from."""
    pairs = F.create_map(*[F.lit(x) for name, n in numbers.items() for x in (name, n)])
    return F.element_at(pairs, F.col("_metadata.file_name")).cast("bigint")
