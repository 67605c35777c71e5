"""Helpers shared by the operators: Arrow text access, column names that clash with nothing, cut lineage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir, shuffle_partitions  # noqa: F401  (re-exported)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; a null counts as empty."""
    arr = pc.fill_null(arr, "").cast(pa.large_string())
    arr = pa.concat_arrays([arr]) if isinstance(arr, pa.Array) else arr.combine_chunks()
    _, offs, data = arr.buffers()
    offs = np.frombuffer(offs, np.int64)[arr.offset:arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offs


def texts(arr: pa.Array):
    """The texts of a string column as bytes, null as empty."""
    data, offs = utf8(arr)
    view = memoryview(data) if len(data) else b""
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        yield bytes(view[a:b])


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, .. of each of many slices, one after the other."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lens), lens)


def id_crc(col: str | Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string") if isinstance(col, str) else col.cast("string"), F.lit("")))


def settle(df: DataFrame, *parts: str) -> DataFrame:
    """Write a table into the shared checkpoint folder and read it back: lineage is cut and lost executors cost
    nothing. The columns ``parts`` become folders."""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
