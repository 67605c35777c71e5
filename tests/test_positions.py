"""Stored position index: lookups against the sorted list, and which files they read."""
import pytest
from pyspark.sql import functions as F

from precis.sources import positions as P


def test_lookup_reads_only_the_files_named(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("doc_id"), F.lit("x").alias("idx"))
    P.write_indexed(df, path, rows_per_file=20)
    index = P.read_positions(spark, path).orderBy("first").collect()
    assert len(index) >= 25 and sum(r.rows for r in index) == 500 and max(r.rows for r in index) <= 20
    assert [r.first for r in index] == [sum(x.rows for x in index[:i]) for i in range(len(index))]
    one = P.lookup_positions(spark, path, [130])
    assert len(one.inputFiles()) == 1 and [tuple(r) for r in one.collect()] == [(130, 130)]
    many = P.lookup_positions(spark, path, [499, 0, 77, 77, 500, -1])
    assert len(many.inputFiles()) == 3
    assert sorted(tuple(r) for r in many.collect()) == [(i, i) for i in (0, 77, 499)]
    assert P.lookup_positions(spark, path, []).count() == 0
    assert spark.read.parquet(path).count() == 500      # the index is not read as rows


def test_repeated_null_and_string_ids(spark, tmp_path):
    path = str(tmp_path / "t")
    ids = ["a"] * 90 + [None] * 30 + [f"k{i:03d}" for i in range(60)]
    P.write_indexed(spark.createDataFrame([(i,) for i in ids], "doc_id string").repartition(5), path, rows_per_file=8)
    want = [None] * 30 + ["a"] * 90 + sorted(i for i in ids if i and i[0] == "k")
    got = P.lookup_positions(spark, path, list(range(180))).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.idx)] == want
    assert sorted(r.idx for r in got) == list(range(180))


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    P.write_indexed(spark.createDataFrame([], "doc_id bigint, text string"), path)
    out = P.lookup_positions(spark, path, [0])
    assert out.columns == ["doc_id", "text", "idx"] and out.count() == 0


def test_files_in_list_order(spark, tmp_path):
    path = str(tmp_path / "t")
    P.write_indexed(spark.range(60).withColumnRenamed("id", "doc_id"), path, rows_per_file=10)
    index = P.read_positions(spark, path).orderBy(F.desc("first")).collect()
    files = [f"{path}/{r.file}" for r in index]
    rows = P.read_in_order(spark, files + files[:1]).orderBy("place", "row").collect()
    assert [r.doc_id for r in rows] == [i for r in index for i in range(r.first, r.first + r.rows)]
    with pytest.raises(ValueError):
        P.read_in_order(spark, [files[0], "/elsewhere/" + index[0].file])
