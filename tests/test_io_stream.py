import os
import tempfile

from pyspark.sql import functions as F

from precis.functions import text as T
from precis.operators import order as O
from precis.sources import readers as RD
from precis.sources import sinks as SK
from precis.streaming import clean_stream as CS


def _tmp():
    return tempfile.mkdtemp(prefix="precis-io-")


def test_zstd_jsonl_roundtrip(spark):
    import json

    import zstandard
    d = _tmp()
    os.makedirs(f"{d}/cc")
    lines = "".join(json.dumps(o) + "\n" for o in [{"text": "a b. c d."}, {"text": None}, {"text": "x."}])
    with open(f"{d}/cc/part-0.jsonl.zst", "wb") as fh:
        fh.write(zstandard.ZstdCompressor().compress(lines.encode()))
    got = RD.read_docs(spark, f"{d}/cc", fmt="json").collect()
    assert sorted(r.text for r in got) == ["a b. c d.", "x."]


def test_chunked_gzip_and_text_dump(spark):
    d = _tmp()
    df = spark.range(25).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    SK.write_parquet_chunked(df.coalesce(1), f"{d}/p", rows_per_file=10)
    SK.write_parquet_chunked(df.coalesce(1), f"{d}/p", rows_per_file=10)
    files = [f for f in os.listdir(f"{d}/p") if f.endswith(".parquet")]
    assert len(files) == 6 and all(".gz." in f for f in files)
    assert spark.read.parquet(f"{d}/p").count() == 50
    SK.write_tokenizer_corpus(df, f"{d}/txt")
    assert spark.read.text(f"{d}/txt").count() == 25


def test_shards_resume_and_read_encoded(spark):
    d = _tmp()
    base = spark.range(100).select(F.col("id").alias("doc_id"))
    enc = O.assign_shards(base, "doc_id", 30).select(
        "doc_id", "shard", F.array_repeat(F.lit(1), 4).cast("array<int>").alias("input_ids"),
        F.array_repeat(F.lit(1), 4).cast("array<int>").alias("attention_mask"),
        F.array_repeat(F.lit(0), 2).cast("array<int>").alias("labels"))
    SK.write_shards(enc, f"{d}/s")
    assert sorted(x for x in os.listdir(f"{d}/s") if x.startswith("shard=")) == [f"shard={i}" for i in range(4)]
    SK.write_shards(enc.where(F.col("shard") >= 2).withColumn("labels", F.array(F.lit(7), F.lit(7))), f"{d}/s", start_from=2)
    back = RD.read_encoded(spark, f"{d}/s", max_len=4, max_label_len=2)
    assert back.count() == 100
    assert back.where("shard < 2").select(F.max(F.col("labels")[0])).first()[0] == 0
    assert back.where("shard >= 2").select(F.min(F.col("labels")[0])).first()[0] == 7
    assert RD.read_encoded(spark, f"{d}/s", num_files=2).count() == 60


def test_report_csv(spark):
    d = _tmp()
    df = spark.createDataFrame([("a|b", "g", "s", 0.5, 0.25, 0.5)], "article string, gold string, summary string, rouge1 double, rouge2 double, rougeL double")
    SK.write_report(df, f"{d}/r")
    back = spark.read.option("sep", "|").option("header", True).csv(f"{d}/r").first()
    assert back.article == "a|b" and float(back.rouge1) == 0.5


def test_stream_clean_equals_batch(spark):
    d = _tmp()
    src = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    src.write.mode("overwrite").parquet(f"{d}/in")
    stream = CS.read_stream(spark, f"{d}/in", src.schema)
    q = CS.write_stream(CS.clean_stream(stream), f"{d}/out", f"{d}/ckpt")
    q.awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(f"{d}/out").collect()))
    batch = CS.clean_stream(src)
    want = sorted(map(tuple, batch.collect()))
    assert got == want and len(got) == 200


def test_columns_to_rows_and_union(spark):
    df = spark.createDataFrame([([1, 2], [3, 4])], "a array<int>, b array<int>")
    rows = RD.columns_to_rows(df, ["a", "b"]).collect()
    assert [(r.a, r.b) for r in rows] == [(1, 3), (2, 4)]
    u = RD.union_corpora({"x": spark.range(2), "y": spark.range(3)})
    assert u.columns[0] == "corpus" and u.count() == 5


def test_read_splits_named_and_select(spark):
    from precis.plans.corpora import select_splits
    d = _tmp()
    for split, n in (("train", 3), ("test", 2)):
        spark.range(n).selectExpr("cast(id as string) as text").write.json(f"{d}/{split}")
    u = RD.read_splits(spark, {"train": [f"{d}/train"], "test": [f"{d}/test"]}, "text string")
    assert {r.split for r in u.collect()} == {"train", "test"} and u.count() == 5
    assert select_splits(u, ["test"]).count() == 2
    df = spark.createDataFrame([(1, "id", "train", "a"), (2, "id", "test", "b"), (3, "en", "test", "c")],
                               "doc_id long, lang string, split string, text string")
    df.write.partitionBy("lang", "split").parquet(f"{d}/named/oscar")
    got = RD.read_named(spark, f"{d}/named", "oscar", lang="id", split="test").collect()
    assert [r.doc_id for r in got] == [2]


def test_pretrain_records_written_and_read_back(spark):
    from dataclasses import replace

    from precis.operators import vocab as V
    from precis.options import DEFAULT
    from precis.plans import corpora as C
    from precis.plans import derived as D
    d = _tmp()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumn("li", D.line_ids(F.col("doc_id"), F.col("text"), F.col("lang")))
    vocab = V.word_vocab(V.word_counts(docs.select(T.clean_preset(F.col("text"), "module", False).alias("text"))), 500)
    opts = replace(DEFAULT, model_max_length=32, max_summary_length=16, rows_per_shard=10)
    rec = C.pretrain_records(docs, "li", vocab, lang="en", opts=opts)
    SK.write_shards(rec, f"{d}/rec")
    back = RD.read_encoded(spark, f"{d}/rec", max_len=32, max_label_len=16)
    assert back.count() == rec.count() > 0


def test_score_candidate_table(spark):
    from precis.operators.candidates import score_candidate_table
    cands = spark.createDataFrame([(1, 1, "a b c d"), (1, 2, "x"), (2, 1, "")], "doc_id long, rank int, summary string")
    gold = spark.createDataFrame([(1, "a b d c"), (2, "a")], "doc_id long, gold string")
    got = {(r.doc_id, r.rank): r for r in score_candidate_table(cands, gold).collect()}
    assert abs(got[(1, 1)].rouge2 - 1 / 3) < 1e-12 and got[(1, 1)].rougeL == 0.75 and got[(2, 1)].rouge1 == 0.0


def test_remaining_sinks_and_text_source(spark):
    from precis.plans.corpora import prepare_liputan6
    d = _tmp()
    df = spark.createDataFrame([(1, "train", "JAKARTA - Harga beras naik tajam sekali hari ini.", "Harga naik tajam sekali."),
                                (2, "test", "Kota - Warga antre panjang sekali di pasar.", "Warga antre panjang.")],
                               "id long, split string, clean_article string, clean_summary string")
    out = prepare_liputan6(df, splits=["test"]).collect()
    assert [r.id for r in out] == [2] and out[0].labels.startswith(" ")
    SK.write_parquet(df, f"{d}/b2", codec="gzip")
    SK.write_parquet(df, f"{d}/b2")                      # overwrite
    assert spark.read.parquet(f"{d}/b2").count() == 2
    rep = spark.createDataFrame([("block one\nline",), ("block two",)], "report string")
    SK.write_text_report(rep, f"{d}/b9")
    assert spark.read.text(f"{d}/b9").count() == 3
    txt = RD.read_docs(spark, f"{d}/b9", fmt="text")
    assert txt.count() == 3 and txt.columns == ["doc_id", "text"]


def test_ids_do_not_follow_the_layout(spark):
    d = _tmp()
    texts = ["same"] * 40 + [f"text {i % 7}" for i in range(30)] + ["", "once", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    df.repartition(2).write.parquet(f"{d}/few")
    df.repartition(9).write.parquet(f"{d}/many")
    one, other = (sorted(map(tuple, RD.read_docs(spark, f"{d}/{x}").collect())) for x in ("few", "many"))
    assert one == other and len({i for i, _ in one}) == len(one) == 72
    assert [i.split("-")[1] for i, t in one if t == "once"] == ["0"]
    files = RD.read_docs(spark, f"{d}/few", ids="file")
    assert len({r.doc_id for r in files.collect()}) == 72 and "Exchange" not in files._jdf.queryExecution().executedPlan().toString()


def test_ids_of_any_type_are_kept(spark):
    d = _tmp()
    spark.createDataFrame([("a", "x"), ("", "y"), (None, "z")], "id string, text string").write.parquet(f"{d}/p")
    got = RD.read_docs(spark, f"{d}/p", id_col="id")
    assert got.schema["doc_id"].dataType.simpleString() == "string"
    assert sorted((r.doc_id or "", r.text) for r in got.collect()) == [("", "y"), ("", "z"), ("a", "x")]


def test_a_write_that_fails_midway_resumes_by_its_manifest(spark):
    import shutil
    d = _tmp()
    df = spark.range(100).select("id", (F.col("id") % 4).cast("int").alias("shard"))
    bad = df.withColumn("id", F.when(F.col("shard") == 2, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("id")))
    try:
        SK.write_mode_shards(bad, f"{d}/s", "train")
        raise AssertionError("the write of shard 2 must fail")
    except Exception as e:
        assert "lost" in str(e)
    assert set(SK.read_manifest(spark, f"{d}/s")) == {"train_0", "train_1"}
    assert SK.write_mode_shards(df, f"{d}/s", "train") == ["train_2", "train_3"]
    assert SK.write_mode_shards(df, f"{d}/s", "train") == []
    spark.range(3).write.mode("overwrite").parquet(f"{d}/s/train_1")  # another job's rows
    os.remove(f"{d}/s/train_3/_SUCCESS")
    assert SK.write_mode_shards(df, f"{d}/s", "train") == ["train_1", "train_3"]
    assert SK.write_mode_shards(df.where("shard = 0"), f"{d}/s", "val") == ["val_0"]
    back = SK.read_mode_shards(spark, f"{d}/s", "train", [3, 0])
    assert sorted((r.place, r.id % 4) for r in back.collect()) == [(0, 3)] * 25 + [(1, 0)] * 25
    assert sum(SK.read_mode_shards(spark, f"{d}/s", "train", [i]).count() for i in range(4)) == 100
