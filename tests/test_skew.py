"""Hot keys: one value holding a large share of the rows must not change results and
must be pre-aggregated before the shuffle."""
from pyspark.sql import functions as F

from precis.operators import filters as FL
from precis.operators.gsg import gap_sentences
from precis.operators.vocab import word_counts
from precis.plans import derived as D


def test_dedup_hot_text(spark):
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text again").alias("text"))
    rest = spark.range(3000, 6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    df = hot.unionByName(rest)
    out = FL.dedup_text(df, "text", "doc_id", "n").collect()
    assert len(out) == 3001
    got = {r.text: (r.doc_id, r.n) for r in out}
    assert got["the same text again"] == (0, 3000)
    plan = FL.dedup_text(df, "text", "doc_id", "n")._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan          # map-side combine before the exchange


def test_word_counts_hot_word(spark):
    df = spark.createDataFrame([(i, "the " * 50 + f"w{i}") for i in range(200)], "doc_id long, text string")
    counts = {r.word: r.freq for r in word_counts(df).collect()}
    assert counts["the"] == 50 * 200 and counts["w7"] == 1
    plan = word_counts(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_hot_conversation(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t} text") for t in range(400)]
    rows += [(2, 0, "user", "x"), (2, 1, "assistant", "y")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = D.conversation_pairs(conv)
    assert pairs.count() == 201


def test_very_long_document(spark):
    text = " ".join(f"Sentence number {i} has words w{i % 37} and w{i % 11}." for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, "Short one. Two.")], "doc_id long, text string")
    a = sorted(map(tuple, gap_sentences(df).collect()))
    b = sorted(map(tuple, gap_sentences(df, engine="arrow").collect()))
    assert a == b and a[0][3] == 3000
