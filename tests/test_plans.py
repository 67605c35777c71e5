"""Plan shape: the fold UDF runs once, scans are pruned and filtered at the source."""
from pyspark.sql import functions as F

from precis.functions import text as T
from precis.operators import filters as FL
from precis.plans.corpora import prepare_ccnews

SF = "/root/testdata/sf0.001"


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_fold_udf_evaluated_once_and_scan_pushdown(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("lang") == "en")
    out = prepare_ccnews(docs)
    plan = _plan(out)
    assert plan.count("ArrowEvalPython") == 1
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en), IsNotNull(text)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_cleaned_text_computed_once_under_filters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cleaned = docs.select("doc_id", T.clean_preset(F.col("text"), "module").alias("t"))
    counted = FL.filter_length(FL.with_counts(cleaned, "t"))
    plan = _plan(counted)
    # one UDF call (a nondeterministic UDF referenced twice would be evaluated twice)
    # and the cleaning chain once (its last step filters the dot pieces)
    assert plan.count("_fold_array(") == 1 and plan.count("ArrowEvalPython") == 1
    assert plan.count("length(trim(lambda") == 1


def test_fold_once_per_column_in_presets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for preset in ("module", "pretrain_nb", "finetune_nb", "demo_nb"):
        plan = _plan(docs.select(T.clean_preset(F.col("text"), preset).alias("t")))
        assert plan.count("_fold_array(") == 1, preset


def test_column_pruning_reaches_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = _plan(docs.select("doc_id", T.word_count("text").alias("n")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_abbreviations(spark):
    df = spark.createDataFrame([("Dr. Smith came. He left. E.g. this. Ok.",)], "t string")
    plain = df.select(T.split_sentences("t")).first()[0]
    abbr = df.select(T.split_sentences("t", ("dr", "e.g"))).first()[0]
    assert plain == ["Dr.", "Smith came.", "He left.", "E.g.", "this.", "Ok."]
    assert abbr == ["Dr. Smith came.", "He left.", "E.g. this.", "Ok."]


def test_training_table_exchanges_its_rows_once(spark):
    from precis.plans.q_order import training_table
    plan = _plan(training_table(spark, SF))
    # by (split, bucket); the other two are the 2B counts of the buckets
    assert plan.count("Exchange hashpartitioning(split") + plan.count("Exchange hashpartitioning(_bucket") <= 3
    assert plan.count("Exchange ") <= 4


def test_links_are_looked_for_in_lines_that_may_hold_one(spark):
    """the link pattern ran over the whole text once one line had a link."""
    import re

    texts = ["a b\nsee http://x.example.com/a_b now\n\n", "x.co\ny", "no link. at all\n", "", "a.\ncom b.c\n.de", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.remove_links("t")).collect()]
    rule = re.compile(r"(https?://)?([\da-z.-]+)\.([a-z.]{2,6})([/\w.-]*)")
    assert got == [t if t is None else rule.sub("", t) for t in texts]
    assert "transform(split(" in str(T.remove_links("t"))


def test_words_of_any_white_space(spark):
    texts = ["a b", " a  b ", "a\tb\x1cc\x0bd", "a\u00a0b\u3000c\u2028d", "\u00e9 x", "", "  ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(T.words("t")).collect()]
    assert got == [t if t is None else t.split() for t in texts]


def test_eval_decoded_joins_the_first_words_alone(spark):
    """the whole decoded article went through the join's exchange."""
    from precis.plans import QUERIES
    plan = QUERIES["eval_decoded"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert "split(" not in plan[:join] and "split(" in plan[join:]
