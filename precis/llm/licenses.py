"""Licence scan: a trained paragraph classifier, confirmed by template comparison, in DataFrame functions and Spark ML.

A paragraph (a line of text) is its sparse set of word 1- to 3-grams, of those that occur in any template. A multinomial
logistic regression has a class for each licence family and one for unknown paragraphs. It learns families from
stretches of the templates and unknown from all paragraphs of the corpus, equal sets as one row with their number; a third
of them is kept from it and calibrates the unknown class: the least family probability that counts lies above what
unlicensed paragraphs reach. A prediction holds if the paragraph also has enough of the n-grams of one of that family's
templates."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle
from .decontaminate import words
from .license_texts import TEMPLATES

UNKNOWN = "unknown"
FOUND = 0.6  # share of a template's 2-grams that confirms it
FLOOR = 0.5


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, paragraph, words): the lines of each text, numbered from 0, those without words left out."""
    return (docs.select(F.col(id_col).alias("_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("paragraph", "_line"))
            .select("_id", "paragraph", words(F.col("_line")).alias("words")).where(F.size("words") > 0))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(family, k, text) for family, texts in TEMPLATES.items() for k, text in enumerate(texts)]
    return spark.createDataFrame(rows, "family string, k int, text string").select("family", "k", words(F.col("text")).alias("words"))


def _grams(df: DataFrame) -> DataFrame:
    for n in (2, 3):
        df = NGram(n=n, inputCol="words", outputCol=f"_{n}").transform(df)
    return df.withColumn("grams", F.concat("words", "_2", "_3")).withColumnRenamed("_2", "pairs").drop("_3")


def _stretches(templates: DataFrame) -> DataFrame:
    """All stretches of 60, 80 and 100 % of a template's words, 3 words at least."""
    size = F.greatest(F.lit(3), F.ceil(F.col("share") * F.size("words"))).cast("int")
    cut = (templates.withColumn("share", F.explode(F.array(*map(F.lit, (0.6, 0.8, 1.0)))))
           .withColumn("size", F.least(size, F.size("words")))
           .withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1))))
    return cut.select("family", F.slice("words", F.col("at"), F.col("size")).alias("words")).distinct()


def _vocabulary(spark: SparkSession) -> list[str]:
    return sorted(r[0] for r in _grams(_templates(spark)).select(F.explode("grams")).distinct().collect())  # fixed texts


def paragraph_grams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, paragraph, size, hash, grams) of all paragraphs: how many words, a hash of them, and the set of n-grams that
    occur in any template. A run of words that no template holds is cut to two blanks first: no such n-gram spans it."""
    vocabulary = _vocabulary(docs.sparkSession)
    known = [g for g in vocabulary if " " not in g]
    marked = F.array_join(F.transform("words", lambda w: F.when(w.isin(known), w).otherwise(F.lit(""))), " ")
    short = paragraphs(docs, id_col, text_col).select(
        "_id", "paragraph", F.size("words").alias("size"), F.xxhash64("words").alias("hash"),
        F.split(F.regexp_replace(marked, " {3,}", "  "), " ").alias("words"))
    found = F.array_sort(F.array_distinct(F.filter("grams", lambda g: g.isin(vocabulary))))
    return _grams(short).select("_id", "paragraph", "size", "hash", found.alias("grams"))


def _similar(df: DataFrame) -> DataFrame:
    """``df`` (size, grams, family or not) with ``similarity``: the 2-grams shared with one template (of the row's family,
    if it has one) as a share of the shorter one's, of 3 at least; the largest of all templates."""
    spark = df.sparkSession
    known = _grams(_templates(spark)).select("family", F.array_distinct("pairs").alias("_pairs"))
    if "family" in df.columns:
        known = known.groupBy("family").agg(F.collect_list("_pairs").alias("_all"))
        df = df.join(F.broadcast(known), "family")  # the fixed templates
    else:
        every = [r["_pairs"] for r in known.collect()]
        df = df.withColumn("_all", F.array(*[F.array(*map(F.lit, p)) for p in every]))
    return df.withColumn("similarity", F.array_max(F.transform(
        "_all", lambda t: F.size(F.array_intersect("grams", t))
        / F.greatest(F.lit(3), F.least(F.size(t), F.col("size") - 1))))).drop("_all")


class Classifier:
    """The fitted stages, the family names by class number, and the least family probability that counts."""

    def __init__(self, stages: PipelineModel, families: list[str], least: float):
        self.stages, self.families, self.least = stages, families, least

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` (grams) with ``family`` and ``probability`` of the likeliest family (unknown apart)."""
        scored = self.stages.transform(df).withColumn("_p", F.slice(vector_to_array("_probability"), 1, len(self.families)))
        return (scored.withColumn("probability", F.array_max("_p"))
                .withColumn("family", F.element_at(F.array(*map(F.lit, self.families)),
                                                   F.array_position("_p", F.col("probability")).cast("int")))
                .drop("_p", "_features", "_probability"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Train on the templates and on all paragraphs of ``docs``, see ``fit_grams``."""
    return fit_grams(settle(paragraph_grams(docs, id_col, text_col)))


def fit_grams(rows: DataFrame) -> Classifier:
    """Train on the templates and on all of ``rows`` (see ``paragraph_grams``; read once): paragraphs with equal sets and
    equal lengths are one row with their number, which weighs it. Those that hold half of a template's 2-grams count
    for neither side."""
    spark = rows.sparkSession
    templates = _templates(spark)
    families = sorted(TEMPLATES)
    number = F.create_map(*[x for i, f in enumerate([*families, UNKNOWN]) for x in (F.lit(f), F.lit(float(i)))])
    longest = templates.agg(F.max(F.size("words"))).first()[0]  # a length beyond it changes no similarity
    # a third of the different paragraphs, by their words, calibrates
    later = (F.pmod("hash", F.lit(3)) == 0).alias("_later")
    sets = rows.groupBy("grams", F.least("size", F.lit(longest)).alias("size"), later).agg(F.count("*").alias("n"))
    lines = settle(_similar(sets).where(F.col("similarity") < 0.5).groupBy("grams", "_later").agg(F.sum("n").alias("n")))
    known = _grams(_stretches(templates)).select("family", "grams")
    learned = known.withColumn("n", F.lit(1).cast("bigint")).unionByName(
        lines.where("NOT _later").select(F.lit(UNKNOWN).alias("family"), "grams", "n"))
    learned = learned.withColumn("label", number[F.col("family")])
    # a paragraph without any known n-gram is unknown, whatever the corpus has
    learned = learned.unionByName(spark.range(1).select(
        F.lit(UNKNOWN).alias("family"), F.array().cast("array<string>").alias("grams"), F.lit(1).cast("bigint").alias("n"),
        F.lit(float(len(families))).alias("label")))
    learned = settle(learned)  # every step of the fit reads it
    counts = {r["label"]: r["n"] for r in learned.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    weight = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(1000.0 / n))])
    vectors = CountVectorizerModel.from_vocabulary(_vocabulary(spark), "grams", "_features")
    vectors.setBinary(True)
    model = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="_weight", probabilityCol="_probability",
                               rawPredictionCol="", predictionCol="", family="multinomial", regParam=1e-3, maxIter=60
                               ).fit(vectors.transform(learned.withColumn("_weight", weight[F.col("label")] * F.col("n"))))
    found = Classifier(PipelineModel([vectors, model]), families, FLOOR)
    top = found.predict(lines.where("_later").select("grams")).agg(F.max("probability")).first()[0]
    found.least = max(FLOOR, min(0.99, (top or 0.0) + 0.01))
    return found


def scan(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, paragraph, family, probability, similarity): one row for each paragraph that holds a licence notice,
    in every row of ``docs``. Null and empty texts have no paragraphs; repeated rows are scanned each; other columns
    go; an empty table gives no rows."""
    return scan_grams(paragraph_grams(docs, id_col, text_col), model, id_col)


def scan_grams(rows: DataFrame, model: Classifier, id_col: str = "doc_id") -> DataFrame:
    """As ``scan``, for all of ``rows`` (see ``paragraph_grams``)."""
    likely = model.predict(rows).where(F.col("probability") >= model.least)
    return (_similar(likely).where(F.col("similarity") >= FOUND)
            .select(F.col("_id").alias(id_col), "paragraph", "family", F.round("probability", 6).alias("probability"),
                    F.round("similarity", 6).alias("similarity")))
