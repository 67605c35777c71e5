"""Query of the toxicity operator."""

from pyspark.sql import functions as F

from .common import id_crc, table
from .registry import register
from .toxicity import fit, score

FOLDS, HELD_OUT, THRESHOLD = 3, 1, 0.7


def model(spark, sf_dir, docs):
    """Trained on the labelled rows outside the held-out fold."""
    return fit(docs, table(spark, sf_dir, "labels"), id_crc("doc_id") % FOLDS != HELD_OUT)


@register("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score(docs, model(spark, sf_dir, docs)).select(
        "doc_id", (id_crc("doc_id") % FOLDS == HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
