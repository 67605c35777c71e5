"""Query of the language-model scores."""

from .common import id_crc, table
from .lm import scores
from .registry import register

FOLDS, HELD_OUT = 10, 0


@register("op10_lm_scoring")
def op10_lm_scoring(spark, sf_dir):
    found = scores(table(spark, sf_dir, "documents"), id_crc("doc_id") % FOLDS != HELD_OUT)
    return found.select("doc_id", (id_crc("doc_id") % FOLDS == HELD_OUT).alias("held_out"), "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")
