"""Query of the packing operator."""

from pyspark.sql import functions as F

from .common import table
from .packing import pack, pieces
from .registry import register

CAPACITY, END_ID, TOKENIZER = 2048, 0, "word_bpe_49k.json"


def packed(docs):
    import public_tokenizers

    cut = pieces(docs, public_tokenizers.path(TOKENIZER), capacity=CAPACITY, end_id=END_ID)
    return pack(cut, CAPACITY).select(F.col("_id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                                      "sequence_id", "offset")


@register("op5_best_fit_packing")
def op5_best_fit_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))
