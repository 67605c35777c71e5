"""Query of the MinHash near-duplicate operator."""

from .common import table
from .minhash import near_duplicates
from .registry import register

SHINGLE, PERCENT = 4, 80


@register("op11_minhash_dedup")
def op11_minhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=SHINGLE, percent=PERCENT)
