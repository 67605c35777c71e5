"""Query of the SimHash near-duplicate operator."""

from pyspark.sql import functions as F

from .common import table
from .registry import register
from .simhash import near_duplicates

SHINGLE, MAX_DISTANCE = 4, 4


@register("op3_simhash_dedup")
def op3_simhash_dedup(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=SHINGLE, max_distance=MAX_DISTANCE)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
