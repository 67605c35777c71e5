"""Query of the conversation repair."""

from pyspark.sql import functions as F

from .common import table
from .conversations import repair_conversations, repaired_digests
from .registry import register

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(turns):
    """The rows after the damage that a hash of conversation and turn picks; nulls are one space in it."""
    space = F.lit(" ")
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space),
                            F.coalesce(F.col("turn").cast("string"), space))) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                        h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


@register("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    report, parts = repair_conversations(damaged(turns))
    found = report.join(repaired_digests(parts).withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    every = turns.select(F.col("conv_id").alias("every")).distinct()
    return every.join(found, F.col("every").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("every").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
