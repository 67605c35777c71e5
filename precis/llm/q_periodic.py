"""Query of the periodic run detection."""

from pyspark.sql import functions as F

from .common import id_crc, table
from .periodic import periodic_runs
from .registry import register


def planted(docs):
    """(doc_id, text): about every tenth text with words has its words from one on replaced by a repeating stretch."""
    h = id_crc("doc_id")
    some = docs.where(h % 10 == 0).select("doc_id", F.floor(h / 10).cast("bigint").alias("g"), F.expr(
        r"filter(split(text, '[ \\x09-\\x0D]+'), w -> w <> '')").alias("w"))
    some = some.withColumn("n", F.size(F.coalesce("w", F.array().cast("array<string>"))).cast("bigint"))
    some = some.withColumn("a", F.expr("if(n > 0, g % n, 0L)"))
    some = some.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    text = F.expr("if(n > 0, array_join(transform(sequence(0L, n - 1), i -> "
                  "w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' '), '')")
    return docs.where(h % 10 != 0).select("doc_id", "text").unionAll(some.select("doc_id", text.alias("text")))


@register("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    # greatest length, then smallest start and period
    best = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as s, -r.period as p)))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("b", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("b.s")).alias("start"),
        F.col("b.length").alias("length"), (-F.col("b.p")).alias("period"),
        F.expr("1000 * b.length div -b.p").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
