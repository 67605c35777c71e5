"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round. Neighbour minima are aggregates (partial sums before the shuffle), so a node with very
    many links is no single group in memory; the join back is one that Spark can split."""
    both = edges if not large else edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:  # every node sees its smaller neighbours only
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
    joined = both.join(low, F.col("u") == F.col("k"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            low.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (u, v: bigint, any direction, repeats allowed) -> (node, root): the smallest node reachable.
    Nodes without links do not appear. Rounds end when the table of stars no longer changes."""
    edges = settle(links.select(F.col("u").cast("bigint"), F.col("v").cast("bigint"))
                        .where("u <> v").distinct())
    state = None
    while True:
        edges = settle(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
