"""Query of the sharding operator, with its SQL."""

from .common import table
from .registry import register
from .sharding import BITS, shards

LIMIT = 1 << 20

SQL = f"""
WITH rows AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {BITS // 4}))::BIGINT AS h
  FROM documents),
buckets AS (
  SELECT d AS depth, h >> ({BITS} - d) AS prefix, sum(n_bytes) <= {LIMIT} OR min(h) = max(h) AS fits
  FROM rows, (SELECT unnest(range(0, {BITS} + 1))::BIGINT AS d) GROUP BY ALL),
leaves AS (
  SELECT b.depth, b.prefix FROM buckets b
  LEFT JOIN buckets p ON p.depth = b.depth - 1 AND p.prefix = b.prefix >> 1
  WHERE b.fits AND (b.depth = 0 OR NOT p.fits))
SELECT doc_id, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(prefix), {BITS}, '0'), depth::INT) END AS shard, n_bytes
FROM rows JOIN leaves ON prefix = h >> ({BITS} - depth)
"""


@register("op4_sharding", SQL)
def op4_sharding(spark, sf_dir):
    return shards(table(spark, sf_dir, "documents"), LIMIT)
