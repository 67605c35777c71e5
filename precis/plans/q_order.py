"""Registered queries: seeded order, split, batch, shards, union of corpora, lookup,
sentence sample and the training table (G1-G7, B4-B7, A8, F7, L7).

Sizes below (validation rows, batch size, rows per shard) are chosen for the check
scale (1,000 documents at sf0.01); the operators take them as arguments.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import order as O
from ..session import ensure_checkpoint_dir
from ..sources.positions import lookup_positions, write_indexed
from . import derived as D
from . import sql as S
from .q_clean import _docs
from .registry import register

SEED = 42
VAL_SIZE = 100
BATCH = 32
ROWS_PER_SHARD = 64
START_FROM = 3
SAMPLE = 5000

_IDX = f"CAST(row_number() OVER (ORDER BY {S.s_md5_index('doc_id', SEED)}, doc_id) - 1 AS BIGINT)"


@register("shuffle_order", f"SELECT doc_id, {_IDX} AS idx FROM documents")
def shuffle_order(spark, sf):
    return O.with_index(_docs(spark, sf).select("doc_id"), "doc_id", SEED)


@register("split_val", f"SELECT doc_id FROM (SELECT doc_id, {_IDX} AS idx FROM documents) WHERE idx < {VAL_SIZE}")
def split_val(spark, sf):
    return O.split_fixed(_docs(spark, sf).select("doc_id"), "doc_id", VAL_SIZE, SEED)[1]


@register("split_train", f"SELECT doc_id FROM (SELECT doc_id, {_IDX} AS idx FROM documents) WHERE idx >= {VAL_SIZE}")
def split_train(spark, sf):
    return O.split_fixed(_docs(spark, sf).select("doc_id"), "doc_id", VAL_SIZE, SEED)[0]


def _batch_sql(src: str, seed: int) -> str:
    idx = f"row_number() OVER (ORDER BY {S.s_md5_index('doc_id', seed)}, doc_id) - 1"
    return (f"SELECT doc_id, batch_id, pos, {S.s_md5_index('batch_id', seed + 1)} AS batch_order FROM ("
            f"SELECT doc_id, CAST(floor(i / {BATCH}) AS BIGINT) AS batch_id, CAST(i % {BATCH} AS INTEGER) AS pos, n FROM ("
            f"SELECT doc_id, {idx} AS i, count(*) OVER () AS n FROM ({src}))) "
            f"WHERE batch_id < floor(n / {BATCH})")


_TRAIN_SQL = f"SELECT doc_id FROM (SELECT doc_id, {_IDX} AS idx FROM documents) WHERE idx >= {VAL_SIZE}"


@register("batch_rows", _batch_sql(_TRAIN_SQL, SEED + 10))
def batch_rows(spark, sf):
    train = O.split_fixed(_docs(spark, sf).select("doc_id"), "doc_id", VAL_SIZE, SEED)[0]
    return O.batch_rows(train, "doc_id", BATCH, SEED + 10)


_ID_IDX = "CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT)"


@register("shard_contiguous",
          f"SELECT doc_id, idx, CAST(floor(idx / {ROWS_PER_SHARD}) AS INTEGER) AS shard FROM "
          f"(SELECT doc_id, {_ID_IDX} AS idx FROM documents)")
def shard_contiguous(spark, sf):
    return O.assign_shards(_docs(spark, sf).select("doc_id"), "doc_id", ROWS_PER_SHARD, "contiguous")


@register("shard_strided",
          f"SELECT doc_id, idx, CAST(idx % ceil(n / {ROWS_PER_SHARD}) AS INTEGER) AS shard FROM "
          f"(SELECT doc_id, {_ID_IDX} AS idx, count(*) OVER () AS n FROM documents)")
def shard_strided(spark, sf):
    return O.assign_shards(_docs(spark, sf).select("doc_id"), "doc_id", ROWS_PER_SHARD, "strided")


@register("shard_resume",
          f"SELECT doc_id, idx, shard FROM (SELECT doc_id, idx, CAST(floor(idx / {ROWS_PER_SHARD}) AS INTEGER) AS shard "
          f"FROM (SELECT doc_id, {_ID_IDX} AS idx FROM documents)) WHERE shard >= {START_FROM}")
def shard_resume(spark, sf):
    s = O.assign_shards(_docs(spark, sf).select("doc_id"), "doc_id", ROWS_PER_SHARD, "contiguous")
    return s.where(F.col("shard") >= START_FROM)


@register("shard_counts",
          f"SELECT shard, count(*) AS n_rows, CAST(ceil(max(n) / {ROWS_PER_SHARD}) AS BIGINT) AS n_shards FROM ("
          f"SELECT CAST(floor(idx / {ROWS_PER_SHARD}) AS INTEGER) AS shard, n FROM "
          f"(SELECT {_ID_IDX} AS idx, count(*) OVER () AS n FROM documents)) GROUP BY shard")
def shard_counts(spark, sf):
    s = O.assign_shards(_docs(spark, sf).select("doc_id"), "doc_id", ROWS_PER_SHARD, "contiguous")
    per = s.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"))
    # one row per shard: a window over this small table gives ceil(n / rows) = max(shard) + 1
    return per.select("shard", "n_rows",
                      (F.max("shard").over(Window.partitionBy(F.lit(1))) + 1).cast("bigint").alias("n_shards"))


_CORPORA = {"oscar": "en", "news": "de", "xlsum": "fr", "liputan6": "es"}   # every document belongs to one


@register("union_corpora", " UNION ALL ".join(
    f"SELECT '{c}' AS corpus, doc_id, n_chars FROM documents WHERE lang = '{l}'" for c, l in _CORPORA.items()))
def union_corpora(spark, sf):
    from ..sources.readers import union_corpora as U
    d = _docs(spark, sf)
    return U({c: d.where(F.col("lang") == l).select("doc_id", "n_chars") for c, l in _CORPORA.items()})


_LOOKUP_SQL = ("SELECT doc_id, idx, text FROM (SELECT doc_id, text, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) "
               "AS idx FROM documents WHERE lang = 'de') WHERE idx IN (0, 7, 42)")


@register("lookup_index", _LOOKUP_SQL)
def lookup_index(spark, sf):
    d = _docs(spark, sf).where(F.col("lang") == "de").select("doc_id", "text")
    return O.with_index_by_id(d, "doc_id").where(F.col("idx").isin(0, 7, 42)).select("doc_id", "idx", "text")


@register("lookup_stored", _LOOKUP_SQL)
def lookup_stored(spark, sf):
    """F7 on a table that keeps a position index: it is written once, a lookup reads only the files that hold its rows."""
    d = _docs(spark, sf).where(F.col("lang") == "de").select("doc_id", "text")
    path = f"{ensure_checkpoint_dir(spark)}/positions-{uuid.uuid4().hex}"
    write_indexed(d, path, rows_per_file=ROWS_PER_SHARD)
    return lookup_positions(spark, path, [0, 7, 42]).select("doc_id", "idx", "text")


@register("sample_sentences",
          f"SELECT doc_id, CAST(sid AS INTEGER) AS sid, sentence FROM (SELECT doc_id, unnest(range(len(s))) AS sid, "
          f"unnest(s) AS sentence FROM (SELECT doc_id, {S.s_sentences('text')} AS s FROM documents)) "
          f"ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || CAST(sid AS VARCHAR) || '|{SEED}'), doc_id, sid LIMIT {SAMPLE}")
def sample_sentences(spark, sf):
    from ..operators.vocab import sample_sentences as sample
    d = _docs(spark, sf)
    return sample(d, SAMPLE, SEED)


# --- L7 training table ---------------------------------------------------------------------------

def _training_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS corpus, doc_id FROM documents WHERE lang = '{l}'" for c, l in _CORPORA.items())
    key = "corpus || ':' || CAST(doc_id AS VARCHAR)"
    idx = f"row_number() OVER (ORDER BY md5({key} || '|{SEED}'), {key}) - 1"
    indexed = f"SELECT corpus, doc_id, {key} AS row_key, {idx} AS gi FROM ({parts})"

    def batched(where: str, seed: int, split: str) -> str:
        bidx = f"row_number() OVER (ORDER BY md5(row_key || '|{seed}'), row_key) - 1"
        return (f"SELECT '{split}' AS split, corpus, doc_id, batch_id, pos, md5(CAST(batch_id AS VARCHAR) || '|{seed + 1}') "
                f"AS batch_order FROM (SELECT corpus, doc_id, CAST(floor(i / {BATCH}) AS BIGINT) AS batch_id, "
                f"CAST(i % {BATCH} AS INTEGER) AS pos, n FROM (SELECT corpus, doc_id, {bidx} AS i, count(*) OVER () AS n "
                f"FROM ({indexed}) WHERE {where})) WHERE batch_id < floor(n / {BATCH})")

    return batched(f"gi < {VAL_SIZE}", SEED + 1, "validation") + " UNION ALL " + batched(
        f"gi >= {VAL_SIZE}", SEED + 3, "train")


@register("training_table", _training_sql())
def training_table(spark, sf):
    from .corpora_train import training_table as TT
    d = _docs(spark, sf)
    corpora = {c: d.where(F.col("lang") == l).select("doc_id") for c, l in _CORPORA.items()}
    return TT(corpora, VAL_SIZE, BATCH, SEED)


# --- G1: seeded order of shard files ----------------------------------------------------------------

@register("shuffle_files",
          "SELECT corpus, shard, md5(corpus || ':' || CAST(shard AS VARCHAR) || '|" + str(SEED) + "') AS file_order FROM ("
          + " UNION ALL ".join(
              f"SELECT DISTINCT '{c}' AS corpus, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / {ROWS_PER_SHARD}) AS INTEGER) "
              f"AS shard FROM documents WHERE lang = '{l}'" for c, l in _CORPORA.items()) + ")")
def shuffle_files(spark, sf):
    """G1: the shard files of three corpora (contiguous shards in id order), each with
    a seeded hash order in place of ``random.shuffle``."""
    d = _docs(spark, sf)
    parts = []
    for c, l in _CORPORA.items():
        sh = O.assign_shards(d.where(F.col("lang") == l).select("doc_id"), "doc_id", ROWS_PER_SHARD)
        parts.append(sh.select(F.lit(c).alias("corpus"), "shard").distinct())
    files = reduce(lambda a, b: a.unionByName(b), parts)
    files = files.withColumn("name", F.concat_ws(":", "corpus", F.col("shard").cast("string")))
    return O.shuffle_files(files, "name", SEED).select("corpus", "shard", "file_order")
