"""The training table -- union of corpora, seeded global shuffle, fixed-size
validation split, and batches (remainder dropped) in a seeded order per split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import order as O
from ..sources.readers import union_corpora


def training_table(corpora: dict[str, DataFrame], val_size: int, batch_size: int, seed: int,
                   id_col: str = "doc_id") -> DataFrame:
    """(split, corpus, doc_id, batch_id, pos, batch_order). Rows are keyed by
    'corpus:id' so ids may repeat across corpora. The rows are exchanged once."""
    u = union_corpora(corpora).withColumn(
        "row_key", F.concat_ws(":", F.col("corpus"), F.col(id_col).cast("string")))
    out = O.batched_splits(u, "row_key", val_size, batch_size, seed)
    return out.select("split", "corpus", id_col, "batch_id", "pos", "batch_order")
