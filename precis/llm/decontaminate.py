"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

A seed reads some words of a window and ignores the others, so a substituted word at an ignored place leaves the
window's hash as it is. SEEDS lose nothing: wherever words are substituted, a stretch of LEAST matches net of substitutions
holds a whole window with one of them (``tests/llm`` walks through all patterns), so no overlap goes without a hit. The
hashes of all windows of all items and all documents under every seed are joined. A hit that follows on a hit of its seed
one word before goes at once; for those that start a run the whole item and the document are laid side by side and scored
word by word (a match adds one, a substitution takes one away); the best stretch counts as the overlap. Whole texts are
read, and nothing is shuffled but scores.

Item seeds are broadcast in blocks of bounded size; more items mean more blocks, each with a pass over the documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

SPAN = 10
SEEDS = ((0, 1, 3, 7), (0, 5, 6, 9), (0, 2, 7, 9), (0, 1, 3, 6), (0, 3, 4, 5))  # words read of a window of SPAN
LEAST = 10  # matches less substitutions that make an overlap
BLOCK = 500_000  # item seeds broadcast at once
NOT_WORD = r"[\x00-/:-@\[-`{-\x7f]+"  # ASCII that is no letter or digit


def words(text: Column) -> Column:
    """Lower-case words: what lies between ASCII white space and punctuation."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _windows(df: DataFrame, keep: list[str], at: str) -> DataFrame:
    """One row per window and seed: ``keep``, _h, ``at`` (first word), _k (number of the seed) and seed (hash)."""
    last = F.size("_h") - SPAN
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = df.select(*keep, "_h", F.explode(starts).alias(at))
    hashes = [F.xxhash64(F.lit(k), *[F.get("_h", F.col(at) + o) for o in seed]) for k, seed in enumerate(SEEDS)]
    return rows.select(*keep, "_h", at, F.posexplode(F.array(*hashes)).alias("_k", "seed"))


def _starts_run() -> Column:
    """Whether the same seed does not match one word before. Kept short: the join's generated method has to be one that
    the JVM compiles (8,000 bytes)."""
    places = F.get(F.array(*[F.array(*map(F.lit, seed)) for seed in SEEDS]), F.col("_k"))
    same = [F.get("_h", F.col("p") - 1 + F.get(places, F.lit(j))) == F.get("_item", F.col("q") - 1 + F.get(places, F.lit(j)))
            for j in range(len(SEEDS[0]))]
    return ~F.coalesce(reduce(Column.__and__, same), F.lit(False))


def _side_by_side(hits: DataFrame) -> DataFrame:
    """_a and _b: all words of item and document that lie side by side when word q lies beside word p. Cut out before
    the row leaves the join, so that no row carries a whole document."""
    shift = F.col("p") - F.col("q")
    low = F.greatest(F.lit(0), -shift)
    length = F.least(F.size("_item"), F.size("_h") - shift) - low
    return hits.select("_id", "_digest", "item_id", F.slice("_item", low + 1, length).alias("_a"),
                       F.slice("_h", low + shift + 1, length).alias("_b"))


def _overlap() -> Column:
    """Best score of a stretch of _a and _b; null where they are too short for one (_a and _b stand here twice each, so
    that the optimizer leaves them in a projection of their own, inside the generated code)."""
    same = F.zip_with("_a", "_b", lambda a, b: a == b)

    def step(s, match):
        now = F.greatest(F.lit(0), s["now"] + F.when(match, 1).otherwise(-1))
        return F.struct(now.alias("now"), F.greatest(s["best"], now).alias("best"))

    best = F.aggregate(same, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda s: s["best"])
    return F.when((F.size("_a") >= LEAST) & (F.size("_b") >= LEAST), best)


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(_id, _digest, item_id, overlap, n_items) for each text that holds benchmark passages: the item with the largest
    overlap (then the smallest id, of any type) and how many items overlap. _digest is a hash of the text, so that rows
    that repeat an id are told apart.

    An overlap is LEAST matches net of substitutions in a row of word pairs, of any length. Items and texts under SPAN
    words have no windows and never match, nor could they reach LEAST; null texts are empty; repeated items and rows count
    once; empty tables give no rows."""
    item_rows = settle(items.select(F.col(item_col).alias("item_id"), _hashes(F.col(item_text)).alias("_h"))
                       .where(F.size("_h") >= SPAN).distinct()
                       .withColumn("_n", F.xxhash64("item_id", "_h")))
    n_seeds = item_rows.agg(F.sum((F.size("_h") - SPAN + 1) * len(SEEDS))).first()[0] or 0
    blocks = max(1, -(-2 * n_seeds // BLOCK))  # hashing may fill a block unevenly
    doc_rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_digest"),
                           _hashes(F.col(text_col)).alias("_h"))
    found = []
    for k in range(blocks):
        block = item_rows.where(F.pmod("_n", F.lit(blocks)) == k)
        seeds = _windows(block, ["_n"], "q").select("seed", "q", "_n")
        texts_ = block.select(F.col("_n").alias("_m"), "item_id", F.col("_h").alias("_item"))
        hits = (_windows(doc_rows, ["_id", "_digest"], "p")
                .join(F.broadcast(seeds), "seed")  # BLOCK rows or about
                .join(F.broadcast(texts_), (F.col("_n") == F.col("_m")) & _starts_run()))
        found.append(_side_by_side(hits).select("_id", "_digest", "item_id", _overlap().alias("overlap")))
    best = (reduce(DataFrame.unionAll, found).groupBy("_id", "_digest", "item_id").agg(F.max("overlap").alias("overlap"))
            .where(F.col("overlap") >= LEAST))
    return best.groupBy("_id", "_digest").agg(
        F.min_by("item_id", F.struct(-F.col("overlap"), F.col("item_id"))).alias("item_id"),
        F.max("overlap").alias("overlap"), F.count("*").alias("n_items"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  **settings) -> DataFrame:
    """(``id_col``, contaminated, item_id, overlap, n_items) for every row; the last three are null or 0 if clean. Null and
    empty texts are clean; repeated rows stay; no documents give no rows, and without items all rows are clean."""
    found = overlaps(docs, items, id_col, text_col, **settings)
    rows = docs.select(F.col(id_col).alias("_i"), F.xxhash64(text_col).alias("_d"))
    return (rows.join(found, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_digest")), "left")
            .select(F.col("_i").alias(id_col), F.col("overlap").isNotNull().alias("contaminated"), "item_id",
                    F.coalesce("overlap", F.lit(0)).alias("overlap"),
                    F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **settings) -> DataFrame:
    """The rows of ``docs`` without benchmark passages, all columns as they are. Null and empty texts stay, repeated rows
    stay or go together; an empty table stays empty, and without items all rows stay."""
    found = overlaps(docs, items, id_col, text_col, **settings)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_i"),
                         F.xxhash64(text_col).alias("_d"))
    clean = packed.join(found, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_digest")), "left_anti")
    return clean.select("_row.*")
