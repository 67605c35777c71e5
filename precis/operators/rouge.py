"""ROUGE-1/2/L F-measures for a table of (id, prediction, gold) pairs (K1-K4).

Tokenisation follows the scorer's defaults without stemming: lowercase, runs of
[a-z0-9]. F = 2*overlap / (grams(pred) + grams(gold)) (0 when that is 0), which is the
harmonic mean of precision and recall written without the two divisions.

Prediction and gold text stand in one row, so nothing is shuffled and pairs that repeat a key
stay apart: an Arrow kernel codes the tokens of a batch of pairs, counts its n-grams per
pair and side, and takes the bit-parallel LCS (O(|a|*|b|/64) word operations) for ROUGE-L.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .batches import in_parts, token_codes


def _f(overlap: Column, total: Column) -> Column:
    return F.when(total > 0, F.lit(2.0) * overlap / total).otherwise(F.lit(0.0))


# ---------------------------------------------------------------------------------
# LCS

def lcs_length(a: list, b: list) -> int:
    """Bit-parallel LCS length (Allison-Dix / Hyyro): one big-int pass per token of
    the shorter sequence over a bit vector as long as the longer one."""
    if len(a) < len(b):
        a, b = b, a
    n = len(a)
    if n == 0 or not b:
        return 0
    masks: dict = {}
    for i, t in enumerate(a):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << n) - 1
    v = full
    for t in b:
        m = masks.get(t)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def lcs_dp(a: list, b: list) -> int:
    """Textbook O(|a|*|b|) dynamic programme, for tests."""
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b):
            cur.append(prev[j] + 1 if x == y else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


# ---------------------------------------------------------------------------------
# Batch kernel

def _bigrams(codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of the pairs of neighbours within a text."""
    inside = owner[1:] == owner[:-1]
    pair, coded = np.unique((codes[:-1] * n + codes[1:])[inside], return_inverse=True)
    return coded, owner[1:][inside], max(1, len(pair))


def _shared(codes: np.ndarray, owner: np.ndarray, n: int, rows: int) -> np.ndarray:
    """Common grams (with repeats) of texts i and rows + i, for every i."""
    gram, group = np.unique(owner % rows * n + codes, return_inverse=True)
    first = np.bincount(group[owner < rows], minlength=len(gram))
    second = np.bincount(group[owner >= rows], minlength=len(gram))
    return np.bincount(gram // n, np.minimum(first, second), rows).astype(np.int64)


def _measure(with_lcs: bool):
    fields = [f"{m}{n}" for n in (1, 2) for m in ("overlap", "pred", "gold")] + ["lcs"] * with_lcs

    def kernel(pred: pa.Array, gold: pa.Array) -> pa.Array:
        rows = len(pred)
        both = pa.concat_arrays([pred, gold])
        grams = token_codes(pc.replace_substring_regex(pc.fill_null(both, ""), "[^a-z0-9]+", " "))
        codes, owner, _ = grams
        out = []
        for _ in (1, 2):
            size = np.bincount(grams[1], minlength=2 * rows).astype(np.int64)
            out += [_shared(*grams, rows) if rows else size, size[:rows], size[rows:]]
            grams = _bigrams(*grams)
        if with_lcs:
            cuts = np.searchsorted(owner, np.arange(2 * rows + 1))
            part = [codes[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
            out.append(np.fromiter(map(lcs_length, part[:rows], part[rows:]), np.int64, rows))
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names=fields)

    # nondeterministic: evaluated once, however many of its fields are read
    return F.arrow_udf(in_parts(kernel), StructType([StructField(f, LongType()) for f in fields])).asNondeterministic()


_COUNTS, _COUNTS_LCS = _measure(False), _measure(True)


def rouge_counts(pairs: DataFrame, pred: str, gold: str, with_lcs: bool = False) -> DataFrame:
    """``pairs`` with ``_m``: overlap, pred and gold counts of 1- and 2-grams (and lcs). A null text is empty."""
    udf = _COUNTS_LCS if with_lcs else _COUNTS
    return pairs.withColumn("_m", udf(F.lower(F.col(pred)), F.lower(F.col(gold))))


def _rouge(n: int | str) -> Column:
    if n == "L":
        return _f(F.col("_m.lcs"), F.col("_m.pred1") + F.col("_m.gold1")).alias("rougeL")
    return _f(F.col(f"_m.overlap{n}"), F.col(f"_m.pred{n}") + F.col(f"_m.gold{n}")).alias(f"rouge{n}")


def rouge_n(pairs: DataFrame, n: int, id_col: str = "id", pred: str = "pred", gold: str = "gold") -> DataFrame:
    """K1 (n = 1), K2 (n = 2): id, rouge{n} of every row."""
    return rouge_counts(pairs, pred, gold).select(id_col, _rouge(n))


def rouge_l(pairs: DataFrame, id_col: str = "id", pred: str = "pred", gold: str = "gold") -> DataFrame:
    """K3: id, rougeL of every row."""
    return rouge_counts(pairs, pred, gold, with_lcs=True).select(id_col, _rouge("L"))


def score_pairs(pairs: DataFrame, id_col: str | list[str] = "id", pred: str = "pred", gold: str = "gold",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """K4: key, kept columns, pred, gold, rouge1, rouge2, rougeL of every row. No exchange."""
    key = [id_col] if isinstance(id_col, str) else list(id_col)
    return rouge_counts(pairs, pred, gold, with_lcs=True).select(*key, *keep, pred, gold, *map(_rouge, (1, 2, "L")))
