"""H1, learned: abbreviations found in the corpus itself, and a sentence split that does not break after them.

The statistics are those of Kiss and Strunk (Unsupervised Multilingual Sentence Boundary Detection, 2006), first stage: a
word that nearly always carries a final period, by Dunning's log-likelihood ratio, is short, holds inner periods and is
rarely seen without the final one, is an abbreviation. Their second stage (collocations, sentence starters, which reviews
single places) is not built. Words are counted over all texts with partial sums in each partition; one row a distinct
word is exchanged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PY_WS, PY_WS_CHARS, words

# Fixed values of the published method: the share of periods after an abbreviation, and the least score.
AFTER_ABBREVIATION = 0.99
LEAST_SCORE = 0.3
# Characters that are not part of a word at its start and end.
EDGE = "\"'()[]{},;:!?"
HAS_LETTER = r"\p{L}"


def period_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n, n_period): how often each lower-cased word occurs, and how often with a final period, which is not part
    of ``word``. Words without a letter stand together as the empty word; null texts have none."""
    raw = docs.select(F.explode(words(text_col)).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    token = raw.select(F.lower(F.btrim("raw", F.lit(EDGE))).alias("token"), "n")  # once a distinct token
    period = F.col("token").endswith(".")
    word = F.when(F.col("token").rlike(HAS_LETTER), F.when(period, F.expr("left(token, length(token) - 1)")).otherwise(F.col("token")))
    return token.groupBy(F.coalesce(word, F.lit("")).alias("word")).agg(
        F.sum("n").alias("n"), F.sum(F.when(period, F.col("n")).otherwise(F.lit(0))).alias("n_period"))


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """(word, n, n_period, score) of the words that end in a period at least once. ``counts`` is read twice, so cut its
    lineage first where it is dear; the totals of all words are one row."""
    totals = counts.agg(F.sum("n").alias("a"), F.sum("n_period").alias("b")).select(
        F.least(F.greatest(F.col("b") / F.col("a"), F.lit(1e-9)), F.lit(1 - 1e-9)).alias("p"))
    p = totals.scalar()
    seen = counts.where((F.col("word") != "") & (F.col("n_period") > 0)).withColumn("_p", p)
    without = F.col("n") - F.col("n_period")
    null = F.col("n_period") * F.ln("_p") + without * F.ln(1 - F.col("_p"))
    other = F.col("n_period") * F.ln(F.lit(AFTER_ABBREVIATION)) + without * F.ln(F.lit(1 - AFTER_ABBREVIATION))
    inner = F.length("word") - F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = -2 * (null - other) * F.exp(-letters - without * F.ln(letters)) * (inner + 1)
    return seen.select("word", "n", "n_period", score.alias("score"))


def learn_abbreviations(docs: DataFrame, text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """(word, n, n_period, score) of the abbreviations of a corpus."""
    return abbreviation_scores(period_counts(docs, text_col)).where(F.col("score") >= least)


def split_after(c: Column | str, abbreviations: Sequence[str]) -> Column:
    """Sentences as ``text.split_sentences`` gives them, but a period that ends a word of ``abbreviations`` (lower case,
    without that period) is no break. Words are looked up in a set, so a long list costs no more than a short one.
    Null text: null; empty or blank text: no sentence."""
    t = F.col(c) if isinstance(c, str) else c
    pieces = F.split(t, "(?<=[.!?])(?=" + PY_WS + ")", -1)
    known = sorted(set(abbreviations) - {""})
    last_word = "(?<![^" + PY_WS[1:-1] + "])([^" + PY_WS[1:-1] + r"]*)\.$"   # tried at word starts alone

    def closed(piece: Column) -> Column:
        end = F.concat(piece, F.lit("\u0001"))
        if not known:
            return end
        tail = F.substring_index(piece, " ", -1)  # a space ends a word: the pattern sees no more than the last one
        last = F.lower(F.btrim(F.regexp_extract(tail, last_word, 1), F.lit(EDGE)))
        return F.when(piece.endswith(".") & last.isin(known), piece).otherwise(end)

    joined = F.array_join(F.transform(pieces, closed), "")
    sentences = F.split(joined, "\u0001(?:" + PY_WS + "+|$)", -1)
    return F.filter(sentences, lambda s: F.length(F.ltrim(s, F.lit(PY_WS_CHARS))) > 0)
