"""Candidate summaries and their evaluation (K5-K8, B9, G0f, G0g).

The reference gets candidates from a neural decoder. Here they are data: either a
``candidates(doc_id, rank, summary)`` table, or the extractive generator below whose
n-th candidate is the top-n sentences of the GSG ranking in document order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.gsg import ranked_documents
from ..operators.filters import over_threshold
from ..operators.rouge import score_pairs
from ..options import DEFAULT, Options


def extractive_candidates(docs: DataFrame, opts: Options = DEFAULT, id_col: str = "doc_id",
                          text_col: str = "article", num_candidates: int | None = None,
                          keep: tuple[str, ...] = ()) -> DataFrame:
    """K8: (doc_id, rank, summary, keep...) for rank = 1 .. min(num_candidates, sentences), row by row."""
    n = num_candidates or opts.num_candidates
    docs = ranked_documents(docs, opts, id_col, text_col, keep=keep)
    cands = docs.select("doc_id", "sents", "facts", *keep,
                        F.explode(F.sequence(F.lit(1), F.least(F.lit(n), F.col("m")))).alias("rank"))
    # zip the candidate number into every element: lambdas read only their element
    z = F.arrays_zip(F.col("sents").alias("s"), F.col("facts").alias("f"),
                     F.array_repeat(F.col("rank"), F.size("sents")).alias("n"))
    summary = F.array_join(F.transform(F.filter(z, lambda e: e["f"]["rank"] <= e["n"]), lambda e: e["s"]), " ")
    return cands.select(F.col("doc_id").alias(id_col), "rank", summary.alias("summary"), *keep)


def score_candidates(cands: DataFrame, id_col: str = "doc_id", gold_col: str = "gold",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """K4 over (candidate, gold) where ``cands`` carries the gold column: one row per candidate with rouge1/2/L,
    no exchange."""
    scored = score_pairs(cands, [id_col, "rank"], pred="summary", gold=gold_col, keep=keep)
    return scored.withColumn("cand_id", F.concat_ws(":", F.col(id_col).cast("string"), F.col("rank").cast("string")))


def score_candidate_table(cands: DataFrame, gold: DataFrame, id_col: str = "doc_id",
                          gold_col: str = "gold", keep: tuple[str, ...] = ()) -> DataFrame:
    """K8 (a): candidates given as data, ``cands(id, rank, summary)``, scored against a
    gold table ``gold(id, gold, keep...)``. The join shuffles both on the id; the scoring is row-local."""
    joined = cands.join(gold.select(id_col, gold_col, *keep), id_col)
    return score_candidates(joined, id_col, gold_col, keep)


def nest_candidates(scored: DataFrame, id_col: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """K5/G0g: per article, the candidates with their scores, ordered by rank. The
    list is bounded by the number of candidates per article."""
    item = F.struct("rank", "summary", "rouge1", "rouge2", "rougeL")
    grouped = scored.groupBy(id_col, *extra).agg(F.sort_array(F.collect_list(item)).alias("_r"))
    return grouped.select(id_col, *extra, F.transform(
        "_r", lambda x: F.struct(x["summary"].alias("summary"), x["rouge1"].alias("rouge1"),
                                 x["rouge2"].alias("rouge2"), x["rougeL"].alias("rougeL"))).alias("result"))


# The report's labels and rules.
RULE, DASHES = "=" * 32, "-" * 8
INDEX, ARTICLE, GOLD, SUMMARY, ROUGE1 = "index: ", "article: ", "gold: ", "summary: ", "rouge1: "


def six_places(c: Column) -> Column:
    """A score from 0 to 1 with six decimals, half up."""
    v = F.floor(c * 1000000 + 0.5).cast("bigint")
    return F.concat(F.floor(v / 1000000).cast("bigint").cast("string"), F.lit("."),
                    F.lpad(F.pmod(v, F.lit(1000000)).cast("string"), 6, "0"))


def candidate_report(scored: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
                     article_col: str = "article", gold_col: str = "gold") -> DataFrame:
    """(id, n_hits, report) of each article with a candidate whose rouge1 is above the threshold: rule, index,
    article, gold, then each hit by rank. An article's list is bounded by its candidates."""
    line = F.concat(F.lit(SUMMARY), F.col("summary"), F.lit("\n" + ROUGE1), six_places(F.col("rouge1")))
    per_doc = over_threshold(scored, "rouge1", threshold).groupBy(id_col).agg(
        F.first(article_col).alias("_article"), F.first(gold_col).alias("_gold"), F.count(F.lit(1)).alias("n_hits"),
        F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("_h"))
    head = [F.lit(RULE), F.concat(F.lit(INDEX), F.col(id_col).cast("string")), F.concat(F.lit(ARTICLE), "_article"),
            F.concat(F.lit(GOLD), "_gold"), F.lit(DASHES)]
    return per_doc.select(id_col, "n_hits", F.concat_ws("\n", *head, F.transform("_h", lambda x: x["l"])).alias("report"))


def corpus_means(scored: DataFrame, by: str = "corpus") -> DataFrame:
    """K7/G0f: mean F x 100 per corpus, rounded to 6 places."""
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.round(F.avg(F.col(m) * 100.0), 6).alias(f"{m}_x100") for m in ("rouge1", "rouge2", "rougeL")])
