"""Registered queries: extractive candidates and their evaluation.

The evaluation set is derived from ``documents``: gold = the first two sentences,
article = the rest, corpus = the document language.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates as K
from . import derived as D
from . import sql as S
from .q_clean import DOCS, _docs
from .q_gsg import gsg_ranked_sql, rouge_n_sql
from .registry import register

NUM_CANDIDATES = 4
THRESHOLD = 0.3

_EVAL_SQL = (f"SELECT doc_id, lang AS corpus, {S.s_article_of('text')} AS article, "
             f"{S.s_summary_of('text')} AS gold FROM documents")


def eval_set(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.col("lang").alias("corpus"), D.article_of(F.col("text")).alias("article"),
                    D.summary_of(F.col("text")).alias("gold"))


def _cands_sql() -> str:
    src = f"SELECT doc_id, article AS t FROM ({_EVAL_SQL})"
    return (f"WITH {gsg_ranked_sql(src)} SELECT doc_id, CAST(n AS INTEGER) AS rank, "
            f"string_agg(sentence, ' ' ORDER BY sid) AS summary FROM r3, range(1, {NUM_CANDIDATES} + 1) t(n) "
            f"WHERE rank <= n AND n <= m GROUP BY doc_id, n")


@register("candidates_extractive", _cands_sql())
def candidates_extractive(spark, sf):
    return K.extractive_candidates(eval_set(spark, sf), num_candidates=NUM_CANDIDATES)


def scored_candidates(spark, sf, keep=("corpus", "article")):
    """Candidates scored against the gold summary; ``keep`` lists the columns the caller
    needs (the article is only carried along when asked for)."""
    ev = eval_set(spark, sf)
    cands = K.extractive_candidates(ev, num_candidates=NUM_CANDIDATES, keep=("gold", *keep))
    return K.score_candidates(cands, gold_col="gold", keep=tuple(keep))


_PAIR_SQL = (f"SELECT CAST(c.doc_id AS VARCHAR) || ':' || CAST(c.rank AS VARCHAR) AS cand_id, c.doc_id, c.rank, "
             f"c.summary AS pred, e.gold, e.article FROM ({_cands_sql()}) c JOIN ({_EVAL_SQL}) e ON c.doc_id = e.doc_id")


def _score_fmt_sql(x: str) -> str:
    v = f"CAST(floor({x} * 1000000 + 0.5) AS BIGINT)"
    return f"CAST({v} // 1000000 AS VARCHAR) || '.' || lpad(CAST({v} % 1000000 AS VARCHAR), 6, '0')"


_OVER_SQL = (
    f"WITH s AS (SELECT p.*, r.rouge1 FROM ({_PAIR_SQL}) p JOIN ({rouge_n_sql(_PAIR_SQL, 1, key='cand_id')}) r "
    f"ON p.cand_id = r.cand_id WHERE r.rouge1 > {THRESHOLD}) "
    "SELECT doc_id, count(*) AS n_hits, '================================' || chr(10) || 'index: ' || CAST(doc_id AS VARCHAR) "
    "|| chr(10) || 'article: ' || any_value(article) || chr(10) || 'gold: ' || any_value(gold) || chr(10) || '--------' "
    "|| chr(10) || string_agg('summary: ' || pred || chr(10) || 'rouge1: ' || " + _score_fmt_sql("rouge1") +
    ", chr(10) ORDER BY rank) AS report FROM s GROUP BY doc_id")


@register("candidates_over", _OVER_SQL)
def candidates_over(spark, sf):
    return K.candidate_report(scored_candidates(spark, sf), THRESHOLD)


@register("rouge_candidates",
          f"SELECT p.cand_id, p.doc_id, p.rank, r1.rouge1, r2.rouge2 FROM ({_PAIR_SQL}) p "
          f"JOIN ({rouge_n_sql(_PAIR_SQL, 1, key='cand_id')}) r1 ON p.cand_id = r1.cand_id "
          f"JOIN ({rouge_n_sql(_PAIR_SQL, 2, key='cand_id')}) r2 ON p.cand_id = r2.cand_id")
def rouge_candidates(spark, sf):
    return scored_candidates(spark, sf, keep=()).select("cand_id", "doc_id", "rank", "rouge1", "rouge2")


_ALL_SCORED_SQL = (f"SELECT p.*, r1.rouge1, r2.rouge2, rl.rougeL FROM ({_PAIR_SQL}) p "
                   f"JOIN ({rouge_n_sql(_PAIR_SQL, 1, key='cand_id')}) r1 ON p.cand_id = r1.cand_id "
                   f"JOIN ({rouge_n_sql(_PAIR_SQL, 2, key='cand_id')}) r2 ON p.cand_id = r2.cand_id "
                   f"JOIN ({S.rouge_l_sql(_PAIR_SQL, 'pred', 'gold', ['cand_id'])}) rl ON p.cand_id = rl.cand_id")
_NESTED_SQL = ("SELECT doc_id, any_value(article) AS article, any_value(gold) AS gold, string_agg(pred || ' | ' || "
               + " || ' | ' || ".join(_score_fmt_sql(m) for m in ("rouge1", "rouge2", "rougeL"))
               + f", chr(10) ORDER BY rank) AS result FROM ({_ALL_SCORED_SQL}) GROUP BY doc_id")


@register("candidates_nested", _NESTED_SQL)
def candidates_nested(spark, sf):
    """K5: the nested list, its items written as text."""
    nested = K.nest_candidates(scored_candidates(spark, sf), "doc_id", extra=("article", "gold"))
    return nested.withColumn("result", F.array_join(F.transform("result", lambda x: F.concat_ws(
        " | ", x["summary"], *[K.six_places(x[m]) for m in ("rouge1", "rouge2", "rougeL")])), "\n"))


_RANK1_SQL = f"SELECT * FROM ({_PAIR_SQL}) WHERE rank = 1"
_SCORED_SQL = (f"SELECT p.cand_id, p.doc_id, p.rank, e.corpus, p.article, p.gold, p.pred AS summary, r1.rouge1, r2.rouge2, "
               f"rl.rougeL FROM ({_RANK1_SQL}) p "
               f"JOIN ({rouge_n_sql(_RANK1_SQL, 1, key='cand_id')}) r1 ON p.cand_id = r1.cand_id "
               f"JOIN ({rouge_n_sql(_RANK1_SQL, 2, key='cand_id')}) r2 ON p.cand_id = r2.cand_id "
               f"JOIN ({S.rouge_l_sql(_RANK1_SQL, 'pred', 'gold', ['cand_id'])}) rl ON p.cand_id = rl.cand_id "
               f"JOIN ({_EVAL_SQL}) e ON p.doc_id = e.doc_id")


@register("corpus_means",
          "SELECT corpus, count(*) AS n, round(avg(rouge1 * 100.0), 6) AS rouge1_x100, "
          "round(avg(rouge2 * 100.0), 6) AS rouge2_x100, round(avg(rougeL * 100.0), 6) AS rougeL_x100 "
          f"FROM ({_SCORED_SQL}) GROUP BY corpus")
def corpus_means(spark, sf):
    return K.corpus_means(scored_candidates(spark, sf, keep=("corpus",)).where(F.col("rank") == 1), "corpus")


@register("eval_report", f"SELECT doc_id, article, gold, summary, rouge1, rouge2, rougeL FROM ({_SCORED_SQL})")
def eval_report(spark, sf):
    """Article | gold | summary | rouge1 | rouge2 | rougeL for the first candidate."""
    s = scored_candidates(spark, sf).where(F.col("rank") == 1)
    return s.select("doc_id", "article", "gold", F.col("summary"), "rouge1", "rouge2", "rougeL")
