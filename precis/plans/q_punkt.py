"""Registered queries: abbreviations learned from ``documents`` and the sentence split that knows them (H1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import abbreviations as A
from ..session import cut_lineage
from . import sql as S
from .q_clean import _docs
from .registry import register

_NOT_WS = "[^" + T.PY_WS[1:-1] + "]"
_EDGE = S.q(A.EDGE)
_TOKENS = (f"SELECT lower(trim(raw, {_EDGE})) AS token FROM (SELECT unnest(regexp_extract_all(text, {S.q(_NOT_WS + '+')})) AS raw "
           "FROM documents)")
_COUNTS = (f"SELECT CASE WHEN NOT regexp_matches(token, {S.q(A.HAS_LETTER)}) THEN '' WHEN ends_with(token, '.') THEN "
           "token[:-2] ELSE token END AS word, count(*) AS n, count(*) FILTER (WHERE ends_with(token, '.')) AS n_period "
           f"FROM ({_TOKENS}) GROUP BY 1")
_SCORES = (f"WITH c AS MATERIALIZED ({_COUNTS}), s AS (SELECT word, n, n_period, n - n_period AS wo, "
           "least(greatest((SELECT sum(n_period)::DOUBLE / sum(n) FROM c), 1e-9), 1 - 1e-9) AS p, "
           "length(word) - length(replace(word, '.', '')) AS inn, length(replace(word, '.', '')) AS let FROM c "
           "WHERE word <> '' AND n_period > 0) SELECT word, n, n_period, -2 * ((n_period * ln(p) + wo * ln(1 - p)) - "
           f"(n_period * ln({A.AFTER_ABBREVIATION}::DOUBLE) + wo * ln(1 - {A.AFTER_ABBREVIATION}::DOUBLE))) "
           "* exp(-let - wo * ln(let)) * (inn + 1) AS score FROM s")
_LEARNED = f"SELECT * FROM ({_SCORES}) WHERE score >= {A.LEAST_SCORE}"


@register("punkt_scores", f"SELECT word, n, n_period, round(score, 6) + 0.0 AS score FROM ({_SCORES})")
def punkt_scores(spark, sf):
    counts = cut_lineage(A.period_counts(_docs(spark, sf)))
    return A.abbreviation_scores(counts).withColumn("score", F.round("score", 6) + F.lit(0.0))


_MARKED = f"regexp_replace(text, {S.q('([.!?])(' + T.PY_WS + ')')}, '\\1' || chr(1) || '\\2', 'g')"
_LAST = f"lower(trim(regexp_extract(x, {S.q('(' + _NOT_WS + '*)[.]$')}, 1), {_EDGE}))"
_PIECES = (f"list_transform(string_split({_MARKED}, chr(1)), lambda x: CASE WHEN {_LAST} <> '' AND list_contains(ab, {_LAST}) "
           "THEN x ELSE x || chr(1) END)")
_SPLIT = (f"list_filter(string_split(regexp_replace(array_to_string({_PIECES}, ''), {S.q(chr(1) + '(' + T.PY_WS + '+|$)')}, chr(2), 'g'), "
          f"chr(2)), lambda y: NOT regexp_full_match(y, {S.q(T.PY_WS + '*')}))")


@register("punkt_sentences",
          f"SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, chr(10))) AS sentences FROM (SELECT doc_id, {_SPLIT} AS s "
          f"FROM documents, (SELECT coalesce(list(word), []) AS ab FROM ({_LEARNED})))")
def punkt_sentences(spark, sf):
    """Every text, split by the abbreviations of all texts. The learned list is a model: it goes through the driver."""
    docs = _docs(spark, sf)
    counts = cut_lineage(A.period_counts(docs))
    known = [r["word"] for r in A.abbreviation_scores(counts).where(F.col("score") >= A.LEAST_SCORE).select("word").collect()]
    out = docs.select("doc_id", A.split_after("text", known).alias("s"))
    return out.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences"))
