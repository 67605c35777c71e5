"""Registered queries: sentences, gap-sentence generation, ROUGE, candidates, and the
adapters that run GSG (L3) or pair inputs (L4-L6)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rouge as R
from ..operators.gsg import count_without_sentences, gap_sentences, ranked_documents, ranked_sentences, sentence_scores
from ..options import DEFAULT, Options
from . import corpora as C
from . import derived as D
from . import sql as S
from .q_clean import DOCS, NEWS, _docs, _news, _LINE_LANG_SQL
from .registry import register


# --------------------------------------------------------------------------------------------
# SQL twins

def gsg_ranked_sql(src: str, opts: Options = DEFAULT) -> str:
    """CTE text (no leading WITH) ending in ``r3``: one row per sentence with overlap,
    n_tok, n_doc_tok, m, rank, k, u. ``src`` yields (doc_id, t)."""
    return f"""base AS (SELECT doc_id, {S.s_sentences('t')} AS sents FROM ({src})),
se AS (SELECT doc_id, unnest(range(len(sents))) AS sid, unnest(sents) AS sentence FROM base),
wd AS (SELECT doc_id, sid, unnest({S.s_gsg_tokens('sentence')}) AS w FROM se),
c AS (SELECT doc_id, sid, w, count(*) AS n_sent FROM wd GROUP BY doc_id, sid, w),
c2 AS (SELECT *, sum(n_sent) OVER (PARTITION BY doc_id, w) AS n_doc FROM c),
o AS (SELECT doc_id, sid, sum(least(n_sent, n_doc - n_sent)) AS overlap, sum(n_sent) AS n_tok FROM c2 GROUP BY doc_id, sid),
sc AS (SELECT se.doc_id, se.sid, se.sentence, CAST(coalesce(o.overlap, 0) AS BIGINT) AS overlap,
              CAST(coalesce(o.n_tok, 0) AS BIGINT) AS n_tok
       FROM se LEFT JOIN o ON se.doc_id = o.doc_id AND se.sid = o.sid),
r AS (SELECT *, CAST(sum(n_tok) OVER (PARTITION BY doc_id) AS BIGINT) AS n_doc_tok,
             CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS m,
             CAST(row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, sid) AS INTEGER) AS rank FROM sc),
r2 AS (SELECT *, CAST(greatest(1, floor(CAST(m AS DOUBLE) * {float(opts.gsg_rate)!r})) AS INTEGER) AS k FROM r),
r3 AS (SELECT *, CAST(k - greatest(0, floor(CAST(k AS DOUBLE) * {float(opts.return_mask_rate)!r})) AS INTEGER) AS u FROM r2)"""


def gsg_pairs_sql(src: str, opts: Options = DEFAULT, mode: str = "with_replacement") -> str:
    if mode == "all":
        masked = "sel"
    else:
        draw = (f"sel[(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '|' || CAST(j AS VARCHAR) || "
                f"'|{opts.seed}'), 1, 8) AS BIGINT) % k) + 1]")
        masked = f"list_distinct(list_transform(range(1, greatest(u, 0) + 1), lambda j: {draw}))"
    return f"""WITH {gsg_ranked_sql(src, opts)},
sel AS (SELECT doc_id, list(sid ORDER BY sid) AS sel, any_value(m) AS m, any_value(k) AS k, any_value(u) AS u
        FROM r3 WHERE rank <= k GROUP BY doc_id),
j AS (SELECT b.doc_id, b.sents, s.sel, s.m, s.k, s.u FROM base b JOIN sel s ON b.doc_id = s.doc_id),
jm AS (SELECT *, {masked} AS masked FROM j)
SELECT doc_id,
       array_to_string(list_transform(sents, lambda s, i: CASE WHEN list_contains(masked, i - 1) THEN '<mask_1>' ELSE s END), ' ') AS input,
       array_to_string(list_transform(sel, lambda i: sents[i + 1]), ' ') AS labels,
       m, k, CAST(len(masked) AS INTEGER) AS n_masked
FROM jm"""


PAIRS_SQL = ("SELECT CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR) AS pair_id, u.conv_id, u.turn, "
             "u.text AS pred, a.text AS gold FROM conversations u JOIN conversations a "
             "ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'")


def rouge_n_sql(pairs_sql: str, n: int, key: str = "pair_id", pred: str = "pred", gold: str = "gold",
                name: str | None = None) -> str:
    def grams(t):
        return t if n == 1 else S.s_bigrams(t)
    name = name or f"rouge{n}"
    return f"""WITH p AS ({pairs_sql}),
tk AS (SELECT {key}, {S.s_rouge_tokens(pred)} AS tp, {S.s_rouge_tokens(gold)} AS tg FROM p),
gr AS (SELECT {key}, {grams('tp')} AS gp, {grams('tg')} AS gg FROM tk),
tp AS (SELECT {key}, unnest(gp) AS g FROM gr),
tg AS (SELECT {key}, unnest(gg) AS g FROM gr),
cp AS (SELECT {key}, g, count(*) AS c FROM tp GROUP BY {key}, g),
cg AS (SELECT {key}, g, count(*) AS c FROM tg GROUP BY {key}, g),
ov AS (SELECT cp.{key}, sum(least(cp.c, cg.c)) AS o FROM cp JOIN cg ON cp.{key} = cg.{key} AND cp.g = cg.g GROUP BY cp.{key}),
ln AS (SELECT {key}, len(gp) AS np, len(gg) AS ng FROM gr)
SELECT ln.{key}, CASE WHEN np + ng > 0 THEN 2.0::DOUBLE * coalesce(ov.o, 0) / (np + ng) ELSE 0.0::DOUBLE END AS {name}
FROM ln LEFT JOIN ov ON ln.{key} = ov.{key}"""


# --------------------------------------------------------------------------------------------
# H1 / I

@register("split_sentences",
          f"SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS sid, unnest(s) AS sentence "
          f"FROM (SELECT doc_id, {S.s_sentences('text')} AS s FROM documents)")
def q_split_sentences(spark, sf):
    d = _docs(spark, sf)
    return d.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sid", "sentence"))


@register("gsg_sizes", f"WITH {gsg_ranked_sql(DOCS)} SELECT DISTINCT doc_id, m, k, u FROM r3")
def q_gsg_sizes(spark, sf):
    return ranked_documents(_docs(spark, sf)).select("doc_id", "m", "k", "u")


@register("gsg_empty", f"SELECT count(*) AS n_docs, count(*) FILTER (WHERE coalesce(len({S.s_sentences('text')}), 0) = 0) AS n_empty "
          "FROM documents")
def q_gsg_empty(spark, sf):
    return count_without_sentences(_docs(spark, sf))


@register("gsg_scores",
          f"WITH {gsg_ranked_sql(DOCS)} SELECT doc_id, CAST(sid AS INTEGER) AS sid, overlap, n_tok, "
          f"CASE WHEN n_doc_tok > 0 THEN 2.0::DOUBLE * overlap / n_doc_tok ELSE 0.0::DOUBLE END AS f1 FROM r3")
def q_gsg_scores(spark, sf):
    s = sentence_scores(_docs(spark, sf))
    return s.select("doc_id", "sid", "overlap", "n_tok", "f1")


@register("gsg_topk", f"WITH {gsg_ranked_sql(DOCS)} SELECT doc_id, CAST(sid AS INTEGER) AS sid, rank FROM r3 WHERE rank <= k")
def q_gsg_topk(spark, sf):
    r = ranked_sentences(_docs(spark, sf))
    return r.where(F.col("selected")).select("doc_id", "sid", "rank")


@register("gsg_mask_all", gsg_pairs_sql(DOCS, mode="all"))
def q_gsg_mask_all(spark, sf):
    return gap_sentences(_docs(spark, sf), mode="all")


_GSG_DRAWS = gsg_pairs_sql(DOCS, mode="with_replacement")


@register("gsg_mask_draws", _GSG_DRAWS)
def q_gsg_mask_draws(spark, sf):
    return gap_sentences(_docs(spark, sf), mode="with_replacement")


@register("gsg_udf", _GSG_DRAWS)
def q_gsg_udf(spark, sf):
    return gap_sentences(_docs(spark, sf), mode="with_replacement", engine="arrow")


# --------------------------------------------------------------------------------------------
# L3-L6 adapters

_OSCAR_SRC = S.chain(_LINE_LANG_SQL, "t", S.preset_steps("module", True))
_OSCAR_SRC = f"SELECT doc_id, {S.s_trunc_ws('t')} AS t FROM ({_OSCAR_SRC})"
_OSCAR_SQL = gsg_pairs_sql(_OSCAR_SRC)
_OSCAR_SQL = f"SELECT doc_id, input, labels FROM ({_OSCAR_SQL}) WHERE input <> 'SKIP'"


@register("prep_oscar", _OSCAR_SQL)
def prep_oscar(spark, sf):
    d = _docs(spark, sf)
    d = d.withColumn("meta_li", D.line_ids(F.col("doc_id"), F.col("text"), F.col("lang")))
    return C.prepare_oscar(d, "meta_li", lang="en")


_AS_SQL = f"SELECT doc_id, {S.s_article_of('t')} AS article, {S.s_summary_of('t')} AS summary FROM ({NEWS})"


def _article_summary(spark, sf):
    n = _news(spark, sf)
    return n.select("doc_id", D.article_of(F.col("t")).alias("article"), D.summary_of(F.col("t")).alias("summary"))


@register("prep_xlsum",
          f"SELECT doc_id, {S.s_trunc_space('article')} AS input, {S.s_trunc_space('summary')} AS labels FROM ("
          + S.chain(_AS_SQL, ["article", "summary"], S.preset_steps("module", True)) + ")")
def prep_xlsum(spark, sf):
    return C.prepare_xlsum(_article_summary(spark, sf), "doc_id", "article", "summary")


@register("prep_liputan6",
          "SELECT doc_id, article AS input, ' ' || summary AS labels FROM ("
          + S.chain(_AS_SQL, ["article", "summary"], S.preset_steps("finetune_nb", True)) + ")")
def prep_liputan6(spark, sf):
    return C.prepare_liputan6(_article_summary(spark, sf), "doc_id", "article", "summary")


_INDOSUM_RAW = (
    "SELECT doc_id, array_to_string(list_transform(p, lambda par, pi: array_to_string(list_transform(par, "
    f"lambda s, si: CASE WHEN pi = fp AND si = 1 THEN {S.s_headline('array_to_string(s, chr(32))', T.DASH)} "
    "ELSE array_to_string(s, ' ') END), ' ')), ' ') AS input, "
    "' ' || array_to_string(list_transform(list_transform((" + S.s_sentences("t") + ")[1:2], "
    "lambda s: string_split(s, ' ')), lambda s: array_to_string(s, ' ')), ' ') AS labels FROM ("
    "SELECT doc_id, t, p, list_position(list_transform(p, lambda par: len(par) > 0), true) AS fp FROM ("
    "SELECT doc_id, t, list_transform(string_split(t, chr(10)), lambda line: "
    f"list_transform({S.s_sentences('line')}, lambda s: string_split(s, ' '))) AS p FROM ({NEWS})))")


@register("prep_indosum", S.chain(_INDOSUM_RAW, ["input", "labels"], S.preset_steps("finetune_nb", False)))
def prep_indosum(spark, sf):
    n = _news(spark, sf).select("doc_id", D.paragraphs(F.col("t")).alias("paragraphs"),
                                D.summary_tokens(F.col("t")).alias("summary"))
    return C.prepare_indosum(n, "doc_id", "paragraphs", "summary")


# --------------------------------------------------------------------------------------------
# K: ROUGE

def _pairs(spark, sf):
    return D.conversation_pairs(D.table(spark, sf, "conversations"))


@register("rouge1", rouge_n_sql(PAIRS_SQL, 1))
def q_rouge1(spark, sf):
    return R.rouge_n(_pairs(spark, sf), 1, "pair_id")


@register("rouge2", rouge_n_sql(PAIRS_SQL, 2))
def q_rouge2(spark, sf):
    return R.rouge_n(_pairs(spark, sf), 2, "pair_id")


@register("rougel", S.rouge_l_sql(PAIRS_SQL, "pred", "gold", ["pair_id"]))
def q_rougel(spark, sf):
    return R.rouge_l(_pairs(spark, sf), "pair_id")


@register("score_pairs",
          f"SELECT p.pair_id, p.conv_id, p.turn, p.pred, p.gold, r1.rouge1, r2.rouge2, rl.rougeL "
          f"FROM ({PAIRS_SQL}) p JOIN ({rouge_n_sql(PAIRS_SQL, 1)}) r1 ON p.pair_id = r1.pair_id "
          f"JOIN ({rouge_n_sql(PAIRS_SQL, 2)}) r2 ON p.pair_id = r2.pair_id "
          f"JOIN ({S.rouge_l_sql(PAIRS_SQL, 'pred', 'gold', ['pair_id'])}) rl ON p.pair_id = rl.pair_id")
def q_score_pairs(spark, sf):
    return R.score_pairs(_pairs(spark, sf), "pair_id", keep=("conv_id", "turn"))
