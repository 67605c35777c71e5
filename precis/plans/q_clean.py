"""Registered queries: sources, cleaning steps and presets, counts, truncation, nested
arrays, filters, dedup and the corpus adapters L1-L6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import nested as N
from ..functions import text as T
from ..operators import filters as FL
from ..operators.gsg import gap_sentences
from ..sources import readers as RD
from . import corpora as C
from . import derived as D
from . import sql as S
from .registry import register

DOCS = "SELECT doc_id, text AS t FROM documents"
NEWS = f"SELECT doc_id, {S.s_news_raw()} AS t FROM documents"
PAGES = "SELECT page_id, html AS t FROM pages"


def _docs(spark, sf):
    return D.table(spark, sf, "documents")


def _news(spark, sf):
    return _docs(spark, sf).select("doc_id", D.news_raw().alias("t"))


def _pages(spark, sf):
    return D.table(spark, sf, "pages").select("page_id", F.col("html").alias("t"))


# --- A1 / F1 ---------------------------------------------------------------------------

@register("scan_filter_null", "SELECT doc_id, lang, source, n_chars FROM documents WHERE text IS NOT NULL")
def scan_filter_null(spark, sf):
    return FL.not_null(_docs(spark, sf)).select("doc_id", "lang", "source", "n_chars")


@register("read_ids", "SELECT md5(text) || '-' || (row_number() OVER (PARTITION BY text ORDER BY doc_id) - 1) AS doc_id, text "
          "FROM documents WHERE text IS NOT NULL")
def read_ids(spark, sf):
    """A2: the scan with ids that follow from the texts."""
    return RD.read_docs(spark, f"{sf}/documents.parquet")


@register("read_splits", "SELECT 'train' AS split, text FROM documents UNION ALL SELECT 'test', text FROM benchmark")
def read_splits(spark, sf):
    """A3 and A5: files by split, of which two are chosen."""
    files = {"train": [f"{sf}/documents.parquet"], "test": [f"{sf}/benchmark.parquet"], "other": [f"{sf}/conversations.parquet"]}
    return C.select_splits(RD.read_splits(spark, files, fmt="parquet"), ("train", "test")).select("split", "text")


@register("columns_to_rows", "SELECT doc_id, unnest(l) AS line, unnest(list_transform(l, lambda x: length(x)))::INTEGER AS size "
          "FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)")
def columns_to_rows(spark, sf):
    """Lists of equal length, a document's lines and their sizes, as rows."""
    line = F.split("text", "\n", -1)
    lists = _docs(spark, sf).where("text IS NOT NULL").select("doc_id", line.alias("line"), F.transform(line, F.length).alias("size"))
    return RD.columns_to_rows(lists, ["line", "size"], keep=["doc_id"])


# --- C1 .. C12 one at a time -------------------------------------------------------------

@register("clean_lower", S.chain(DOCS, "t", [S.s_lower]))
def clean_lower(spark, sf):
    return _docs(spark, sf).select("doc_id", T.lower_text("text").alias("t"))


@register("clean_links", S.chain(PAGES, "t", [S.s_lower, S.s_links]))
def clean_links(spark, sf):
    return _pages(spark, sf).select("page_id", T.remove_links(T.lower_text("t")).alias("t"))


@register("clean_amp", S.chain(NEWS, "t", [S.s_amp]))
def clean_amp(spark, sf):
    return _news(spark, sf).select("doc_id", T.unescape_amp("t").alias("t"))


@register("clean_bullets", S.chain(NEWS, "t", [S.s_lower, S.s_bullets]))
def clean_bullets(spark, sf):
    return _news(spark, sf).select("doc_id", T.drop_marked_lines(T.lower_text("t")).alias("t"))


@register("clean_fold", S.chain(DOCS, "t", [S.s_fold]))
def clean_fold(spark, sf):
    return _docs(spark, sf).select("doc_id", T.fold_ascii(F.col("text")).alias("t"))


@register("clean_headline", S.chain(NEWS, "t", [lambda c: S.s_headline(c, T.DASH)]))
def clean_headline(spark, sf):
    return _news(spark, sf).select("doc_id", T.remove_headline("t", T.DASH).alias("t"))


@register("clean_parens", S.chain(PAGES, "t", [S.s_parens]))
def clean_parens(spark, sf):
    return _pages(spark, sf).select("page_id", T.empty_parens("t").alias("t"))


@register("clean_punct",
          f"SELECT doc_id, {S.s_punct('t', False)} AS t_drop, {S.s_punct('t', True)} AS t_keep "
          f"FROM ({S.chain(DOCS, 't', [S.s_fold])})")
def clean_punct(spark, sf):
    folded = _docs(spark, sf).select("doc_id", T.fold_ascii(F.col("text")).alias("t"))
    return folded.select("doc_id", T.strip_punct("t", False).alias("t_drop"), T.strip_punct("t", True).alias("t_keep"))


@register("clean_numdot", S.chain(PAGES, "t", [S.s_numdot]))
def clean_numdot(spark, sf):
    return _pages(spark, sf).select("page_id", T.remove_digit_dots("t").alias("t"))


@register("clean_ws", S.chain(DOCS, "t", [S.s_ws]))
def clean_ws(spark, sf):
    return _docs(spark, sf).select("doc_id", T.collapse_ws("text").alias("t"))


@register("clean_short", S.chain(DOCS, "t", [S.s_ws, S.s_short]))
def clean_short(spark, sf):
    return _docs(spark, sf).select("doc_id", T.drop_short_sentences(T.collapse_ws("text")).alias("t"))


@register("clean_underscore", S.chain(NEWS, "t", [S.s_underscore]))
def clean_underscore(spark, sf):
    return _news(spark, sf).select("doc_id", T.drop_underscores("t").alias("t"))


# --- presets -------------------------------------------------------------------------------

def _preset_query(name, preset, is_news, source, src_sql, key):
    @register(name, S.chain(src_sql, "t", S.preset_steps(preset, is_news)))
    def q(spark, sf):
        return source(spark, sf).select(key, T.clean_preset(F.col("t"), preset, is_news).alias("t"))
    return q


_preset_query("clean_module", "module", True, _news, NEWS, "doc_id")
_preset_query("clean_pretrain", "pretrain_nb", True, _news, NEWS, "doc_id")
_preset_query("clean_finetune", "finetune_nb", True, _news, NEWS, "doc_id")
_preset_query("clean_demo", "demo_nb", False, _news, NEWS, "doc_id")
_preset_query("clean_pages", "pretrain_nb", False, _pages, PAGES, "page_id")


# --- D: counts and truncation ------------------------------------------------------------------

@register("word_count", f"SELECT doc_id, {S.s_word_count('text')} AS n_words FROM documents")
def word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", T.word_count("text").alias("n_words"))


@register("sent_count", f"SELECT doc_id, len({S.s_sentences('text')}) AS n_sents FROM documents")
def sent_count(spark, sf):
    return _docs(spark, sf).select("doc_id", T.sentence_count("text").alias("n_sents"))


@register("dot_count", f"SELECT doc_id, {S.s_dot_count('text')} AS n_dots FROM documents")
def dot_count(spark, sf):
    return _docs(spark, sf).select("doc_id", T.dot_piece_count("text").alias("n_dots"))


@register("trunc_oscar", f"SELECT doc_id, {S.s_trunc_ws('text')} AS t FROM documents")
def trunc_oscar(spark, sf):
    return _docs(spark, sf).select("doc_id", T.truncate_words("text", 500, "ws").alias("t"))


@register("trunc_xlsum", f"SELECT doc_id, {S.s_trunc_space('text')} AS t FROM documents")
def trunc_xlsum(spark, sf):
    return _docs(spark, sf).select("doc_id", T.truncate_words("text", 500, "space").alias("t"))


@register("text_preview", "SELECT doc_id, substring(text, 1, 50) AS t50, ' ' || lang AS lang_sp FROM documents")
def text_preview(spark, sf):
    return _docs(spark, sf).select("doc_id", T.preview("text", 50).alias("t50"), T.prefix_space("lang").alias("lang_sp"))


# --- E: nested arrays ---------------------------------------------------------------------------

_LINE_LANG_SQL = (
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), "
    "lambda l, i: CASE WHEN (doc_id + i - 1) % 7 = 0 THEN NULL WHEN (doc_id + i - 1) % 5 = 0 THEN NULL "
    "WHEN lang = 'en' THEN l ELSE NULL END), lambda x: x IS NOT NULL), chr(10)) AS t FROM documents")


@register("line_lang", _LINE_LANG_SQL)
def line_lang(spark, sf):
    d = _docs(spark, sf)
    ids = D.line_ids(F.col("doc_id"), F.col("text"), F.col("lang"))
    return d.select("doc_id", N.keep_lines_by_lang(F.col("text"), ids, "en").alias("t"))


def _s_paragraphs(c):
    return (f"list_transform(string_split({c}, chr(10)), lambda line: "
            f"list_transform({S.s_sentences('line')}, lambda s: string_split(s, ' ')))")


_NESTED_ARTICLE_SQL = (
    "SELECT doc_id, array_to_string(list_transform(p, lambda par, pi: array_to_string(list_transform(par, "
    f"lambda s, si: CASE WHEN pi = fp AND si = 1 THEN {S.s_headline('array_to_string(s, chr(32))', T.DASH)} "
    "ELSE array_to_string(s, ' ') END), ' ')), ' ') AS article FROM ("
    "SELECT doc_id, p, list_position(list_transform(p, lambda par: len(par) > 0), true) AS fp FROM ("
    f"SELECT doc_id, {_s_paragraphs('t')} AS p FROM ({NEWS})))")


@register("nested_article", _NESTED_ARTICLE_SQL)
def nested_article(spark, sf):
    return _news(spark, sf).select("doc_id", N.flatten_paragraphs(D.paragraphs(F.col("t")), T.DASH).alias("article"))


_NESTED_SUMMARY_SQL = (
    "SELECT doc_id, ' ' || array_to_string(list_transform(list_transform((" + S.s_sentences("t") + ")[1:2], "
    "lambda s: string_split(s, ' ')), lambda s: array_to_string(s, ' ')), ' ') AS summary FROM (" + NEWS + ")")


@register("nested_summary", _NESTED_SUMMARY_SQL)
def nested_summary(spark, sf):
    return _news(spark, sf).select(
        "doc_id", T.prefix_space(N.flatten_summary(D.summary_tokens(F.col("t")))).alias("summary"))


# --- F / G0: filters, dedup, counts -------------------------------------------------------------

_MODULE_DOCS = S.chain(DOCS, "t", S.preset_steps("module", True))
_PRETRAIN_NEWS = S.chain(NEWS, "t", S.preset_steps("pretrain_nb", True))


@register("dedup_text", f"SELECT min(doc_id) AS doc_id, t, count(*) AS n_copies FROM ({_MODULE_DOCS}) GROUP BY t")
def dedup_text(spark, sf):
    cleaned = _docs(spark, sf).select("doc_id", T.clean_preset(F.col("text"), "module").alias("t"))
    return FL.dedup_text(cleaned, "t", "doc_id", "n_copies").select("doc_id", "t", "n_copies")


@register("len_filter",
          f"SELECT doc_id, t, n_words, n_sents FROM (SELECT doc_id, t, {S.s_word_count('t')} AS n_words, "
          f"len({S.s_sentences('t')}) AS n_sents FROM ({_PRETRAIN_NEWS})) WHERE n_words <= 500 AND n_sents > 2")
def len_filter(spark, sf):
    cleaned = _news(spark, sf).select("doc_id", T.clean_preset(F.col("t"), "pretrain_nb").alias("t"))
    return FL.filter_length(FL.with_counts(cleaned, "t"), 500, 3).select("doc_id", "t", "n_words", "n_sents")


@register("cond_count",
          f"SELECT lang, count(*) AS n_docs, count_if(n_words <= 500) AS n_short, "
          f"count_if(n_sents < 3) AS n_few_sents FROM (SELECT d.lang, {S.s_word_count('c.t')} AS n_words, "
          f"len({S.s_sentences('c.t')}) AS n_sents FROM ({_PRETRAIN_NEWS}) c JOIN documents d USING (doc_id)) GROUP BY lang")
def cond_count(spark, sf):
    d = _docs(spark, sf)
    cleaned = d.select("doc_id", "lang", T.clean_preset(D.news_raw(), "pretrain_nb").alias("t"))
    counted = FL.with_counts(cleaned, "t")
    return counted.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"),
                                       F.count_if(F.col("n_words") <= 500).alias("n_short"),
                                       F.count_if(F.col("n_sents") < 3).alias("n_few_sents"))


# --- L1-L6 corpus adapters ------------------------------------------------------------------------

@register("prep_ccnews",
          f"SELECT doc_id, t AS text FROM (SELECT doc_id, t, {S.s_word_count('t')} AS n_words, "
          f"len({S.s_sentences('t')}) AS n_sents FROM (SELECT min(doc_id) AS doc_id, t FROM ({_PRETRAIN_NEWS}) GROUP BY t)) "
          f"WHERE n_words <= 500 AND n_sents > 2")
def prep_ccnews(spark, sf):
    from .corpora import prepare_ccnews
    return prepare_ccnews(_news(spark, sf).withColumnRenamed("t", "text"))


_PAGES_PRETRAIN = S.chain(PAGES, "t", S.preset_steps("pretrain_nb", False))


@register("prep_news2017",
          f"SELECT page_id, t AS text FROM (SELECT page_id, t, {S.s_word_count('t')} AS n_words, "
          f"{S.s_dot_count('t')} AS n_sents FROM ({_PAGES_PRETRAIN})) WHERE n_words <= 500 AND n_sents > 2")
def prep_news2017(spark, sf):
    from .corpora import prepare_news2017
    return prepare_news2017(D.table(spark, sf, "pages"), "html", "page_id")
