"""Corpus adapters L1-L6: each is one lazy composition of the operators.

Native filters that can reach the Parquet scan (``text IS NOT NULL``, split and
language selections) are applied before the fold UDF, which is nondeterministic on
purpose (see ``functions/fold.py``) and therefore a barrier for later filters.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import nested as N
from ..functions import text as T
from ..operators import filters as FL
from ..operators.gsg import gap_sentences
from ..options import DEFAULT, Options


def prepare_ccnews(docs: DataFrame, opts: Options = DEFAULT, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """L1: not-null -> pretrain preset (news) -> exact dedup -> word and sentence counts
    -> length filter. Output (doc_id, text)."""
    cleaned = FL.not_null(docs, text_col).select(
        id_col, T.clean_preset(F.col(text_col), "pretrain_nb", True).alias("text"))
    deduped = FL.dedup_text(cleaned, "text", id_col)
    counted = FL.with_counts(deduped, "text", sentences="tokenizer")
    return FL.filter_length(counted, opts.max_words, opts.min_sentences).select(id_col, "text")


def prepare_news2017(pages: DataFrame, html_col: str = "content_html", id_col: str = "page_id",
                     opts: Options = DEFAULT) -> DataFrame:
    """L2: pretrain preset without headline removal on raw HTML (not stripped, as in
    the reference) -> counts with dot pieces -> length filter. No dedup."""
    cleaned = pages.select(id_col, T.clean_preset(F.col(html_col), "pretrain_nb", False).alias("text"))
    counted = FL.with_counts(cleaned, "text", sentences="dots")
    return FL.filter_length(counted, opts.max_words, opts.min_sentences).select(id_col, "text")


def clean_oscar(docs: DataFrame, line_ids_col: str, lang: str = "id", id_col: str = "doc_id",
                text_col: str = "text", opts: Options = DEFAULT) -> DataFrame:
    """L3 first half: keep lines in the target language -> module preset -> truncate to
    ``max_words`` words when longer."""
    kept = N.keep_lines_by_lang(F.col(text_col), F.col(line_ids_col), lang)
    # truncation reads the cleaned column (its own projection: the cleaned text is
    # evaluated once even though truncation refers to it more than once)
    cleaned = docs.select(id_col, T.clean_preset(kept, "module", True).alias("text"))
    return cleaned.select(id_col, T.truncate_words(F.col("text"), opts.max_words, "ws").alias("text"))


def prepare_oscar(docs: DataFrame, line_ids_col: str, lang: str = "id", id_col: str = "doc_id",
                  text_col: str = "text", opts: Options = DEFAULT, min_words: int = 0) -> DataFrame:
    """L3: clean_oscar -> gap sentences -> drop the 'SKIP' sentinel (and, optionally,
    documents shorter than ``min_words``). Output (doc_id, input, labels)."""
    cleaned = clean_oscar(docs, line_ids_col, lang, id_col, text_col, opts)
    if min_words > 0:
        cleaned = cleaned.where(T.word_count("text") >= min_words)
    pairs = gap_sentences(cleaned, opts, id_col=id_col, text_col="text")
    return pairs.where(F.col("input") != "SKIP").select(id_col, "input", "labels")


def prepare_xlsum(df: DataFrame, id_col: str = "id", text_col: str = "text", summary_col: str = "summary",
                  opts: Options = DEFAULT) -> DataFrame:
    """L4: module preset on text and summary, then the first ``max_words`` pieces of
    ``split(' ')``."""
    cleaned = df.select(id_col, T.clean_preset(F.col(text_col), "module", True).alias("input"),
                        T.clean_preset(F.col(summary_col), "module", True).alias("labels"))
    return cleaned.select(id_col, T.truncate_words(F.col("input"), opts.max_words, "space").alias("input"),
                          T.truncate_words(F.col("labels"), opts.max_words, "space").alias("labels"))


def select_splits(df: DataFrame, splits: Iterable[str] | None, split_col: str = "split") -> DataFrame:
    """A5: keep the chosen splits (a partition filter when ``split`` partitions the data)."""
    return df if splits is None else df.where(F.col(split_col).isin(list(splits)))


def prepare_liputan6(df: DataFrame, id_col: str = "id", article_col: str = "clean_article",
                     summary_col: str = "clean_summary", splits: Iterable[str] | None = None) -> DataFrame:
    """Finetune preset (news) on article and summary; labels get a leading space."""
    df = select_splits(df, splits)
    return df.select(
        id_col,
        T.clean_preset(F.col(article_col), "finetune_nb", True).alias("input"),
        T.prefix_space(T.clean_preset(F.col(summary_col), "finetune_nb", True)).alias("labels"),
    )


def prepare_indosum(df: DataFrame, id_col: str = "id", paragraphs_col: str = "paragraphs",
                    summary_col: str = "summary", splits: Iterable[str] | None = None) -> DataFrame:
    """Nested paragraphs joined with headline removal on the first sentence; summary
    joined with a leading space; finetune preset without headline removal on both."""
    df = select_splits(df, splits)
    article = N.flatten_paragraphs(F.col(paragraphs_col), T.DASH)
    summary = T.prefix_space(N.flatten_summary(F.col(summary_col)))
    return df.select(
        id_col,
        T.clean_preset(article, "finetune_nb", False).alias("input"),
        T.clean_preset(summary, "finetune_nb", False).alias("labels"),
    )


def pretrain_records(docs: DataFrame, line_ids_col: str, vocab: DataFrame, lang: str = "id",
                     id_col: str = "doc_id", text_col: str = "text", opts: Options = DEFAULT,
                     mode: str = "contiguous", model: str = "word") -> DataFrame:
    """Crawl corpus -> L3 pairs -> encoded fixed-width ids (``model``: the vocabulary's, word, unigram or
    bpe) -> shard ids (in id order; ``mode`` contiguous or strided). Write with ``sinks.write_shards``."""
    pairs = prepare_oscar(docs, line_ids_col, lang, id_col, text_col, opts)
    return pair_records(pairs, vocab, id_col, opts, mode, model)


def pair_records(pairs: DataFrame, vocab: DataFrame, id_col: str = "id", opts: Options = DEFAULT, mode: str = "strided",
                 model: str = "word") -> DataFrame:
    """Pairs (id, input, labels) -> encoded fixed-width ids -> shard ids. Write with ``sinks.write_mode_shards``."""
    from ..operators.encode import encode
    from ..operators.order import assign_shards
    enc = encode(pairs, vocab, {"input": opts.model_max_length, "labels": opts.max_summary_length}, model,
                 id_col, "input")
    enc = enc.select(id_col, F.col("input_ids"), "attention_mask", F.col("labels_ids").alias("labels"))
    return assign_shards(enc, id_col, opts.rows_per_shard, mode)
