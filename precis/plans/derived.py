"""Inputs derived from the driver tables, for corpora the tables do not contain
(SURVEY 7.3). Each derivation has an exact SQL twin in ``oracle.py``.

- ``news_raw``: a news-like text. The documents carry no dateline, bullets, "read
  also" lines, ``&amp;``, underscores or links, so a deterministic frame adds them.
- ``article_summary``: first two sentences as the summary, the rest as the article.
- ``line_ids``: per-line language labels (NULL / 'xx' / the document language).
- ``paragraphs`` / ``summary_tokens``: nested paragraph -> sentence -> token arrays.
- ``conversation_pairs``: a user turn and the assistant turn that follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_sentences

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def news_raw(c_doc_id="doc_id", c_text="text", c_lang="lang", c_source="source") -> Column:
    d, t, l, s = (F.col(x) for x in (c_doc_id, c_text, c_lang, c_source))
    return F.concat(
        F.upper(s), F.lit(" &amp; "), l, F.lit(" - "), t,
        F.lit("\nbaca juga: "), s,
        F.lit("\n• poin "), l,
        F.lit("\nkata_kunci "), s, F.lit(" http://www.example.com/"), l, F.lit("/"), d.cast("string"),
        F.lit(" ("), l, F.lit(") selesai dengan baik sekali."),
    )


def summary_of(c: Column) -> Column:
    return F.array_join(F.slice(split_sentences(c), 1, 2), " ")


def article_of(c: Column) -> Column:
    s = split_sentences(c)
    return F.array_join(F.slice(s, 3, F.greatest(F.size(s) - 2, F.lit(0))), " ")


def line_ids(doc_id: Column, text: Column, lang: Column) -> Column:
    """array<struct<label:string>> aligned with split(text, '\\n'): NULL when
    (doc_id + i) % 7 = 0, 'xx' when (doc_id + i) % 5 = 0, else the document language."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    z = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("i"), F.array_repeat(doc_id, n).alias("d"),
                     F.array_repeat(lang, n).alias("l"))

    def label(e):
        pos = e["d"] + e["i"]
        return (F.when(F.pmod(pos, F.lit(7)) == 0, F.lit(None).cast("struct<label:string>"))
                 .when(F.pmod(pos, F.lit(5)) == 0, F.struct(F.lit("xx").alias("label")))
                 .otherwise(F.struct(e["l"].alias("label"))))
    return F.transform(z, label)


def paragraphs(text: Column) -> Column:
    """array<array<array<string>>>: lines -> sentences -> space tokens."""
    return F.transform(F.split(text, "\n", -1),
                       lambda line: F.transform(split_sentences(line), lambda s: F.split(s, " ", -1)))


def summary_tokens(text: Column) -> Column:
    """array<array<string>>: the first two sentences, split on spaces."""
    return F.transform(F.slice(split_sentences(text), 1, 2), lambda s: F.split(s, " ", -1))


def conversation_pairs(conv: DataFrame) -> DataFrame:
    """(pair_id 'conv:turn', conv_id, turn, pred, gold): each user turn with the next assistant turn.
    An equi-join on (conv_id, turn) -- a long conversation does not form one group."""
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("pred"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return (u.join(a, ["conv_id", "turn"])
             .select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair_id"),
                     "conv_id", "turn", "pred", "gold"))
