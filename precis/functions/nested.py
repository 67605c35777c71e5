"""Nested-array column functions (E1-E4), all native higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DASH, remove_headline


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keep_lines_by_lang(text, line_ids, lang: str) -> Column:
    """Keep the lines whose aligned language entry is not NULL and has ``label ==
    lang``; rejoin with newlines. A shorter label list pads with NULL (line dropped)."""
    lines = F.split(_col(text), "\n", -1)
    z = F.arrays_zip(lines.alias("line"), _col(line_ids).alias("li"))
    kept = F.filter(z, lambda e: F.coalesce(e["line"].isNotNull() & (e["li"]["label"] == F.lit(lang)), F.lit(False)))
    return F.array_join(F.transform(kept, lambda e: e["line"]), "\n")


def join_sentence(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def flatten_paragraphs(paragraphs, first_headline_delim: str | None = DASH) -> Column:
    """E1 (+E2): tokens -> sentence, sentences -> paragraph, paragraphs -> article, all
    joined by one space. With a delimiter, the document's first sentence (the first
    sentence of the first non-empty paragraph) has its headline removed."""
    p = _col(paragraphs)
    plain = F.array_join(F.transform(p, lambda par: F.array_join(F.transform(par, join_sentence), " ")), " ")
    if first_headline_delim is None:
        return plain
    # No lambda may reference an outer column here (Spark then cannot extract a Python
    # UDF applied to the result), so the first sentence is spliced by position: the
    # k leading empty paragraphs contribute k spaces, then the first sentence follows.
    first_par = F.array_position(F.transform(p, lambda par: F.size(par) > 0), True)
    k = (first_par - 1).cast("int")
    first = join_sentence(F.element_at(F.flatten(p), 1))
    spliced = F.concat(F.substring(plain, F.lit(1), k), remove_headline(first, first_headline_delim),
                       F.substring(plain, F.lit(1) + k + F.length(first), F.lit(2 ** 31 - 1)))
    return F.when(first_par > 0, spliced).otherwise(plain)


def flatten_summary(summary) -> Column:
    """Sentences of tokens -> one string."""
    return F.array_join(F.transform(_col(summary), join_sentence), " ")
