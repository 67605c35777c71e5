"""Query of the benchmark decontamination, with its SQL."""

from .common import table
from .decontaminate import LEAST, NOT_WORD, contamination
from .registry import register

_PATTERN = NOT_WORD.replace("\\x00", "\\x01")  # DuckDB's texts hold no NUL
_WORDS = f"list_filter(string_split_regex(lower(coalesce(text, '')), '{_PATTERN}'), lambda x: x <> '')"
# Without seeds: all equal words of a text and an item, way by way to lay one beside the other (shift). Of matches i to j of
# a way, in order, j - i + 1 count for and the other places between them against a stretch.
SQL = f"""
WITH d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p
           FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
i AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS q FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
pairs AS (SELECT doc_id, item_id, p - q AS shift, p, count(*) OVER (PARTITION BY doc_id, item_id, p - q) AS n
          FROM d JOIN i USING (word)),
ranked AS (SELECT doc_id, item_id, shift, p, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS j
           FROM pairs WHERE n >= {LEAST}),
stretches AS (SELECT doc_id, item_id, 2 * j - p + 1
                - min(2 * j - p) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS score FROM ranked),
scored AS (SELECT doc_id, item_id, max(score) AS overlap FROM stretches GROUP BY ALL),
best AS (SELECT doc_id, arg_min(item_id, (-overlap, item_id)) AS item_id, max(overlap) AS overlap, count(*) AS n_items
         FROM scored WHERE overlap >= {LEAST} GROUP BY doc_id)
SELECT doc_id, best.overlap IS NOT NULL AS contaminated, item_id, coalesce(overlap, 0)::INT AS overlap,
       coalesce(n_items, 0)::BIGINT AS n_items
FROM documents LEFT JOIN best USING (doc_id)
"""


@register("op6_decontaminate", SQL)
def op6_decontaminate(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
