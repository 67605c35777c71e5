"""Column -> Column text functions: cleaning steps C1-C12, presets, counts (D1c-D3c),
truncation (D-TRUNC), sentence split (H1) and ROUGE tokenisation.

Every function is a native Spark expression except ``fold_ascii`` (C5, Arrow UDF).
All patterns are written so that Java regex (Spark) and RE2 (the DuckDB oracle) read
them the same way: no look-around except in C9, explicit whitespace classes, and
``\\p{..}`` classes for Python's Unicode ``\\w``/``\\d``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fold import fold_ascii

# ---------------------------------------------------------------------------
# These must equal the reference's rules for identical results.
# Markers that drop a whole line (C4), headline delimiters (C6), the link pattern
# (C2, rewritten with portable classes), and the cleaning patterns C7-C10.
LINE_MARKERS = ("•", "baca juga:")
DASH, EN_DASH, COLON = "- ", "– ", ": "
LINK_RE = r"(https?://)?([\p{Nd}a-z.-]+)\.([a-z.]{2,6})([/\p{L}\p{N}_.-]*)"
PARENS_RE = r"(?d)([(|]).*?([)|])"
# Python's \s over ASCII (after C5 only ASCII is left).
WS = r"[ \t\n\x0B\f\r\x1C-\x1F]"
# Python's str.split() / str.isspace() whitespace over all of Unicode.
PY_WS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
PUNCT_RE = r"[^\p{L}\p{N}_." + WS[1:-1] + r"]+"
PUNCT_COMMA_RE = r"[^\p{L}\p{N}_.," + WS[1:-1] + r"]+"
DIGIT_DOT_RE = r"(?<=[0-9#])\.|\.(?=[0-9])"
MASK_TOKEN = "<mask_1>"
EOS_TOKEN = "</s>"
# End of fixed values.
# ---------------------------------------------------------------------------

PRESETS: dict[str, tuple[tuple[str, ...], bool]] = {
    # name: (headline delimiters when is_news, keep commas)
    "module": ((DASH, EN_DASH), False),
    "pretrain_nb": ((DASH, EN_DASH), True),
    "finetune_nb": ((DASH, EN_DASH, COLON), True),
    "demo_nb": ((), False),
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _java_quote(s: str) -> str:
    return "\\Q" + s + "\\E"


# --- C1 .. C12 -------------------------------------------------------------

def lower_text(c) -> Column:                                    # C1
    return F.lower(_col(c))


# Same matches as LINK_RE, faster: a match without the scheme never starts inside a run
# of [\p{Nd}a-z.-] (the run's first character gives a match as well, and it is tried
# first), so that branch may require a run start; with the scheme any start is allowed.
# Matches end where a run ends (the last group's class contains the run class), so the
# look-behind also holds for every search that follows a match.
# A run without a dot is left after one look at it, a text without a dot before two of [a-z.] at once.
LINK_RE_SPARK = r"(?:(https?://)|(?<![\p{Nd}a-z.-]))(?=[\p{Nd}a-z-]*+\.)([\p{Nd}a-z.-]+)\.([a-z.]{2,6})([/\p{L}\p{N}_.-]*)"
PY_WS_CHARS = "".join(chr(i) for i in range(0x3001) if re.fullmatch(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), PY_WS), chr(i)))
ASCII_WS = r"[\t-\r\x1C-\x1F]"  # of these, the ASCII ones beside the space
# The same matches as DIGIT_DOT_RE, with the dot as the first test.
DIGIT_DOT_RE_SPARK = r"\.(?:(?<=[0-9#]\.)|(?=[0-9]))"
# Runs of WS, but for those that are one space already.
WS_RUN_RE = WS + r"{2,}|[\t\n\x0B\f\r\x1C-\x1F]"

# Runs of what PUNCT_RE (PUNCT_COMMA_RE) or WS match, over ASCII; a negated class takes twice as long.
ASCII_RUN_RE = r"[\x00-\x2D/:-@\[-^`{-\x7F]+"
ASCII_RUN_COMMA_RE = r"[\x00-+\x2D/:-@\[-^`{-\x7F]+"


def _where(c, holds, change) -> Column:
    """``change(c)`` for the rows where ``holds(c)``, else ``c``, which is evaluated once, also if it comes from a UDF."""
    return F.transform(F.array(_col(c)), lambda s: F.when(holds(s), change(s)).otherwise(s))[0]


def remove_links(c) -> Column:                                  # C2
    """No link holds a line end: the pattern is run on those lines alone that may have one."""
    with_dot = r"\.[a-z.]{2}"

    def per_line(s: Column) -> Column:
        return F.array_join(F.transform(F.split(s, "\n", -1), lambda line: F.when(
            line.rlike(with_dot), F.regexp_replace(line, LINK_RE_SPARK, "")).otherwise(line)), "\n")

    return _where(c, lambda s: s.rlike(with_dot), per_line)


def unescape_amp(c) -> Column:                                  # C3
    return F.replace(_col(c), F.lit("&amp;"), F.lit("&"))


def drop_marked_lines(c, markers: Sequence[str] = LINE_MARKERS) -> Column:   # C4
    lines = F.split(_col(c), "\n", -1)

    def keep(line: Column) -> Column:
        cond = F.lit(True)
        for m in markers:
            cond = cond & ~line.contains(m)
        return cond

    return F.array_join(F.filter(lines, keep), "\n")


def remove_headline(c, delim: str) -> Column:                   # C6
    """Split on ``delim``; with more than one part drop the first and join the rest with
    one space. Written with a single reference to the input: delete up to and including
    the first delimiter, then turn the remaining delimiters into spaces (no delimiter:
    unchanged). A column referenced several times is evaluated several times when it
    comes from a nondeterministic UDF, so this matters after the fold."""
    first = "(?s)^.*?" + _java_quote(delim)
    return _where(c, lambda s: s.contains(delim),
                  lambda s: F.replace(F.regexp_replace(s, first, ""), F.lit(delim), F.lit(" ")))


def empty_parens(c) -> Column:                                  # C7
    return _where(c, lambda s: s.contains("(") | s.contains("|"), lambda s: F.regexp_replace(s, PARENS_RE, "$1$2"))


def strip_punct(c, keep_commas: bool = False) -> Column:        # C8
    return F.regexp_replace(_col(c), PUNCT_COMMA_RE if keep_commas else PUNCT_RE, " ")


def remove_digit_dots(c) -> Column:                             # C9
    return F.regexp_replace(_col(c), DIGIT_DOT_RE_SPARK, "")


def collapse_ws(c) -> Column:                                   # C10
    return F.trim(F.regexp_replace(_col(c), WS_RUN_RE, " "))


def ascii_punct_to_spaces(c, keep_commas: bool = False) -> Column:   # C8-C10
    """``collapse_ws(remove_digit_dots(strip_punct(c)))`` for ASCII texts, with one pass less: what C8 turns into spaces and
    white space beside it are one run, which becomes one space. C9 takes no dot between two spaces, so it may follow."""
    return F.trim(remove_digit_dots(F.regexp_replace(_col(c), ASCII_RUN_COMMA_RE if keep_commas else ASCII_RUN_RE, " ")))


def drop_short_sentences(c, min_len: int = 11) -> Column:       # C11
    pieces = F.split(_col(c), r"\.", -1)
    return F.array_join(F.filter(pieces, lambda s: F.length(F.trim(s)) >= min_len), ".")


def drop_underscores(c) -> Column:                              # C12
    return F.replace(_col(c), F.lit("_"), F.lit(""))


def clean_text(c, headline_delims: Sequence[str] = (), keep_commas: bool = False,
               markers: Sequence[str] = LINE_MARKERS, min_piece_chars: int = 11) -> Column:
    """C1-C12 in the reference's order. Apply exactly once (not idempotent)."""
    t = drop_marked_lines(unescape_amp(remove_links(lower_text(c))), markers)
    t = fold_ascii(t)
    for d in headline_delims:
        t = remove_headline(t, d)
    t = ascii_punct_to_spaces(empty_parens(t), keep_commas)
    return materialized(drop_underscores(drop_short_sentences(t, min_piece_chars)))


def materialized(c: Column) -> Column:
    """Evaluate ``c`` once per row. Wrapping it in a (trivially true) nondeterministic
    condition stops the optimizer from inlining the expression into pushed-down filters
    or collapsed projections, where an expensive chain would be evaluated again."""
    return F.when(F.spark_partition_id() >= 0, c)


def clean_preset(c, preset: str = "module", is_news: bool = True) -> Column:
    delims, commas = PRESETS[preset]
    return clean_text(c, delims if is_news else (), commas)


# --- D: counts and truncation ------------------------------------------------

def words(c) -> Column:
    """``str.split()``: runs of non-whitespace. Splitting on single spaces, once all
    whitespace is one, and dropping the empty pieces is several times faster in Spark than
    extracting the runs with a negated Unicode class. A text whose only whitespace is the space is split as it is."""
    spaced = _where(c, lambda s: (F.octet_length(s) != F.length(s)) | s.rlike(ASCII_WS), lambda s: F.translate(s, PY_WS_CHARS, " " * len(PY_WS_CHARS)))
    return F.array_remove(F.split(spaced, " ", -1), "")


def word_count(c) -> Column:                                    # D1c: len(x.split())
    return F.size(words(c)).cast("bigint")


def dot_piece_count(c) -> Column:                               # D3c: len(x.split('.'))
    return F.size(F.split(_col(c), "[.]", -1)).cast("bigint")


def truncate_words(c, n: int = 500, mode: str = "ws") -> Column:
    """D-TRUNCa (mode='ws'): only if there are >= n words, keep the first n of
    ``split()`` joined by one space. D-TRUNCb (mode='space'): always keep the first n
    pieces of ``split(' ')`` (empty pieces count)."""
    t = _col(c)
    if mode == "space":
        return F.array_join(F.slice(F.split(t, " ", n + 1), 1, n), " ")
    ws = words(t)
    return F.when(F.size(ws) >= n, F.array_join(F.slice(ws, 1, n), " ")).otherwise(t)


# --- H1: sentences ---------------------------------------------------------------

def split_sentences(c, abbreviations: Sequence[str] = ()) -> Column:
    """Break after '.', '!' or '?' followed by whitespace; the whitespace is dropped,
    terminators stay, blank pieces are removed (empty text -> no sentence).

    Every piece but the last ends with a terminator, and the last one starts at a
    non-blank character, so the only blank pieces are a trailing empty string or a
    text that is blank as a whole: an ``array_remove`` and one check replace a
    per-piece filter.

    ``abbreviations`` (e.g. ``("mr", "dr", "e.g")``, case-insensitive, without the final
    dot) are not sentence ends: their dot is hidden before the split and restored."""
    t = _col(c)
    if abbreviations:
        alts = "|".join(re.escape(a) for a in abbreviations)
        t = F.regexp_replace(t, r"(?i)(?<![\p{L}\p{N}_])(" + alts + r")\.(?=" + PY_WS + ")", "$1\u0002")
    marked = F.regexp_replace(F.when(t.rlike("^" + PY_WS + "*$"), F.lit("")).otherwise(t),
                              "([.!?])" + PY_WS + "+", "$1\u0001")
    pieces = F.array_remove(F.split(marked, "\u0001", -1), "")
    if abbreviations:
        pieces = F.transform(pieces, lambda p: F.replace(p, F.lit("\u0002"), F.lit(".")))
    return pieces


def sentence_count(c) -> Column:                                # D2c
    return F.size(split_sentences(c)).cast("bigint")


# --- ROUGE tokenisation ---------------------------------------------------------

# (regexp_extract_all is several times faster than regexp_replace in Spark 4.1, so the
# token functions extract runs instead of replacing separators.)

def rouge_tokens(c) -> Column:
    """Scorer tokens: lowercase, then runs of [a-z0-9]."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), 0)


def gsg_tokens(c) -> Column:
    """GSG scoring tokens: runs of [a-zA-Z0-9] (anything else separates), lowercased.
    The runs are ASCII, so they are lowercased joined and split again on the space."""
    runs = F.regexp_extract_all(_col(c), F.lit("[a-zA-Z0-9]+"), 0)
    return F.array_remove(F.split(F.lower(F.array_join(runs, " ")), " ", -1), "")


# --- D6c / D5c -----------------------------------------------------------------------

def preview(c, n: int = 50) -> Column:
    return F.substring(_col(c), 1, n)


def prefix_space(c) -> Column:
    return F.concat(F.lit(" "), _col(c))
