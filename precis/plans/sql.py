"""DuckDB SQL twins of the column functions and derived inputs (oracle side).

Each function takes a SQL expression string and returns one. Multi-step cleaning is
emitted as a chain of ``SELECT * REPLACE`` sub-queries so that no step repeats the
text of the previous ones.
"""

from __future__ import annotations

from ..functions import text as T

# RE2 cannot do look-around: C9 is two passes (equal to the look-around form).
_NUMDOT_1 = r"([0-9#])\."
_NUMDOT_2 = r"\.([0-9])"
PY_WS = T.PY_WS
WS = T.WS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def s_lower(c): return f"lower({c})"
def s_links(c): return f"regexp_replace({c}, {q(T.LINK_RE)}, '', 'g')"
def s_amp(c): return f"replace({c}, '&amp;', '&')"


def s_bullets(c, markers=T.LINE_MARKERS):
    cond = " AND ".join(f"NOT contains(l, {q(m)})" for m in markers) or "true"
    return f"array_to_string(list_filter(string_split({c}, chr(10)), lambda l: {cond}), chr(10))"


def s_fold(c): return f"regexp_replace(strip_accents({c}), '[^\\x00-\\x7F]', '', 'g')"


def s_headline(c, d):
    return (f"CASE WHEN len(string_split({c}, {q(d)})) > 1 "
            f"THEN array_to_string(string_split({c}, {q(d)})[2:], ' ') ELSE {c} END")


def s_parens(c): return f"regexp_replace({c}, {q('([(|]).*?([)|])')}, '\\1\\2', 'g')"


def s_punct(c, keep_commas=False):
    return f"regexp_replace({c}, {q(T.PUNCT_COMMA_RE if keep_commas else T.PUNCT_RE)}, ' ', 'g')"


def s_numdot(c):
    return f"regexp_replace(regexp_replace({c}, {q(_NUMDOT_1)}, '\\1', 'g'), {q(_NUMDOT_2)}, '\\1', 'g')"


def s_ws(c): return f"trim(regexp_replace({c}, {q(WS + '+')}, ' ', 'g'))"


def s_short(c, min_len=11):
    return f"array_to_string(list_filter(string_split({c}, '.'), lambda x: length(trim(x)) >= {min_len}), '.')"


def s_underscore(c): return f"replace({c}, '_', '')"


def clean_steps(delims=(), keep_commas=False):
    steps = [s_lower, s_links, s_amp, s_bullets, s_fold]
    steps += [(lambda c, d=d: s_headline(c, d)) for d in delims]
    steps += [s_parens, (lambda c: s_punct(c, keep_commas)), s_numdot, s_ws, s_short, s_underscore]
    return steps


def preset_steps(preset="module", is_news=True):
    delims, commas = T.PRESETS[preset]
    return clean_steps(delims if is_news else (), commas)


def chain(source_sql: str, cols, steps) -> str:
    """Apply ``steps`` in order to every column in ``cols`` of ``source_sql``."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    sql = source_sql
    for st in steps:
        repl = ", ".join(f"{st(c)} AS {c}" for c in cols)
        sql = f"SELECT * REPLACE ({repl}) FROM ({sql})"
    return sql


def s_word_count(c): return f"len(regexp_extract_all({c}, {q('[^' + PY_WS[1:-1] + ']+')}))"
def s_dot_count(c): return f"len(string_split({c}, '.'))"


def s_sentences(c):
    return (f"list_filter(string_split(regexp_replace({c}, {q('([.!?])' + PY_WS + '+')}, '\\1' || chr(1), 'g'), chr(1)), "
            f"lambda x: NOT regexp_full_match(x, {q(PY_WS + '*')}))")


def s_trunc_ws(c, n=500):
    words = f"regexp_extract_all({c}, {q('[^' + PY_WS[1:-1] + ']+')})"
    return f"CASE WHEN len({words}) >= {n} THEN array_to_string({words}[1:{n}], ' ') ELSE {c} END"


def s_trunc_space(c, n=500):
    return f"array_to_string(string_split({c}, ' ')[1:{n}], ' ')"


def s_rouge_tokens(c): return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


def s_gsg_tokens(c):
    return f"regexp_extract_all(lower(regexp_replace({c}, '[^a-zA-Z0-9]+', ' ', 'g')), '[a-z0-9]+')"


def s_bigrams(toks):
    return f"list_transform(range(1, len({toks})), lambda i: {toks}[i] || ' ' || {toks}[i + 1])"


def s_news_raw(d="doc_id", t="text", l="lang", s="source"):
    return (f"upper({s}) || ' &amp; ' || {l} || ' - ' || {t} || chr(10) || 'baca juga: ' || {s} "
            f"|| chr(10) || '• poin ' || {l} || chr(10) || 'kata_kunci ' || {s} || ' http://www.example.com/' "
            f"|| {l} || '/' || CAST({d} AS VARCHAR) || ' (' || {l} || ') selesai dengan baik sekali.'")


def s_summary_of(c): return f"array_to_string(({s_sentences(c)})[1:2], ' ')"
def s_article_of(c): return f"array_to_string(({s_sentences(c)})[3:], ' ')"


def s_md5_index(key_sql: str, seed: int) -> str:
    return f"md5(CAST({key_sql} AS VARCHAR) || '|{seed}')"


def s_lcs(longer: str, shorter: str) -> str:
    """LCS length of two token-list columns (``longer`` at least as long as ``shorter``):
    dynamic programme with rows over the longer list and columns over the shorter one."""
    return (f"list_reduce({longer}, lambda row, x: list_reduce(range(1, len({shorter}) + 1), lambda nr, j: "
            f"list_append(nr, greatest(nr[j], row[j + 1], CASE WHEN {shorter}[j] = x THEN row[j] + 1 ELSE 0 END)), "
            f"[0]::BIGINT[]), list_transform(range(len({shorter}) + 1), lambda z: 0::BIGINT))[-1]")


def rouge_l_sql(source_sql: str, pred: str, gold: str, keep: list[str], name: str = "rougeL") -> str:
    """SELECT keep..., rougeL FROM source: tokens and the longer/shorter lists are
    computed once per row in sub-queries."""
    ks = ", ".join(keep)
    toks = f"SELECT {ks}, {s_rouge_tokens(pred)} AS _ta, {s_rouge_tokens(gold)} AS _tb FROM ({source_sql})"
    ordered = (f"SELECT {ks}, len(_ta) + len(_tb) AS _n, CASE WHEN len(_ta) >= len(_tb) THEN _ta ELSE _tb END AS _lo, "
               f"CASE WHEN len(_ta) >= len(_tb) THEN _tb ELSE _ta END AS _sh FROM ({toks})")
    return (f"SELECT {ks}, CASE WHEN _n > 0 THEN 2.0::DOUBLE * CAST({s_lcs('_lo', '_sh')} AS DOUBLE) / CAST(_n AS DOUBLE) "
            f"ELSE 0.0::DOUBLE END AS {name} FROM ({ordered})")
