"""Registered queries: vocabulary statistics and models, encoding and decoding
(J1-J7). The vocabulary corpus is the module-cleaned ``documents`` text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage
from ..operators import encode as E
from ..operators import vocab as V
from ..operators.gsg import gap_sentences
from ..options import DEFAULT
from . import sql as S
from .q_clean import DOCS, _docs
from .q_gsg import gsg_pairs_sql, rouge_n_sql
from .registry import ORACLE, register

VOCAB = 2000          # word vocabulary size for the checks (the reference default is 16,000)
WIDTH = 64            # encoded input width
LABEL_WIDTH = 32      # encoded label width
SUB_VOCAB = 400       # subword vocabulary size for the checks
BPE_VOCAB = 140       # characters and some 100 merges: the SQL takes one at a time
SUB_WIDTH, SUB_LABELS = DEFAULT.model_max_length, DEFAULT.max_summary_length

_CORPUS_SQL = S.chain(DOCS, "t", S.preset_steps("module", False))
_WORDS = "'[^" + T.PY_WS[1:-1] + "]+'"


def _corpus(spark, sf):
    return _docs(spark, sf).select("doc_id", T.clean_preset(F.col("text"), "module", False).alias("text"))


def _corpus_saved(spark, sf):
    """The cleaned corpus feeds both the vocabulary and the encoder: write it once to the
    shared checkpoint folder (as a pipeline writes its cleaned table) instead of
    cleaning twice."""
    return cut_lineage(_corpus(spark, sf))


_COUNTS_SQL = f"SELECT w AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(t, {_WORDS})) AS w FROM ({_CORPUS_SQL})) GROUP BY w"


@register("vocab_words", _COUNTS_SQL)
def vocab_words(spark, sf):
    return V.word_counts(_corpus(spark, sf))


@register("vocab_seed_pieces",
          "SELECT piece, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT freq, unnest(flatten(list_transform(range(1, len(w) + 1), "
          "lambda s: list_transform(range(1, least(8, len(w) - s + 1) + 1), lambda l: substring(w, s, l))))) AS piece "
          f"FROM (SELECT '{V.WORD_BOUNDARY}' || word AS w, freq FROM ({_COUNTS_SQL}))) WHERE piece <> '{V.WORD_BOUNDARY}' "
          "GROUP BY piece HAVING sum(freq) >= 2")
def vocab_seed_pieces(spark, sf):
    return V.seed_pieces(V.word_counts(_corpus(spark, sf)), max_len=8, min_freq=2)


@register("vocab_pairs",
          "SELECT p.a AS \"left\", p.b AS \"right\", CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT freq, "
          "unnest(list_transform(range(1, len(c)), lambda i: {'a': c[i], 'b': c[i + 1]})) AS p FROM ("
          f"SELECT string_split('{V.WORD_BOUNDARY}' || word, '') AS c, freq FROM ({_COUNTS_SQL}))) GROUP BY p.a, p.b")
def vocab_pairs(spark, sf):
    return V.pair_counts(V.word_counts(_corpus(spark, sf)))


_VOCAB_SQL = ("SELECT '<pad>' AS piece, 0 AS id UNION ALL SELECT '</s>', 1 UNION ALL SELECT '<mask_1>', 2 "
              "UNION ALL SELECT '<unk>', 3 UNION ALL SELECT word, CAST(3 + row_number() OVER (ORDER BY freq DESC, word) AS INTEGER) "
              f"FROM ({_COUNTS_SQL}) QUALIFY row_number() OVER (ORDER BY freq DESC, word) <= {VOCAB - 4}")


@register("vocab_word", f"SELECT piece, CAST(id AS INTEGER) AS id FROM ({_VOCAB_SQL})")
def vocab_word(spark, sf):
    return V.word_vocab(V.word_counts(_corpus(spark, sf)), VOCAB)


SAMPLED = 5000        # sentences that the sampled vocabulary is trained on
_SAMPLED_SQL = (f"SELECT sentence FROM (SELECT doc_id, unnest(range(len(s))) AS sid, unnest(s) AS sentence FROM (SELECT doc_id, "
                f"{S.s_sentences('text')} AS s FROM documents)) ORDER BY md5(CAST(doc_id AS VARCHAR) || ':' || "
                f"CAST(sid AS VARCHAR) || '|{DEFAULT.seed}'), doc_id, sid LIMIT {SAMPLED}")
_SAMPLED_COUNTS = (f"SELECT w AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(sentence, {_WORDS})) AS w "
                   f"FROM ({_SAMPLED_SQL})) GROUP BY w")


@register("vocab_sampled", f"SELECT piece, CAST(id AS INTEGER) AS id FROM ({_VOCAB_SQL.replace(_COUNTS_SQL, _SAMPLED_COUNTS)})")
def vocab_sampled(spark, sf):
    """J1 on G7: the trainer draws its sentences itself."""
    return V.train_vocab(_docs(spark, sf), "word", VOCAB, sample=SAMPLED, seed=DEFAULT.seed)


def _encode_sql(src: str, col: str, width: int, mask: bool) -> str:
    """src yields (doc_id, <col>); ids csv (+ mask csv)."""
    toks = f"(regexp_extract_all({col}, {_WORDS}))[1:{width - 1}]"
    ids = (f"SELECT s.doc_id, list(coalesce(v.id, 3) ORDER BY s.pos) FILTER (WHERE s.tok IS NOT NULL) AS ids FROM ("
           f"SELECT doc_id, unnest(range(1, len(tk) + 1)) AS pos, unnest(tk) AS tok FROM (SELECT doc_id, {toks} AS tk FROM ({src})) "
           f"UNION ALL SELECT doc_id, NULL, NULL FROM ({src})) s LEFT JOIN ({_VOCAB_SQL}) v ON s.tok = v.piece GROUP BY s.doc_id")
    full = f"coalesce(ids, [])[1:{width - 1}] || [1] || list_transform(range({width} - least(len(coalesce(ids, [])), {width - 1}) - 1), lambda x: 0)"
    out = f"SELECT doc_id, array_to_string({full}, ',') AS ids"
    if mask:
        n = f"least(len(coalesce(ids, [])) + 1, {width})"
        out += f", array_to_string(list_transform(range({width}), lambda i: CASE WHEN i < {n} THEN 1 ELSE 0 END), ',') AS mask"
    return f"{out} FROM ({ids})"


def _csv(c):
    return F.array_join(F.col(c), ",")


@register("encode_word", _encode_sql(f"SELECT doc_id, t FROM ({_CORPUS_SQL})", "t", WIDTH, True))
def encode_word(spark, sf):
    corpus = _corpus_saved(spark, sf)
    c = corpus.withColumnRenamed("text", "t")
    vocab = V.word_vocab(V.word_counts(corpus), VOCAB)
    e = E.encode_word(c, vocab, {"t": WIDTH}, with_mask="t")
    return e.select("doc_id", _csv("t_ids").alias("ids"), _csv("attention_mask").alias("mask"))


_GSG_CLEAN = gsg_pairs_sql(f"SELECT doc_id, t FROM ({_CORPUS_SQL})", mode="with_replacement")


def _gsg_clean(spark, sf, corpus=None):
    return gap_sentences(corpus if corpus is not None else _corpus(spark, sf))


@register("encode_mask", _encode_sql(f"SELECT doc_id, input FROM ({_GSG_CLEAN})", "input", WIDTH, True))
def encode_mask(spark, sf):
    corpus = _corpus_saved(spark, sf)
    vocab = V.word_vocab(V.word_counts(corpus), VOCAB)
    e = E.encode_word(_gsg_clean(spark, sf, corpus), vocab, {"input": WIDTH}, with_mask="input")
    return e.select("doc_id", _csv("input_ids").alias("ids"), _csv("attention_mask").alias("mask"))


@register("encode_labels", _encode_sql(f"SELECT doc_id, labels FROM ({_GSG_CLEAN})", "labels", LABEL_WIDTH, False))
def encode_labels(spark, sf):
    corpus = _corpus_saved(spark, sf)
    vocab = V.word_vocab(V.word_counts(corpus), VOCAB)
    e = E.encode_word(_gsg_clean(spark, sf, corpus), vocab, {"labels": LABEL_WIDTH})
    return e.select("doc_id", _csv("labels_ids").alias("ids"))


@register("decode_word",
          f"SELECT d.doc_id, coalesce(x.text, '') AS text FROM ({_CORPUS_SQL}) d LEFT JOIN ("
          f"SELECT s.doc_id, string_agg(s.tok, ' ' ORDER BY s.pos) AS text FROM ("
          f"SELECT doc_id, unnest(range(1, len(tk) + 1)) AS pos, unnest(tk) AS tok FROM (SELECT doc_id, "
          f"(regexp_extract_all(t, {_WORDS}))[1:{WIDTH - 1}] AS tk FROM ({_CORPUS_SQL}))) s "
          f"JOIN ({_VOCAB_SQL}) v ON s.tok = v.piece AND v.id >= 4 GROUP BY s.doc_id) x ON d.doc_id = x.doc_id")
def decode_word(spark, sf):
    corpus = _corpus_saved(spark, sf)
    c = corpus.withColumnRenamed("text", "t")
    vocab = V.word_vocab(V.word_counts(corpus), VOCAB)
    e = E.encode_word(c, vocab, {"t": WIDTH})
    return E.decode_word(e, vocab, "t_ids", out_col="text")


# --- subword models: single rounds, losses and segmentation have SQL; the trained models are tested ---------

SEED_PIECES = 1500    # substrings in the model whose EM round and losses are compared with SQL
_MARKED_SQL = f"SELECT '{V.WORD_BOUNDARY}' || word AS w, freq FROM ({_COUNTS_SQL})"
_CHARS_SQL = f"SELECT c AS piece, sum(freq) AS freq FROM (SELECT unnest(string_split(w, '')) AS c, freq FROM ({_MARKED_SQL})) GROUP BY c"
_SEEDS_SQL = ("SELECT piece, sum(freq) AS freq FROM (SELECT freq, unnest(flatten(list_transform(range(1, len(w)), lambda s: "
              "list_transform(range(2, least(8, len(w) - s + 1) + 1), lambda l: substring(w, s, l))))) AS piece "
              f"FROM ({_MARKED_SQL})) GROUP BY piece HAVING sum(freq) >= 2 ORDER BY freq DESC, piece")


def _model_sql(n: str) -> str:
    """(piece, freq, score) of the characters and ``n`` substrings."""
    return ("SELECT piece, freq, CAST(round(ln(freq / sum(freq) OVER ()) * 1000000) AS BIGINT) AS score FROM "
            f"(SELECT * FROM ({_CHARS_SQL}) UNION ALL (SELECT * FROM ({_SEEDS_SQL}) LIMIT {n}))")


# arcs of each text's lattice: the pieces that stand at [s, e)
_ARCS_SQL = ("SELECT t.w, t.s, t.s + t.l AS e, m.piece, m.score FROM (SELECT w, s, unnest(range(1, least(8, len(w) - s) + 1)) AS l "
             "FROM (SELECT w, unnest(range(0, len(w))) AS s FROM texts)) t JOIN model m ON m.piece = substring(t.w, t.s + 1, t.l)")


def _lattice_sql(n: str, texts: str, arcs: str = "TRUE") -> str:
    """CTEs model, texts, arcs, ends, and best: the best score and the place before it for every place of a text."""
    return (f"WITH RECURSIVE model AS MATERIALIZED ({_model_sql(n)}), texts AS MATERIALIZED ({texts}), "
            f"arcs AS MATERIALIZED (SELECT * FROM ({_ARCS_SQL}) WHERE {arcs}), "
            "ends AS MATERIALIZED (SELECT w, e, list({'s': s, 'p': score}) AS a FROM arcs GROUP BY w, e), "
            "steps AS (SELECT w, 0 AS i, [0::BIGINT] AS best, [0::BIGINT] AS back FROM texts UNION ALL "
            "SELECT w, i + 1, list_append(best, x.c), list_append(back, x.s) FROM (SELECT g.w, g.i, g.best, g.back, "
            "list_max(list_transform(d.a, lambda z: {'c': g.best[z.s + 1] + z.p, 's': z.s})) AS x "
            "FROM steps g JOIN ends d ON d.w = g.w AND d.e = g.i + 1)), "
            "done AS MATERIALIZED (SELECT w, best, back FROM steps WHERE i = len(w)), "
            "walk AS (SELECT w, len(w) AS e, back[len(w) + 1] AS s, back FROM done UNION ALL "
            "SELECT w, s, back[s + 1], back FROM walk WHERE s > 0)")


def _expected_sql() -> str:
    """Forward and backward sums over the lattice of every distinct word."""
    return (f"WITH RECURSIVE model AS MATERIALIZED ({_model_sql(str(SEED_PIECES))}), texts AS MATERIALIZED ({_MARKED_SQL}), "
            f"arcs AS MATERIALIZED (SELECT w, s, e, piece, exp(score / 1000000.0) AS p FROM ({_ARCS_SQL})), "
            "ends AS MATERIALIZED (SELECT w, e, list({'s': s, 'p': p}) AS a FROM arcs GROUP BY w, e), "
            "starts AS MATERIALIZED (SELECT w, s, list({'e': e, 'p': p}) AS a FROM arcs GROUP BY w, s), "
            "ahead AS (SELECT w, 0 AS i, [1.0::DOUBLE] AS v FROM texts UNION ALL "
            "SELECT g.w, g.i + 1, list_append(g.v, list_sum(list_transform(d.a, lambda z: g.v[z.s + 1] * z.p))) "
            "FROM ahead g JOIN ends d ON d.w = g.w AND d.e = g.i + 1), "
            "rest AS (SELECT w, len(w) AS i, [1.0::DOUBLE] AS v FROM texts UNION ALL "  # v[1] stands for place len, v[2] for len - 1
            "SELECT g.w, g.i - 1, list_append(g.v, list_sum(list_transform(d.a, lambda z: g.v[len(g.w) - z.e + 1] * z.p))) "
            "FROM rest g JOIN starts d ON d.w = g.w AND d.s = g.i - 1), "
            "f AS (SELECT w, v FROM ahead WHERE i = len(w)), b AS (SELECT w, v FROM rest WHERE i = 0), "
            "found AS (SELECT a.piece, sum(t.freq * f.v[a.s + 1] * a.p * b.v[len(a.w) - a.e + 1] / f.v[len(a.w) + 1]) AS n "
            "FROM arcs a JOIN texts t ON t.w = a.w JOIN f ON f.w = a.w JOIN b ON b.w = a.w GROUP BY a.piece) "
            "SELECT piece, round(n, 3) AS expected FROM found")


@register("unigram_expected", _expected_sql())
def unigram_expected(spark, sf):
    """One EM round from the seed model: the expected count of every piece."""
    counts = cut_lineage(V.word_counts(_corpus(spark, sf)))
    pieces = cut_lineage(V.initial_pieces(counts, SEED_PIECES))
    return V.em_round(V.marked_words(counts), pieces).select("piece", F.round("freq", 3).alias("expected"))


@register("unigram_losses", _lattice_sql(
    str(SEED_PIECES), f"SELECT w FROM ({_MARKED_SQL})") +
    ", uses AS MATERIALIZED (SELECT substring(k.w, k.s + 1, k.e - k.s) AS piece, CAST(sum(m.freq) AS BIGINT) AS n FROM walk k "
    f"JOIN ({_MARKED_SQL}) m ON m.w = k.w GROUP BY 1), "
    "other AS MATERIALIZED (" + _lattice_sql(str(SEED_PIECES), f"SELECT piece AS w FROM ({_model_sql(str(SEED_PIECES))}) WHERE len(piece) > 1",
                                "e - s < len(w)") + " SELECT w AS piece, best[len(w) + 1] AS other FROM done) "
    "SELECT m.piece, m.score, coalesce(u.n, 0) AS uses, CAST(coalesce(u.n, 0) * (m.score - o.other) AS BIGINT) AS loss "
    "FROM model m JOIN other o ON o.piece = m.piece LEFT JOIN uses u ON u.piece = m.piece")
def unigram_losses(spark, sf):
    """What the likelihood loses with each piece of the seed model."""
    counts = cut_lineage(V.word_counts(_corpus(spark, sf)))
    pieces = cut_lineage(V.initial_pieces(counts, SEED_PIECES))
    return V.piece_losses(V.marked_words(counts), pieces)


@register("vocab_unigram")
def vocab_unigram(spark, sf):
    return V.train_unigram(V.word_counts(_corpus(spark, sf)), vocab_size=SUB_VOCAB, seed_size=5000, rounds=1)


# words as runs of <symbol> marks, so that a merge is one replacement of all its occurrences
_BPE_SQL = (
    "WITH RECURSIVE chars AS MATERIALIZED (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i FROM (SELECT DISTINCT "
    f"unnest(string_split(w, '')) AS c FROM ({_MARKED_SQL}))), "
    f"start AS MATERIALIZED (SELECT list({{'w': list_aggregate(list_transform(string_split(w, ''), lambda c: chr(1) || c || chr(2)), "
    f"'string_agg', ''), 'f': freq::BIGINT}}) AS ws FROM ({_MARKED_SQL})), "
    "merged AS (SELECT 0 AS step, ws, NULL::VARCHAR AS a, NULL::VARCHAR AS b FROM start UNION ALL "
    "SELECT step + 1, list_transform(ws, lambda x: {'w': replace(x.w, chr(1) || p.a || chr(2) || chr(1) || p.b || chr(2), "
    "chr(1) || p.a || p.b || chr(2)), 'f': x.f}), p.a, p.b FROM (SELECT step, ws, (SELECT {'a': a, 'b': b} FROM ("
    "SELECT s[k] AS a, s[k + 1] AS b, f FROM (SELECT s, f, unnest(range(1, len(s))) AS k FROM (SELECT "
    "string_split(x.w[2:-2], chr(2) || chr(1)) AS s, x.f AS f FROM (SELECT unnest(m.ws) AS x)))) GROUP BY a, b HAVING sum(f) >= 2 "
    "ORDER BY sum(f) DESC, a, b LIMIT 1) AS p FROM merged m WHERE step < "
    f"{BPE_VOCAB - V.FIRST_PIECE_ID} - (SELECT count(*) FROM chars)) WHERE p IS NOT NULL) "
    "SELECT piece, CAST(id AS INTEGER) AS id, CAST(rank AS INTEGER) AS rank FROM ("
    "SELECT '<pad>' AS piece, 0 AS id, -1 AS rank UNION ALL SELECT '</s>', 1, -1 UNION ALL SELECT '<mask_1>', 2, -1 UNION ALL "
    f"SELECT '<unk>', 3, -1 UNION ALL SELECT c, {V.FIRST_PIECE_ID} + i, -1 FROM chars UNION ALL "
    f"SELECT a || b, {V.FIRST_PIECE_ID} + (SELECT count(*) FROM chars) + step - 1, step - 1 FROM merged WHERE step > 0)")


@register("vocab_bpe", _BPE_SQL)
def vocab_bpe(spark, sf):
    """Characters and merges; the merges are the sequential ones (SQL takes them one at a time)."""
    return V.train_bpe(V.word_counts(_corpus(spark, sf)), vocab_size=BPE_VOCAB).select("piece", "id", "rank")


# the seed vocabulary: ids by frequency, ties by piece; {n}: how many substrings it holds beside the characters
_ROOM_SQL = f"(SELECT {SUB_VOCAB - V.FIRST_PIECE_ID} - count(*) FROM ({_CHARS_SQL}))"


def _segments_sql(col: str) -> str:
    """(doc_id, ids): the ids of all pieces of a column's words, in order, for the whole text."""
    words = f"SELECT doc_id, regexp_extract_all({col}, {_WORDS}) AS tk FROM ({_GSG_CLEAN})"
    return (_lattice_sql(_ROOM_SQL, f"SELECT DISTINCT '{V.WORD_BOUNDARY}' || unnest(tk) AS w FROM ({words})") +
            ", ids AS (SELECT piece, 3 + row_number() OVER (ORDER BY freq DESC, piece) AS id FROM model), "
            "seg AS MATERIALIZED (SELECT k.w, list(i.id ORDER BY k.s) AS ids FROM walk k "
            "JOIN ids i ON i.piece = substring(k.w, k.s + 1, k.e - k.s) GROUP BY k.w) "
            "SELECT d.doc_id, flatten(list(CASE WHEN d.tok IS NULL THEN [] WHEN d.tok = '<mask_1>' THEN [2] ELSE g.ids END "
            "ORDER BY d.pos)) AS ids FROM (SELECT doc_id, unnest(range(1, len(tk) + 1)) AS pos, unnest(tk) AS tok "
            f"FROM ({words}) UNION ALL SELECT doc_id, 0, NULL FROM ({words})) d LEFT JOIN seg g ON g.w = '{V.WORD_BOUNDARY}' || d.tok "
            "GROUP BY d.doc_id")


def _padded_sql(width: int) -> str:
    return (f"array_to_string(ids[1:{width - 1}] || [1] || list_transform(range({width} - least(len(ids), {width - 1}) - 1), "
            "lambda x: 0), ',')")


@register("encode_unigram",
          f"SELECT i.doc_id, i.ids AS input_ids, i.mask, l.ids AS labels FROM (SELECT doc_id, {_padded_sql(SUB_WIDTH)} AS ids, "
          f"array_to_string(list_transform(range({SUB_WIDTH}), lambda k: CASE WHEN k < least(len(ids) + 1, {SUB_WIDTH}) THEN 1 "
          f"ELSE 0 END), ',') AS mask FROM ({_segments_sql('input')})) i JOIN (SELECT doc_id, {_padded_sql(SUB_LABELS)} AS ids "
          f"FROM ({_segments_sql('labels')})) l ON l.doc_id = i.doc_id")
def encode_unigram(spark, sf):
    """Gap-sentence pairs encoded with the seed vocabulary (a trained one has no SQL) at the default widths."""
    corpus = _corpus_saved(spark, sf)
    vocab = V.seed_vocab(cut_lineage(V.word_counts(corpus)), SUB_VOCAB)
    g = _gsg_clean(spark, sf, corpus)
    e = E.encode_subword(g, vocab, {"input": SUB_WIDTH, "labels": SUB_LABELS}, mode="unigram", with_mask="input")
    return e.select("doc_id", _csv("input_ids").alias("input_ids"), _csv("attention_mask").alias("mask"),
                    _csv("labels_ids").alias("labels"))


@register("decode_unigram",
          f"SELECT doc_id, array_to_string(regexp_extract_all(t, {_WORDS}), ' ') AS text FROM ({_CORPUS_SQL})")
def decode_unigram(spark, sf):
    """J6 on subwords: whole texts, unpadded, come back as their words joined by spaces."""
    corpus = _corpus_saved(spark, sf)
    vocab = V.train_vocab(corpus, "unigram", SUB_VOCAB, seed_size=5000, rounds=1)
    ids = E.encode(corpus, vocab, {"text": None}, "unigram")
    return E.decode(ids, vocab, "text_ids", "unigram")


# --- J7: clean for inference, then encode ----------------------------------------------------------

_NEWS_MODULE = S.chain(f"SELECT doc_id, {S.s_news_raw()} AS t FROM documents", "t", S.preset_steps("module", True))


@register("prepare_input", _encode_sql(_NEWS_MODULE, "t", WIDTH, True))
def prepare_input(spark, sf):
    from .derived import news_raw
    vocab = V.word_vocab(V.word_counts(_corpus(spark, sf)), VOCAB)
    raw = _docs(spark, sf).select("doc_id", news_raw().alias("text"))
    e = E.prepare_input(raw, vocab, WIDTH)
    return e.select("doc_id", _csv("input_ids").alias("ids"), _csv("attention_mask").alias("mask"))


# --- B6: crawl corpus -> encoded shard records ---------------------------------------------------

_REC_ROWS = 64


def _records_sql() -> str:
    from .q_gsg import _OSCAR_SQL
    inp = _encode_sql(f"SELECT doc_id, input FROM ({_OSCAR_SQL})", "input", WIDTH, True)
    lab = _encode_sql(f"SELECT doc_id, labels FROM ({_OSCAR_SQL})", "labels", LABEL_WIDTH, False)
    return (f"SELECT i.doc_id, i.ids AS input_ids, i.mask, l.ids AS labels, "
            f"CAST(floor((row_number() OVER (ORDER BY i.doc_id) - 1) / {_REC_ROWS}) AS INTEGER) AS shard "
            f"FROM ({inp}) i JOIN ({lab}) l ON i.doc_id = l.doc_id")


@register("pretrain_records", _records_sql())
def pretrain_records(spark, sf):
    from dataclasses import replace as _replace

    from ..options import DEFAULT
    from . import corpora as C
    from . import derived as D
    vocab = V.word_vocab(V.word_counts(_corpus(spark, sf)), VOCAB)
    d = _docs(spark, sf)
    d = d.withColumn("meta_li", D.line_ids(F.col("doc_id"), F.col("text"), F.col("lang")))
    opts = _replace(DEFAULT, model_max_length=WIDTH, max_summary_length=LABEL_WIDTH, rows_per_shard=_REC_ROWS)
    r = C.pretrain_records(d, "meta_li", vocab, lang="en", opts=opts)
    return r.select("doc_id", _csv("input_ids").alias("input_ids"), _csv("attention_mask").alias("mask"),
                    _csv("labels").alias("labels"), "shard")


# --- L4 + B5: pairs -> encoded shard records --------------------------------------------------------

def _xlsum_records_sql() -> str:
    pairs = ORACLE["prep_xlsum"]
    inp = _encode_sql(f"SELECT doc_id, input FROM ({pairs})", "input", SUB_WIDTH, True)
    lab = _encode_sql(f"SELECT doc_id, labels FROM ({pairs})", "labels", SUB_LABELS, False)
    n = f"(SELECT CAST(ceil(count(*) / {_REC_ROWS}) AS BIGINT) FROM ({pairs}))"
    return (f"SELECT i.doc_id, i.ids AS input_ids, i.mask, l.ids AS labels, "
            f"CAST((row_number() OVER (ORDER BY i.doc_id) - 1) % {n} AS INTEGER) AS shard "
            f"FROM ({inp}) i JOIN ({lab}) l ON i.doc_id = l.doc_id")


@register("xlsum_records", _xlsum_records_sql())
def xlsum_records(spark, sf):
    """Cleaned and cut pairs, encoded at the default widths, in strided shards."""
    from dataclasses import replace as _replace

    from . import corpora as C
    from .registry import QUERIES
    pairs = cut_lineage(QUERIES["prep_xlsum"](spark, sf))
    vocab = V.word_vocab(V.word_counts(_corpus(spark, sf)), VOCAB)
    r = C.pair_records(pairs, vocab, "doc_id", _replace(DEFAULT, rows_per_shard=_REC_ROWS))
    return r.select("doc_id", _csv("input_ids").alias("input_ids"), _csv("attention_mask").alias("mask"),
                    _csv("labels").alias("labels"), "shard")


# --- L8 from encoded records: decode, extract candidates, score, report ------------------------------

_DECODED = "SELECT doc_id, string_agg(tok, ' ' ORDER BY pos) AS {c} FROM (SELECT doc_id, unnest(range(1, len(tk) + 1)) AS pos, " \
           "unnest(tk) AS tok FROM (SELECT doc_id, (regexp_extract_all({c}, {w}))[1:{n}] AS tk FROM ({src}))) s " \
           "JOIN ({vocab}) v ON v.piece = s.tok AND v.id >= 4 GROUP BY doc_id"


def _decoded_sql() -> str:
    pairs = ORACLE["prep_xlsum"]
    a, b = (_DECODED.format(c=c, w=_WORDS, n=n - 1, src=pairs, vocab=_VOCAB_SQL) for c, n in (("input", SUB_WIDTH), ("labels", SUB_LABELS)))
    both = (f"SELECT p.doc_id, coalesce(i.input, '') AS pred, coalesce(l.labels, '') AS gold FROM ({pairs}) p "
            f"LEFT JOIN ({a}) i ON i.doc_id = p.doc_id LEFT JOIN ({b}) l ON l.doc_id = p.doc_id")
    # the prediction: the article's first words, as many as the labels' width holds
    src = f"SELECT doc_id, array_to_string((string_split(pred, ' '))[1:{SUB_LABELS - 1}], ' ') AS pred, gold FROM ({both})"
    return (f"SELECT s.doc_id, s.gold, s.pred, r1.rouge1, r2.rouge2, rl.rougeL FROM ({src}) s "
            f"JOIN ({rouge_n_sql(src, 1, key='doc_id')}) r1 ON r1.doc_id = s.doc_id "
            f"JOIN ({rouge_n_sql(src, 2, key='doc_id')}) r2 ON r2.doc_id = s.doc_id "
            f"JOIN ({S.rouge_l_sql(src, 'pred', 'gold', ['doc_id'])}) rl ON rl.doc_id = s.doc_id")


@register("eval_decoded", _decoded_sql())
def eval_decoded(spark, sf):
    """Encoded records are decoded again; the first words of each article are scored against its decoded summary."""
    from ..operators import rouge as R
    from . import corpora as C
    from .registry import QUERIES
    pairs = cut_lineage(QUERIES["prep_xlsum"](spark, sf))
    vocab = V.word_vocab(V.word_counts(_corpus(spark, sf)), VOCAB)
    records = cut_lineage(C.pair_records(pairs, vocab, "doc_id"))
    article = E.decode(records, vocab, "input_ids", out_col="article")
    gold = E.decode(records, vocab, "labels", out_col="gold")
    # cut before the join, which then moves the first words alone
    pred = article.select("doc_id", T.materialized(T.truncate_words(F.col("article"), SUB_LABELS - 1, "space")).alias("pred"))
    return R.score_pairs(pred.join(gold, "doc_id").select("doc_id", "gold", "pred"), "doc_id")
