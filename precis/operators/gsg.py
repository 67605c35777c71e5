"""Gap-sentence generation (H1, I1-I8): per document, score every sentence with
ROUGE-1 F against the rest of the document, select the top share, mask some of them.

Closed form of the score: with c_i(w) the count of word w in sentence i, C(w) its
count in the document and N the document's token count,
    overlap_i = sum_w min(c_i(w), C(w) - c_i(w)),   F1_i = 2 * overlap_i / N.
N is constant per document, so the ranking only needs the integer overlap.

A document is one input row, so nothing is shuffled: sentences, sizes, draws and the final
texts are array expressions, and one Arrow kernel counts and ranks the sentences of many
documents at once (codes for the words, counts per (sentence, word) and (document, word)).
Rows that share an id stay apart, and ids may have any type.

The masked subset follows the reference: ``u`` draws *with replacement* among the ``k``
selected sentences (mode ``with_replacement``), or all ``k`` (mode ``all``). The draws
are a seeded hash of (doc_id, draw number) instead of an unseeded RNG.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import MASK_TOKEN, PY_WS, split_sentences
from ..options import DEFAULT, Options
from .batches import bytes_through, in_parts, token_codes


def gsg_sizes(m: Column, rate: float, return_mask_rate: float) -> tuple[Column, Column]:
    """k = max(1, int(m*rate)); u = k - max(0, int(k*return_mask_rate))."""
    k = F.greatest(F.lit(1), F.floor(m.cast("double") * F.lit(float(rate))).cast("int"))
    u = k - F.greatest(F.lit(0), F.floor(k.cast("double") * F.lit(float(return_mask_rate))).cast("int"))
    return k.cast("int"), u.cast("int")


def draw_key(doc_id: Column, j: Column, seed: int) -> Column:
    """The j-th seeded draw of a document as a non-negative 32-bit integer."""
    key = F.concat_ws("|", doc_id.cast("string"), j.cast("string"), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


_WORD_BYTES = np.frombuffer(bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256)).lower(), np.uint8)


def _rank_batch(sents: pa.Array, k: pa.Array, drawn: pa.Array) -> pa.Array:
    """Per document a list of (overlap, n_tok, rank, selected, masked), one for each sentence."""
    size = pc.list_value_length(sents).to_numpy()
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    flat = sents.flatten()
    words, owner, n_words = token_codes(bytes_through(flat, _WORD_BYTES))
    pair, count = np.unique(owner * n_words + words, return_counts=True)
    sentence, word = pair // n_words, pair % n_words
    _, group = np.unique(row[sentence] * n_words + word, return_inverse=True)
    in_doc = np.bincount(group, count)
    overlap = np.bincount(sentence, np.minimum(count, in_doc[group] - count), len(flat)).astype(np.int64)
    order = np.lexsort((-overlap, row))  # stable: ties by sentence number
    rank = np.empty(len(flat), np.int32)
    rank[order] = np.arange(len(flat)) - start[row] + 1
    selected = rank <= k.to_numpy()[row]
    masked = selected
    if drawn.null_count < len(drawn):
        masked = np.zeros(len(flat), bool)
        chosen = np.flatnonzero(selected)
        first = np.searchsorted(row[chosen], np.arange(len(size)))
        of = np.repeat(np.arange(len(size)), pc.list_value_length(drawn).to_numpy())
        at = first[of] + drawn.flatten().to_numpy()
        masked[chosen[at[size[of] > 0]]] = True
    facts = pa.StructArray.from_arrays(
        [pa.array(overlap), pa.array(np.bincount(owner, minlength=len(flat)).astype(np.int64)), pa.array(rank),
         pa.array(selected), pa.array(masked)], names=_FACTS.fieldNames())
    return pa.ListArray.from_arrays(pa.array(np.append(start, len(flat)).astype(np.int32)), facts)


_FACTS = T.StructType([T.StructField("overlap", T.LongType()), T.StructField("n_tok", T.LongType()),
                       T.StructField("rank", T.IntegerType()), T.StructField("selected", T.BooleanType()),
                       T.StructField("masked", T.BooleanType())])
# nondeterministic: a deterministic UDF would run again for a filter pushed below it
_RANK_UDF = F.arrow_udf(in_parts(_rank_batch), T.ArrayType(_FACTS)).asNondeterministic()


def ranked_documents(docs: DataFrame, opts: Options = DEFAULT, id_col: str = "doc_id", text_col: str = "text",
                     mode: str = "all", keep: tuple[str, ...] = ()) -> DataFrame:
    """I1-I5 row by row: doc_id, sents, facts (one per sentence), m, k, u, keep... for every document that has
    sentences. No exchange."""
    sents = F.coalesce(split_sentences(F.col(text_col), opts.abbreviations), F.array().cast("array<string>"))
    base = docs.select(F.col(id_col).alias("doc_id"), sents.alias("sents"), *keep)
    k, u = gsg_sizes(F.size("sents"), opts.gsg_rate, opts.return_mask_rate)
    sized = base.select("*", F.size("sents").alias("m"), k.alias("k"), u.alias("u"))
    drawn = F.lit(None).cast("array<int>")
    if mode != "all":
        # the draw's document and range are zipped in: a lambda that reads another column breaks UDF extraction
        some = F.when(F.col("u") > 0, F.sequence(F.lit(1), F.col("u"))).otherwise(F.array().cast("array<int>"))
        zipped = F.arrays_zip(some.alias("j"), F.array_repeat("doc_id", F.col("u")).alias("d"),
                              F.array_repeat("k", F.col("u")).alias("k"))
        drawn = F.transform(zipped, lambda e: F.pmod(draw_key(e["d"], e["j"], opts.seed), e["k"].cast("bigint")).cast("int"))
    return (sized.withColumn("facts", _RANK_UDF(F.col("sents"), F.col("k"), drawn))
            .where(F.size("sents") > 0))


def sentence_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    opts: Options = DEFAULT) -> DataFrame:
    """H1 + I2 + I3: one row per sentence: doc_id, sid, overlap, n_tok, n_doc_tok, m, f1, k, u, rank, selected."""
    tokens = F.aggregate("facts", F.lit(0).cast("bigint"), lambda s, x: s + x["n_tok"])
    rows = ranked_documents(docs, opts, id_col, text_col).select(
        "doc_id", "m", "k", "u", tokens.alias("n_doc_tok"), F.posexplode("facts").alias("sid", "f"))
    f1 = F.when(F.col("n_doc_tok") > 0, F.lit(2.0) * F.col("f.overlap") / F.col("n_doc_tok")).otherwise(F.lit(0.0))
    return rows.select("doc_id", "sid", "f.overlap", "f.n_tok", "n_doc_tok", "m", f1.alias("f1"), "k", "u", "f.rank",
                       "f.selected")


def ranked_sentences(docs: DataFrame, opts: Options = DEFAULT, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """I4: the sentences with ``rank`` (overlap desc, sid asc), ``k``, ``u`` and ``selected``."""
    return sentence_scores(docs, id_col, text_col, opts)


def gap_sentences(docs: DataFrame, opts: Options = DEFAULT, id_col: str = "doc_id",
                  text_col: str = "text", mode: str | None = None, engine: str = "native") -> DataFrame:
    """(doc_id, input, labels, m, k, n_masked), one row per input row. Documents without sentences are
    dropped (``count_without_sentences`` counts them)."""
    mode = mode or opts.gsg_mode
    if engine == "arrow":
        return gap_sentences_arrow(docs, opts, id_col, text_col, mode)
    rows = ranked_documents(docs, opts, id_col, text_col, mode)
    z = F.arrays_zip(F.col("sents").alias("s"), F.col("facts").alias("f"))
    inp = F.array_join(F.transform(z, lambda e: F.when(e["f"]["masked"], F.lit(MASK_TOKEN)).otherwise(e["s"])), " ")
    lab = F.array_join(F.transform(F.filter(z, lambda e: e["f"]["selected"]), lambda e: e["s"]), " ")
    masked = F.size(F.filter("facts", lambda f: f["masked"]))
    return rows.select(F.col("doc_id").alias(id_col), inp.alias("input"), lab.alias("labels"), "m", "k",
                       masked.alias("n_masked"))


def count_without_sentences(docs: DataFrame, text_col: str = "text", opts: Options = DEFAULT) -> DataFrame:
    """I8: (n_docs, n_empty): documents, and those that ``gap_sentences`` drops (no sentence, or no text)."""
    n = F.coalesce(F.size(split_sentences(F.col(text_col), opts.abbreviations)), F.lit(0))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(n <= 0).alias("n_empty"))


# --------------------------------------------------------------------------------
# Row-local twin (no shuffle). Same definitions, written out per document in Python.
_WS = re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), PY_WS)  # the class as Python writes it
_SPLIT = re.compile("([.!?])" + _WS + "+")
_BLANK = re.compile("^" + _WS + "*$")
_NON_ALNUM = re.compile(r"[^a-zA-Z0-9]+")
_TOKEN = re.compile(r"[a-z0-9]+")


def py_sentences(text: str, abbreviations: tuple = ()) -> list[str]:
    if abbreviations:
        alts = "|".join(re.escape(a) for a in abbreviations)
        text = re.sub(r"(?<!\w)(" + alts + r")\.(?=" + _WS + ")",
                      "\\1\x02", text, flags=re.IGNORECASE)
    out = [p for p in _SPLIT.sub("\\1\x01", text).split("\x01") if not _BLANK.match(p)]
    return [p.replace("\x02", ".") for p in out] if abbreviations else out


def py_gsg(doc_id, text: str, opts: Options = DEFAULT, mode: str = "with_replacement"):
    sents = py_sentences(text, opts.abbreviations)
    m = len(sents)
    if m == 0:
        return None
    toks = [_TOKEN.findall(_NON_ALNUM.sub(" ", s).lower()) for s in sents]
    counts = [Counter(t) for t in toks]
    total = Counter()
    for c in counts:
        total.update(c)
    overlap = [sum(min(v, total[w] - v) for w, v in c.items()) for c in counts]
    k = max(1, int(math.floor(m * opts.gsg_rate)))
    u = k - max(0, int(math.floor(k * opts.return_mask_rate)))
    order = sorted(range(m), key=lambda i: (-overlap[i], i))
    sel = sorted(order[:k])
    if mode == "all":
        masked = set(sel)
    else:
        masked = set()
        for j in range(1, u + 1):
            h = int(hashlib.md5(f"{doc_id}|{j}|{opts.seed}".encode()).hexdigest()[:8], 16)
            masked.add(sel[h % k])
    inp = " ".join(MASK_TOKEN if i in masked else s for i, s in enumerate(sents))
    lab = " ".join(sents[i] for i in sel)
    return inp, lab, m, k, len(masked)


def gap_sentences_arrow(docs: DataFrame, opts: Options = DEFAULT, id_col: str = "doc_id",
                        text_col: str = "text", mode: str = "with_replacement") -> DataFrame:
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type)]).simpleString()[len("struct<"):-1].replace(":", " ")
    schema += ", input string, labels string, m int, k int, n_masked int"

    def run(batches):
        for pdf in batches:
            out = []
            for did, txt in zip(pdf[id_col], pdf[text_col]):
                r = py_gsg(did, txt, opts, mode) if txt is not None else None
                if r is not None:
                    out.append((did,) + r)
            yield pd.DataFrame(out, columns=[id_col, "input", "labels", "m", "k", "n_masked"])

    return docs.select(id_col, text_col).mapInPandas(run, schema)
