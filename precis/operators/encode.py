"""Encoding and decoding (J2-J7), row by row: nothing is shuffled, so a very common word is no hot key.

The vocabulary (``vocab_size`` rows, bounded by its trainer) is broadcast to the tasks. ``word`` mode looks whole
words up. ``unigram`` and ``bpe`` segment words into subword pieces: ``unigram`` the different words of a slice at once,
``bpe`` one by one, and a task remembers those it has segmented.

Output widths are fixed: ids truncated to ``width - 1``, then end-of-sequence, then
padding (id 0) up to ``width``; the attention mask is 1 for real tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions.text import MASK_TOKEN
from .batches import in_slices
from .subword import Segmenter, bpe, micro
from .vocab import EOS, FIRST_PIECE_ID, MASK, PAD, UNK, WORD_BOUNDARY, word_tokens

REMEMBERED = 200_000  # segmented words a task keeps; then it starts anew


def pad_ids(ids: Column, width: int) -> Column:
    """ids[:width-1] + [EOS] + [PAD] * rest -> exactly ``width`` ids."""
    body = F.slice(ids, 1, width - 1)
    with_eos = F.concat(body, F.array(F.lit(EOS)))
    return F.concat(with_eos, F.array_repeat(F.lit(PAD), F.lit(width) - F.size(with_eos))).cast("array<int>")


def attention_mask(ids_len: Column, width: int) -> Column:
    """1 for the real tokens (ids + end of sequence), 0 for padding."""
    n = F.least(ids_len + 1, F.lit(width))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(width) - n)).cast("array<int>")


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def _word_udf(shared):
    table: list = []  # the vocabulary as Arrow arrays, made once in a worker

    def run(tokens: pa.Array) -> pa.Array:
        flat = tokens.flatten()
        if not table:
            pieces, ids = shared.value
            table.extend((pa.array(pieces, flat.type), pa.array(ids, pa.int32())))
        at = pc.index_in(flat, value_set=table[0])
        found = pc.fill_null(pc.take(table[1], at), UNK)
        return _lists(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(), found)

    return F.arrow_udf(in_slices(run), ArrayType(IntegerType())).asNondeterministic()


def _subword_udf(shared, mode: str, width: int | None):
    memory: dict[str, bytes] = {}  # bpe: ids as 32-bit numbers
    model: list = []  # unigram: the segmenter; bpe: ids by piece and the merge ranks; made once in a worker

    def merged(word: str) -> bytes:
        if word == MASK_TOKEN:
            return np.array([MASK], np.int32).tobytes()
        ids, ranks = shared.value
        return np.array([ids.get(x, UNK) for x in bpe(WORD_BOUNDARY + word, ranks)], np.int32).tobytes()

    def by_merges(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for w in words.to_pylist():
            if w not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                memory[w] = merged(w)
            found.append(memory[w])
        return np.array([len(x) // 4 for x in found], np.int64), np.frombuffer(b"".join(found), np.int32)

    def by_pieces(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not model:
            ids, scores = shared.value
            model.append(Segmenter(scores, ids, UNK, WORD_BOUNDARY))
        pieces, ids = model[0](words)
        mask = pc.index(words, MASK_TOKEN).as_py()
        if mask >= 0:  # one id of its own
            first = pieces[:mask].sum()
            ids = np.concatenate((ids[:first], [MASK], ids[first + pieces[mask]:])).astype(np.int32)
            pieces[mask] = 1
        return pieces, ids

    def run(tokens: pa.Array) -> pa.Array:
        coded = tokens.flatten().dictionary_encode()  # every different word once a slice
        pieces, ids = (by_pieces if mode == "unigram" else by_merges)(coded.dictionary)
        word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lists = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(lists)))
        first = np.cumsum(pieces) - pieces
        ends = np.concatenate(([0], np.cumsum(pieces[word])))  # ids before each word
        sizes = np.diff(ends[upto])
        if width:  # words behind the width are left before their ids are looked up
            within = np.flatnonzero(ends[:-1] - np.repeat(ends[upto[:-1]], lists) < width - 1)
            word, sizes = word[within], np.minimum(sizes, width - 1)
            owner = np.repeat(np.arange(len(lists)), lists)[within]
            held = np.bincount(owner, pieces[word], len(lists)).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(pieces[word])))
        ids = ids[np.arange(ends[-1]) + np.repeat(first[word] - ends[:-1], pieces[word])]
        if width:  # and what the last word has behind it
            ids = ids[np.arange(len(ids)) - np.repeat(np.cumsum(held) - held, held) < np.repeat(sizes, held)]
        return _lists(sizes, pa.array(ids, pa.int32()))

    return F.arrow_udf(in_slices(run), ArrayType(IntegerType())).asNondeterministic()


def encode(df: DataFrame, vocab: DataFrame, cols: dict[str, int | None], mode: str = "word", id_col: str = "doc_id",
           with_mask: str | None = None) -> DataFrame:
    """``cols`` maps text column -> width; the result has ``id_col``, ``<col>_ids`` per column (and
    ``attention_mask`` of ``with_mask``), one row per row. A width of None encodes whole texts without padding.
    ``mode`` names the vocabulary's model (word, unigram, bpe). Null and empty texts are an end of sequence and
    padding; words or characters that the vocabulary lacks are the unknown id."""
    rows = vocab.collect()  # vocab_size rows
    sc = df.sparkSession.sparkContext
    if mode == "word":
        shared = sc.broadcast(([r["piece"] for r in rows], [r["id"] for r in rows]))
        udfs = {w: _word_udf(shared) for w in cols.values()}
    elif mode in ("unigram", "bpe"):
        rows = [r for r in rows if r["id"] >= FIRST_PIECE_ID]
        scores = ({r["piece"]: micro(r["logp"]) for r in rows} if mode == "unigram" else
                  {(r["left"], r["right"]): r["rank"] for r in rows if r["rank"] >= 0})
        ids = {r["piece"]: r["id"] for r in sorted(rows, key=lambda r: -r["id"])}  # of equal pieces the smallest id
        shared = sc.broadcast((ids, scores))
        udfs = {w: _subword_udf(shared, mode, w) for w in cols.values()}
    else:
        raise ValueError(f"unknown model {mode!r}")
    # a word has one piece at least: width - 1 words fill the width
    words = {c: word_tokens(c) if w is None else F.slice(word_tokens(c), 1, w - 1) for c, w in cols.items()}
    staged = df.select(id_col, *[udfs[w](words[c]).alias(f"_i_{c}") for c, w in cols.items()])
    out = [F.col(id_col)]
    for c, w in cols.items():
        out.append((pad_ids(F.col(f"_i_{c}"), w) if w else F.concat(f"_i_{c}", F.array(F.lit(EOS)))).alias(f"{c}_ids"))
        if with_mask == c:
            n = F.size(f"_i_{c}")
            out.append((attention_mask(n, w) if w else F.array_repeat(F.lit(1), n + 1)).alias("attention_mask"))
    return staged.select(*out)


def encode_word(df: DataFrame, vocab: DataFrame, cols: dict[str, int], id_col: str = "doc_id",
                with_mask: str | None = None) -> DataFrame:
    """J3/J5 with a word vocabulary."""
    return encode(df, vocab, cols, "word", id_col, with_mask)


def encode_subword(df: DataFrame, vocab: DataFrame, cols: dict[str, int | None], mode: str = "unigram",
                   id_col: str = "doc_id", with_mask: str | None = None) -> DataFrame:
    """J3/J5 with a unigram or bpe vocabulary."""
    return encode(df, vocab, cols, mode, id_col, with_mask)


def decode(df: DataFrame, vocab: DataFrame, ids_col: str, mode: str = "word", id_col: str = "doc_id",
           out_col: str = "text") -> DataFrame:
    """Ids back to text; special ids are skipped. Words are joined by spaces; subword pieces are joined as
    they are and their word marks become the spaces between words."""
    rows = [r for r in vocab.collect() if r["id"] >= FIRST_PIECE_ID]  # vocab_size rows
    shared = df.sparkSession.sparkContext.broadcast(([r["id"] for r in rows], [r["piece"] for r in rows]))

    def run(ids: pa.Array) -> pa.Array:
        numbers, pieces = shared.value
        at = pc.index_in(ids.flatten(), value_set=pa.array(numbers, ids.type.value_type))
        upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))))
        known = np.concatenate(([0], np.cumsum(at.is_valid().to_numpy(zero_copy_only=False))))  # special ids are left out
        lists = _lists(np.diff(known[upto]), pc.take(pa.array(pieces, pa.string()), at.drop_null()))
        return pc.binary_join(lists, " " if mode == "word" else "")

    text = F.arrow_udf(in_slices(run), StringType()).asNondeterministic()(F.col(ids_col))
    if mode != "word":
        text = F.ltrim(F.replace(text, F.lit(WORD_BOUNDARY), F.lit(" ")))
    return df.select(id_col, text.alias(out_col))


def decode_word(df: DataFrame, vocab: DataFrame, ids_col: str, id_col: str = "doc_id", out_col: str = "text") -> DataFrame:
    """J6 with a word vocabulary."""
    return decode(df, vocab, ids_col, "word", id_col, out_col)


def prepare_input(df: DataFrame, vocab: DataFrame, max_len: int, id_col: str = "doc_id", text_col: str = "text",
                  mode: str = "word") -> DataFrame:
    """Module cleaning (news) then encode to ``max_len`` with the attention mask."""
    from ..functions.text import clean_preset
    cleaned = df.select(id_col, clean_preset(F.col(text_col), "module", True).alias("_clean"))
    out = encode(cleaned, vocab, {"_clean": max_len}, mode, id_col, "_clean")
    return out.select(id_col, F.col("_clean_ids").alias("input_ids"), "attention_mask")
