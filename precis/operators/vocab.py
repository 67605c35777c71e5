"""Vocabulary training as Spark jobs.

Everything starts from the distinct-word frequency table ``word_counts`` (one
aggregate with map-side combine, so a word occurring in a third of all rows is summed
per partition before the shuffle). The table of distinct words is far smaller than
the corpus and is what the iterative algorithms (unigram EM, BPE merges) work on.

Id layout (ours): 0 pad, 1 end of sequence, 2 ``<mask_1>``, 3 unknown, pieces from 4.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EOS_TOKEN, MASK_TOKEN, PY_WS, split_sentences
from ..operators import order as O
from ..session import cut_lineage, shuffle_partitions
from .subword import expected_counts, micro, segment, trie, viterbi

# Special tokens and their ids.
PAD, EOS, MASK, UNK = 0, 1, 2, 3
SPECIALS = [("<pad>", PAD), (EOS_TOKEN, EOS), (MASK_TOKEN, MASK), ("<unk>", UNK)]
FIRST_PIECE_ID = 4
WORD_BOUNDARY = "▁"   # marks the start of a word inside subword pieces
# split between characters only (a zero-width match at the end would add an empty piece)
CHARS_RE = "(?s)(?<=.)(?=.)"


def word_tokens(text_col) -> "F.Column":
    """Runs of non-whitespace (Python ``str.split()``)."""
    from ..functions.text import words
    return words(F.col(text_col) if isinstance(text_col, str) else text_col)


def sample_sentences(docs: DataFrame, n: int, seed: int, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """The first ``n`` sentences of a seeded hash order (exact; all, if there are fewer). The hash of the n-th one
    comes from counts by hash prefix (``order.nth_key``); sentences below it are in, and of those that share it (the
    same document id and number, repeated) as many as make up n."""
    sents = docs.select(F.col(id_col).alias("doc_id"),
                        F.posexplode(split_sentences(F.col(text_col))).alias("sid", "sentence"))
    keyed = sents.withColumn("skey", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("sid").cast("string")))
    hashed = keyed.withColumn("_hash", O.order_key("skey", seed))
    last = O.nth_key(hashed.select("_hash"), "_hash", n)
    if last is None:
        return keyed.where(F.lit(n > 0)).select("doc_id", "sid", "sentence")
    # some n rows, written once to the shared checkpoint folder instead of a scan of the corpus for each use
    near = cut_lineage(hashed.where(F.col("_hash") <= F.lit(last)))
    over = near.where(F.col("_hash") == F.lit(last))
    short = n - near.where(F.col("_hash") < F.lit(last)).count()
    kept = near.where(F.col("_hash") < F.lit(last)).unionByName(over.orderBy("skey", "sentence").limit(short))
    return kept.select("doc_id", "sid", "sentence")


def word_counts(corpus: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq) over whitespace tokens."""
    return (corpus.select(F.explode(word_tokens(text_col)).alias("word"))
                  .groupBy("word").agg(F.count(F.lit(1)).alias("freq")))


def word_vocab(counts: DataFrame, vocab_size: int) -> DataFrame:
    """Word-level vocabulary: specials, then the ``vocab_size - 4`` most frequent words
    (ties by word). (piece, id). The top-k keeps at most k rows per partition."""
    n = max(0, vocab_size - FIRST_PIECE_ID)
    top = counts.where(~F.col("word").isin([s for s, _ in SPECIALS])).orderBy(F.col("freq").desc(), F.col("word")).limit(n)
    ranked = top.select(F.col("word").alias("piece"),
                        (F.row_number().over(Window.orderBy(F.col("freq").desc(), F.col("word")))
                         + (FIRST_PIECE_ID - 1)).cast("int").alias("id"))
    spark = counts.sparkSession
    specials = spark.createDataFrame(SPECIALS, "piece string, id int")
    # the vocabulary is a small model artifact (at most vocab_size rows): materialise it
    # once in the shared checkpoint folder so that size checks and lookups reuse it
    return cut_lineage(specials.unionByName(ranked).coalesce(1))


def seed_pieces(counts: DataFrame, max_len: int = 8, min_freq: int = 2) -> DataFrame:
    """Unigram seeds: every substring (up to ``max_len`` characters) of every distinct
    word, with the word boundary marker on word-initial pieces, weighted by the word's
    frequency. (piece, freq)."""
    marked = counts.select(F.concat(F.lit(WORD_BOUNDARY), F.col("word")).alias("w"), "freq")
    n = F.length("w")
    starts = F.sequence(F.lit(1), n)
    subs = marked.select(
        "freq", "w", F.explode(starts).alias("s"))
    subs = subs.select("freq", "w", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(max_len), n - F.col("s") + 1))).alias("l"))
    pieces = subs.select(F.substring(F.col("w"), F.col("s"), F.col("l")).alias("piece"), "freq")
    pieces = pieces.where(F.col("piece") != WORD_BOUNDARY)
    return pieces.groupBy("piece").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= min_freq)


def pair_counts(counts: DataFrame) -> DataFrame:
    """First BPE round: adjacent character pairs of every distinct word (with the word
    boundary marker first), weighted by word frequency. (left, right, freq)."""
    marked = counts.select(F.concat(F.lit(WORD_BOUNDARY), F.col("word")).alias("w"), "freq")
    chars = F.split(F.col("w"), CHARS_RE, -1)   # characters
    n = F.size(chars)
    z = F.arrays_zip(F.slice(chars, 1, F.greatest(n - 1, F.lit(0))).alias("a"),
                     F.slice(chars, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    pairs = marked.select("freq", F.explode(z).alias("p"))
    return (pairs.select(F.col("p.a").alias("left"), F.col("p.b").alias("right"), "freq")
                 .groupBy("left", "right").agg(F.sum("freq").alias("freq")))


# ------------------------------------------------------------------------------------------
# Subword models (J1 c/d): state lives in the distinct-word table and the piece table; each round is a
# Spark job, its result cut from its lineage with a reliable checkpoint.

def marked_words(counts: DataFrame) -> DataFrame:
    """(word, freq) with the word boundary marker in front of each word."""
    return counts.select(F.concat(F.lit(WORD_BOUNDARY), F.col("word")).alias("word"), "freq")


def _pieces_of(words: DataFrame, shortest: int, longest: int, triples=None) -> DataFrame:
    """(piece, freq) of all substrings of ``words`` (word, freq) with ``shortest`` to ``longest`` characters; ``triples``
    (a broadcast set): of those alone whose every three characters side by side are in it."""
    def run(batches):
        for b in batches:
            acc: dict = {}
            for word, freq in zip(b.column("word").to_pylist(), b.column("freq").to_pylist()):
                n, end = len(word), [len(word)] * len(word)
                if triples is not None:  # where the last piece from each character on ends
                    known, far = triples.value, 0
                    for i in reversed(range(n - 2)):
                        far = (far or i + 3) if word[i:i + 3] in known else 0
                        end[i] = far
                for i in range(n - shortest + 1):
                    for e in range(i + shortest, min(i + longest, end[i]) + 1):
                        acc[word[i:e]] = acc.get(word[i:e], 0) + freq
            yield pa.RecordBatch.from_arrays([pa.array(acc, pa.string()), pa.array(acc.values(), pa.int64())],
                                             names=["piece", "freq"])

    found = words.mapInArrow(run, "piece string, freq bigint")
    return found.groupBy("piece").agg(F.sum("freq").alias("freq"))


def frequent_pieces(counts: DataFrame, size: int, max_len: int = 8, min_freq: int = 2,
                    max_broadcast: int = 2_000_000) -> DataFrame:
    """(piece, freq): the ``size`` most frequent of ``seed_pieces`` with two characters or more (ties by piece).

    A piece is no more frequent than any part of it, so one that is among the first has no three characters side by side
    that are rarer than the last of the first among the pieces of two and three characters. Where more such triples are
    left than a broadcast should hold, all pieces are counted."""
    words = marked_words(counts)
    order = (F.col("freq").desc(), "piece")
    if max_len < 4 or size <= 0:
        return _pieces_of(words, 2, max_len).where(F.col("freq") >= min_freq).orderBy(*order).limit(max(0, size))
    short = cut_lineage(_pieces_of(words, 2, 3).where(F.col("freq") >= min_freq))
    least = short.orderBy(*order).limit(size).agg(F.count("*").alias("n"), F.min("freq").alias("least")).first()
    least = least["least"] if least["n"] == size else min_freq
    triples = [r["piece"] for r in short.where((F.length("piece") == 3) & (F.col("freq") >= least))
               .select("piece").limit(max_broadcast + 1).collect()]
    if len(triples) > max_broadcast:
        long = seed_pieces(counts, max_len, min_freq).where(F.length("piece") > 3)
    else:
        shared = counts.sparkSession.sparkContext.broadcast(frozenset(triples))
        long = _pieces_of(words, 4, max_len, shared).where(F.col("freq") >= least)
    return short.unionByName(long).orderBy(*order).limit(size)


def initial_pieces(counts: DataFrame, seed_size: int, max_len: int = 8) -> DataFrame:
    """(piece, freq): every character, and the ``seed_size`` most frequent longer substrings (ties by piece)."""
    chars = (marked_words(counts).select(F.explode(F.split("word", CHARS_RE, -1)).alias("piece"), "freq")
             .groupBy("piece").agg(F.sum("freq").alias("freq")))
    return chars.unionByName(frequent_pieces(counts, seed_size, max_len))


class Model:
    """Pieces (piece, freq) as scores that tasks share: the logarithm of each piece's share, in whole millionths. The
    trainer bounds their number by ``seed_size`` and the alphabet."""

    def __init__(self, pieces: DataFrame):
        rows = pieces.select("piece", "freq").collect()
        total = sum(r["freq"] for r in rows)
        self.longer = sum(len(r["piece"]) > 1 for r in rows)
        self.shared = pieces.sparkSession.sparkContext.broadcast([(r["piece"], micro(math.log(r["freq"] / total))) for r in rows])


def _summed(words: DataFrame, shared, per_word, ddl: str) -> DataFrame:
    """Sum over all words of ``per_word(word, trie)`` (piece -> number), times the word's frequency."""
    def run(batches):
        pieces = trie(shared.value)
        for pdf in batches:
            acc: dict = {}
            for word, freq in zip(pdf["word"], pdf["freq"]):
                for piece, n in per_word(word, pieces).items():
                    acc[piece] = acc.get(piece, 0) + n * freq
            yield pd.DataFrame({"piece": list(acc), "n": list(acc.values())})

    found = words.mapInPandas(run, f"piece string, n {ddl}")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


def em_round(words: DataFrame, pieces: DataFrame) -> DataFrame:
    """One round of EM over ``words`` (word, freq; marked): (piece, freq), the expected count of each piece under the
    scores of ``pieces`` (piece, freq). A character stays even where no path uses it."""
    found = _summed(words, Model(pieces).shared, expected_counts, "double")
    freq = F.when(F.length("piece") == 1, F.greatest(F.coalesce("n", F.lit(0.0)), F.lit(1e-6))).otherwise(F.col("n"))
    return pieces.select("piece").join(found, "piece", "left").select("piece", freq.alias("freq")).where("freq > 0")


def _best_counts(word: str, pieces: dict) -> dict[str, int]:
    out: dict[str, int] = {}
    for piece in segment(word, pieces):
        out[piece] = out.get(piece, 0) + 1
    return out


def piece_losses(words: DataFrame, pieces: DataFrame, model: Model | None = None) -> DataFrame:
    """(piece, score, uses, loss): what the likelihood of all words loses, in millionths, if a piece of two characters
    or more goes. ``uses`` counts it on the best paths; there its second-best segmentation, the best one of its own
    text without itself, takes its place. Pieces that no best path uses lose nothing."""
    model = model or Model(pieces)
    uses = _summed(words, model.shared, _best_counts, "bigint")

    def second(batches):
        tree = trie(model.shared.value)
        scores = dict(model.shared.value)
        for pdf in batches:
            yield pd.DataFrame({"piece": pdf["piece"], "score": [scores[p] for p in pdf["piece"]],
                                "other": [viterbi(p, tree, whole=False)[0] for p in pdf["piece"]]})

    longer = pieces.where(F.length("piece") > 1).select("piece").mapInPandas(second, "piece string, score bigint, other bigint")
    used = F.coalesce("n", F.lit(0))
    return longer.join(uses, "piece", "left").select(
        "piece", "score", used.alias("uses"), (used * (F.col("score") - F.col("other"))).alias("loss"))


def _numbered(pieces: DataFrame) -> DataFrame:
    """(piece, id, logp) of a vocabulary's pieces (piece, freq) by frequency, ties by piece, behind the specials."""
    total = F.lit(pieces.agg(F.sum("freq")).first()[0])
    order = Window.orderBy(F.col("freq").desc(), "piece")  # vocab_size rows
    ids = (F.row_number().over(order) + (FIRST_PIECE_ID - 1)).cast("int")
    rows = pieces.select("piece", ids.alias("id"), F.log(F.col("freq") / total).alias("logp"))
    specials = pieces.sparkSession.createDataFrame([(p, i, 0.0) for p, i in SPECIALS], "piece string, id int, logp double")
    return cut_lineage(specials.unionByName(rows).coalesce(1))


def _room(counts: DataFrame, vocab_size: int) -> int:
    """How many pieces of two characters or more a vocabulary holds beside the specials and the characters."""
    chars = marked_words(counts).select(F.explode(F.split("word", CHARS_RE, -1)).alias("c")).distinct().count()
    room = vocab_size - FIRST_PIECE_ID - chars
    if room < 0:
        raise ValueError(f"vocab_size {vocab_size} does not hold the {chars} characters of the corpus")
    return room


def seed_vocab(counts: DataFrame, vocab_size: int, max_len: int = 8) -> DataFrame:
    """The unigram vocabulary before any training (piece, id, logp): all characters and the most frequent substrings."""
    return _numbered(cut_lineage(initial_pieces(counts, _room(counts, vocab_size), max_len)))


def train_unigram(counts: DataFrame, vocab_size: int = 16_000, seed_size: int = 200_000, rounds: int = 2,
                  shrink: float = 0.75, max_len: int = 8, max_broadcast: int = 2_000_000) -> DataFrame:
    """Unigram LM vocabulary (piece, id, logp) over the distinct-word table.

    ``rounds`` rounds of EM, then the pieces shrink to ``shrink`` of their number: those stay whose loss would cost the
    likelihood most (characters always), and so on down to the target, with EM last. E-steps, best paths and second-best
    paths run on executors against a broadcast of the pieces (at most ``seed_size`` and the characters, checked against
    ``max_broadcast``); sums, joins and the cut are Spark aggregates."""
    if seed_size > max_broadcast:
        raise ValueError(f"seed_size {seed_size} exceeds the broadcast bound {max_broadcast}")
    counts = cut_lineage(counts)  # read several times: the corpus is not
    # a small table would come back in one partition, and the rounds would run in one task
    words = cut_lineage(marked_words(counts).repartition(shuffle_partitions(counts.sparkSession), "word"))
    room = _room(counts, vocab_size)
    pieces = cut_lineage(initial_pieces(counts, seed_size, max_len))
    while True:
        for _ in range(rounds):
            pieces = cut_lineage(em_round(words, pieces))
        model = Model(pieces)
        if model.longer <= room:
            return _numbered(pieces)
        keep = max(room, int(model.longer * shrink))
        best = piece_losses(words, pieces, model).orderBy(F.col("loss").desc(), "piece").limit(keep)
        best = best.select("piece", F.lit(True).alias("kept"))
        pieces = cut_lineage(pieces.join(best, "piece", "left").where((F.length("piece") == 1) | F.col("kept")).drop("kept"))


def _adjacent(words: DataFrame) -> DataFrame:
    """(a, b, prev, next, freq) of every two neighbours in every word's symbols ``sym``; null at the word's ends."""
    n = F.size("sym")
    at = F.explode(F.expr("sequence(1, size(sym) - 1)"))
    return words.where(n > 1).select("sym", "freq", at.alias("i")).select(
        F.expr("get(sym, i - 1)").alias("a"), F.expr("get(sym, i)").alias("b"), F.expr("get(sym, i - 2)").alias("prev"),
        F.expr("get(sym, i + 1)").alias("next"), "freq")


def _certain(top: list, symbols: set[str]) -> list:
    """The first of the pairs in order that share no symbol and make no symbol that exists: until one of them makes a new
    pair, merging the earlier ones changes neither their counts nor their order."""
    out, used = [], set()
    for r in top:
        if used & {r["a"], r["b"]} or (out and r["a"] + r["b"] in symbols):
            break
        out.append(r)
        used |= {r["a"], r["b"], r["a"] + r["b"]}
        if r["a"] + r["b"] in symbols:
            break
    return out


def _first_merges(words: DataFrame, batch: list) -> list:
    """Those of the certain pairs that come before any pair that the merges make. A new pair (symbol, a + b) or
    (a + b, symbol) occurs no more often than ``symbol`` stands beside a, b now, so a pair may follow while its count
    is over all such counts of the pairs before it."""
    if len(batch) < 2:
        return batch
    chosen = F.broadcast(words.sparkSession.createDataFrame([(r["a"], r["b"]) for r in batch], "a string, b string"))
    sides = _adjacent(words).join(chosen, ["a", "b"]).select(
        "a", "b", "freq", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("prev").alias("by")),
                                            F.struct(F.lit(1).alias("side"), F.col("next").alias("by")))).alias("s"))
    beside = sides.where("s.by IS NOT NULL").groupBy("a", "b", "s").agg(F.sum("freq").alias("n"))
    most = {(r["a"], r["b"]): r["n"] for r in beside.groupBy("a", "b").agg(F.max("n").alias("n")).collect()}
    out, new = [], 0
    for r in batch:
        if out and r["freq"] <= new:
            break
        out.append(r)
        new = max(new, most.get((r["a"], r["b"]), 0))
    return out


def merge_pairs(symbols: list[str], merges: set[tuple[str, str]]) -> list[str]:
    """The symbols with every occurrence of the pairs (no two share a symbol) merged, leftmost first."""
    out, i = [], 0
    while i < len(symbols):
        if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) in merges:
            out.append(symbols[i] + symbols[i + 1])
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def bpe_merges(counts: DataFrame, merges: int, min_freq: int = 2, at_once: int = 256) -> list[tuple[str, str, int]]:
    """The first ``merges`` merges (left, right, count) of byte-pair encoding over the distinct-word table, as one
    merge at a time gives them: the most frequent pair of neighbours (ties by left, then right symbol; a count
    weighs words by frequency) is merged in all words, then pairs are counted anew; fewer where no pair occurs
    ``min_freq`` times.

    A round counts all pairs, then merges as many of the first ``at_once`` as surely come next in that order (see
    ``_certain`` and ``_first_merges``), so the result does not depend on ``at_once``. Only those pairs reach the driver."""
    words = marked_words(counts).select(F.split("word", CHARS_RE, -1).alias("sym"), "freq")
    words = cut_lineage(words.repartition(shuffle_partitions(counts.sparkSession), "sym"))
    symbols = {r["c"] for r in words.select(F.explode("sym").alias("c")).distinct().collect()}  # the alphabet
    found: list[tuple[str, str, int]] = []
    while len(found) < merges:
        pairs = _adjacent(words).groupBy("a", "b").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= min_freq)
        top = pairs.orderBy(F.col("freq").desc(), "a", "b").limit(at_once).collect()
        batch = _first_merges(words, _certain(top, symbols)[:merges - len(found)])
        if not batch:
            break
        found += [(r["a"], r["b"], r["freq"]) for r in batch]
        symbols |= {r["a"] + r["b"] for r in batch}
        now = {(r["a"], r["b"]) for r in batch}

        def merge(batches, now=now):
            for pdf in batches:
                yield pd.DataFrame({"sym": [merge_pairs(list(x), now) for x in pdf["sym"]], "freq": pdf["freq"]})

        words = cut_lineage(words.mapInPandas(merge, "sym array<string>, freq bigint"))
    return found


def train_bpe(counts: DataFrame, vocab_size: int = 16_000, min_freq: int = 2) -> DataFrame:
    """BPE vocabulary (piece, id, rank, left, right): the characters, then the merges in their order; a merge joins its
    left and its right symbol. Two merges may make one piece: encoding takes the first one's id."""
    counts = cut_lineage(counts)  # read several times: the corpus is not
    chars = marked_words(counts).select(F.explode(F.split("word", CHARS_RE, -1)).alias("c")).distinct()
    alphabet = [r["c"] for r in chars.orderBy("c").collect()]
    merges = bpe_merges(counts, _room(counts, vocab_size), min_freq)
    rows = [(p, i, -1, None, None) for p, i in SPECIALS]
    rows += [(p, FIRST_PIECE_ID + i, -1, None, None) for i, p in enumerate(alphabet)]
    rows += [(a + b, FIRST_PIECE_ID + len(alphabet) + i, i, a, b) for i, (a, b, _) in enumerate(merges)]
    return counts.sparkSession.createDataFrame(rows, "piece string, id int, rank int, left string, right string")


def train_vocab(corpus: DataFrame, model_type: str = "unigram", vocab_size: int = 16_000, text_col: str = "text",
                sample: int | None = None, seed: int = 42, id_col: str = "doc_id", **settings) -> DataFrame:
    """The vocabulary (piece, id, and logp or rank) of the texts for ``model_type`` word, unigram or bpe; with
    ``sample``, of that many of their sentences (G7: the first in a seeded hash order, all if there are fewer)."""
    trainers = {"word": word_vocab, "unigram": train_unigram, "bpe": train_bpe}
    if model_type not in trainers:
        raise ValueError(f"unknown model {model_type!r}")
    if sample is not None:
        corpus, text_col = sample_sentences(corpus, sample, seed, id_col, text_col), "sentence"
    return trainers[model_type](word_counts(corpus, text_col), vocab_size, **settings)
