import collections
import math
import random

import pyarrow as pa
from pyspark.sql import functions as F

from precis.operators import encode as E
from precis.operators import subword as S
from precis.operators import vocab as V


def _corpus(spark):
    texts = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "mat mat mat"]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_word_vocab_and_roundtrip(spark):
    c = _corpus(spark)
    vocab = V.word_vocab(V.word_counts(c), 8)
    ids = {r.piece: r.id for r in vocab.collect()}
    assert ids["<pad>"] == 0 and ids["</s>"] == 1 and ids["<mask_1>"] == 2 and ids["<unk>"] == 3
    assert ids["mat"] == 4 and ids["the"] == 5 and len(ids) == 8
    df = spark.createDataFrame([(1, "the mat <mask_1> zebra")], "doc_id long, t string")
    e = E.encode_word(df, vocab, {"t": 8}, with_mask="t").first()
    assert e.t_ids == [5, 4, 2, 3, 1, 0, 0, 0]
    assert e.attention_mask == [1, 1, 1, 1, 1, 0, 0, 0]
    dec = E.decode_word(E.encode_word(df, vocab, {"t": 8}), vocab, "t_ids", out_col="x").first()
    assert dec.x == "the mat"


def test_truncation_keeps_width(spark):
    c = _corpus(spark)
    vocab = V.word_vocab(V.word_counts(c), 16)
    df = spark.createDataFrame([(1, " ".join(["cat"] * 50))], "doc_id long, t string")
    e = E.encode_word(df, vocab, {"t": 10}, with_mask="t").first()
    assert len(e.t_ids) == 10 and e.t_ids[-1] == 1 and e.attention_mask == [1] * 10


def test_unigram_invariants(spark):
    c = _corpus(spark)
    vocab = V.train_unigram(V.word_counts(c), vocab_size=30, seed_size=500, rounds=2)
    rows = vocab.collect()
    pieces = [r for r in rows if r.id >= 4]
    assert len(rows) <= 30
    chars = set("".join(["▁" + w for t in ["the cat sat on the mat"] for w in t.split()]))
    assert chars <= {r.piece for r in pieces}
    assert abs(sum(math.exp(r.logp) for r in pieces) - 1.0) < 1e-6
    enc = E.encode_subword(c, vocab, {"text": 24}, mode="unigram", with_mask="text").collect()
    assert all(len(r.text_ids) == 24 and 3 not in r.text_ids for r in enc)


def test_bpe_invariants(spark):
    c = _corpus(spark)
    vocab = V.train_bpe(V.word_counts(c), vocab_size=30)
    rows = vocab.collect()
    assert len(rows) <= 30
    enc = E.encode_subword(c, vocab, {"text": 24}, mode="bpe").collect()
    assert all(len(r.text_ids) == 24 and 3 not in r.text_ids for r in enc)


def test_subword_round_trip_and_no_exchange(spark):
    c = _corpus(spark)
    for model in ("unigram", "bpe"):
        vocab = V.train_vocab(c, model, 30)
        enc = E.encode(c, vocab, {"text": 64}, model, with_mask="text")
        assert "Exchange" not in enc._jdf.queryExecution().executedPlan().toString()
        back = {r.doc_id: r.text for r in E.decode(enc, vocab, "text_ids", model).collect()}
        assert back == {r.doc_id: r.text for r in c.collect()}, model


def test_encoding_of_odd_rows(spark):
    c = _corpus(spark)
    vocab = V.train_vocab(c, "word", 12)
    odd = spark.createDataFrame([("a", None), ("a", ""), (None, "the zebra")], "doc_id string, t string")
    got = E.encode(odd, vocab, {"t": 4}, with_mask="t").collect()
    assert sorted((r.doc_id or "", r.attention_mask) for r in got) == [("", [1, 1, 1, 0]), ("a", [1, 0, 0, 0]), ("a", [1, 0, 0, 0])]
    assert E.encode(odd.limit(0), vocab, {"t": 4}).collect() == []


def _slow_bpe(word, ranks):
    symbols = list(word)
    while True:
        known = [(ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]
        if not known:
            return symbols
        i = min(known)[1]
        symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]


def _all_segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            yield from ([word[:n]] + rest for rest in _all_segmentations(word[n:], pieces))


def _random_pieces(rng):
    pieces = {c: S.micro(-rng.randint(2, 9)) for c in "ab"}
    pieces |= {"".join(rng.choices("ab", k=rng.randint(2, 5))): S.micro(-rng.randint(1, 9)) for _ in range(rng.randint(0, 8))}
    return pieces


def test_bpe_by_heap_equals_the_plain_loop():
    rng = random.Random(1)
    for _ in range(1500):
        symbols, ranks = list("abc"), {}
        for rank in range(rng.randint(0, 12)):
            pair = rng.choice(symbols), rng.choice(symbols)
            ranks.setdefault(pair, rank)
            symbols.append("".join(pair))
        word = "".join(rng.choices("abc", k=rng.randint(0, 14)))
        assert S.bpe(word, ranks) == _slow_bpe(word, ranks)


def test_viterbi_and_expected_counts_equal_all_segmentations():
    rng = random.Random(2)
    for _ in range(300):
        pieces, word = _random_pieces(rng), "".join(rng.choices("ab", k=rng.randint(1, 9)))
        ways = list(_all_segmentations(word, pieces))
        # of equal scores the shortest last piece, then the one before it, ..
        best = max(ways, key=lambda w: (sum(pieces[p] for p in w), [-len(p) for p in reversed(w)]))
        tree = S.trie(pieces.items())
        assert S.segment(word, tree) == best
        weights = [math.exp(sum(pieces[p] for p in w) / S.MICRO) for w in ways]
        want = collections.Counter()
        for w, weight in zip(ways, weights):
            for p in w:
                want[p] += weight / sum(weights)
        got = S.expected_counts(word, tree)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
        if len(word) > 1:
            others = [w for w in ways if len(w) > 1]
            assert S.viterbi(word, tree, whole=False)[0] == max(sum(pieces[p] for p in w) for w in others)


def test_very_long_words_and_unknown_characters():
    rng = random.Random(3)
    tree = S.trie(_random_pieces(rng).items())
    word = "".join(rng.choices("ab", k=200_000))
    assert "".join(S.segment(word, tree)) == word
    assert "".join(S.bpe(word, {("a", "b"): 0, ("ab", "ab"): 1, ("a", "a"): 2})) == word
    assert S.segment("zabz", tree)[0] == "z" and S.expected_counts("zab", tree) == {}
    assert S.segment("", tree) == [] and S.bpe("", {}) == []


def test_losses_are_what_the_likelihood_loses(spark):
    """On words that are single pieces with uses of their own, taking a piece out costs exactly its loss."""
    counts = V.word_counts(_corpus(spark)).cache()
    pieces = V.initial_pieces(counts, 40).cache()
    words = {r.word: r.freq for r in V.marked_words(counts).collect()}
    rows = {r.piece: r.freq for r in pieces.collect()}
    scores = {p: S.micro(math.log(f / sum(rows.values()))) for p, f in rows.items()}

    def best(without=None):
        tree = S.trie((p, s) for p, s in scores.items() if p != without)
        return sum(f * S.viterbi(w, tree)[0] for w, f in words.items())

    whole = best()
    got = V.piece_losses(V.marked_words(counts), pieces).collect()
    assert {r.piece for r in got} == {p for p in rows if len(p) > 1}
    for r in got:
        assert r.loss >= 0 and r.loss >= whole - best(r.piece)  # the words may find a better way round than the piece's own
        assert r.uses or r.loss == 0
    assert sum(r.loss == whole - best(r.piece) for r in got) > len(got) / 2


def test_em_raises_the_likelihood(spark):
    counts = V.word_counts(_corpus(spark)).cache()
    words, pieces = V.marked_words(counts), V.initial_pieces(counts, 40)

    def likelihood(pieces):
        rows = {r.piece: r.freq for r in pieces.collect()}
        total = sum(rows.values())
        out = 0.0
        for r in words.collect():
            ways = _all_segmentations(r.word, rows)
            out += r.freq * math.log(sum(math.prod(rows[p] / total for p in w) for w in ways))
        return out

    once = V.em_round(words, pieces).cache()
    assert likelihood(pieces) < likelihood(once) <= likelihood(V.em_round(words, once)) + 1e-6


def test_unpadded_ids_come_back_whole(spark):
    c = _corpus(spark)
    vocab = V.seed_vocab(V.word_counts(c), 40)
    enc = E.encode(c, vocab, {"text": None}, "unigram", with_mask="text")
    assert all(r.text_ids[-1] == 1 and r.attention_mask == [1] * len(r.text_ids) and 0 not in r.text_ids for r in enc.collect())
    back = {r.doc_id: r.text for r in E.decode(enc, vocab, "text_ids", "unigram").collect()}
    assert back == {r.doc_id: r.text for r in c.collect()}


def test_merges_equal_one_at_a_time(spark):
    rng = random.Random(4)
    for _ in range(3):
        words = {"".join(rng.choices("abcd", k=rng.randint(1, 9))): rng.randint(1, 6) for _ in range(60)} | {"aaaaa": 3, "abab": 2}
        counts = spark.createDataFrame(list(words.items()), "word string, freq long")
        state = [(list(V.WORD_BOUNDARY + w), f) for w, f in words.items()]
        want = []
        while len(want) < 40:
            pairs = collections.Counter()
            for symbols, f in state:
                for p in zip(symbols, symbols[1:]):
                    pairs[p] += f
            pairs = {p: n for p, n in pairs.items() if n >= 2}
            if not pairs:
                break
            (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
            want.append((a, b, n))
            state = [(V.merge_pairs(symbols, {(a, b)}), f) for symbols, f in state]
        assert V.bpe_merges(counts, 40) == want


def test_train_on_a_sample_of_sentences(spark):
    rows = [(i, f"w{i} gemeinsam. zweiter w{i}b satz! Ende") for i in range(40)] + [(99, None), (100, "")]
    c = spark.createDataFrame(rows, "doc_id int, text string")
    chosen = V.sample_sentences(c, 30, 5).collect()
    assert len(chosen) == 30
    words = {w for r in chosen for w in r.sentence.split()}
    got = {r.piece for r in V.train_vocab(c, "word", 500, sample=30, seed=5).collect()}
    assert got == words | {"<pad>", "</s>", "<mask_1>", "<unk>"}
    everything = {w for _, t in rows for w in (t or "").split()}
    assert {r.piece for r in V.train_vocab(c, "word", 500, sample=10_000).collect()} >= everything
    twice = c.union(c)
    assert V.sample_sentences(twice, 31, 5).count() == 31
    assert V.sample_sentences(c, 0, 5).count() == 0 and V.sample_sentences(c.where("false"), 3, 5).count() == 0


def test_words_side_by_side_equal_one_by_one():
    rng = random.Random(11)
    for n in range(40):
        scores = _random_pieces(rng)
        if n % 4:
            scores |= {"▁": S.micro(-3), "▁a": S.micro(-2)}
        ids = {p: V.FIRST_PIECE_ID + i for i, p in enumerate(scores)}
        words = ["".join(rng.choices("abzé日", (6, 6, 1, 1, 1), k=rng.choice((0, 1, 2, 5, 9, 31, 32, 33, 60)))) for _ in range(50)]
        tree = S.trie(scores.items())
        want = [[ids.get(x, V.UNK) for x in S.segment("▁" + w, tree)] for w in words]
        for cells in (S.Segmenter.CELLS, 0):
            side = type("Side", (S.Segmenter,), {"CELLS": cells})(scores, ids, V.UNK, "▁")
            sizes, found = side(pa.array(["left out", *words]).slice(1))
            assert sizes.tolist() == [len(x) for x in want] and found.tolist() == sum(want, [])
    sizes, found = side(pa.array([], pa.string()))
    assert not len(sizes) and not len(found)


def test_words_are_segmented_together(spark, monkeypatch):
    """A word of its own is no turn of a Python loop: only long ones go one by one."""
    alone = []
    monkeypatch.setattr(S, "segment", lambda word, tree: alone.append(word) or [word])
    side = S.Segmenter({"a": -1, "b": -2, "ab": -1}, {"a": 4, "b": 5, "ab": 6}, V.UNK, "▁")
    sizes, ids = side(pa.array(["ab", "b", "a" * 40]))
    assert alone == ["▁" + "a" * 40] and sizes.tolist() == [2, 2, 1] and ids.tolist() == [V.UNK, 6, V.UNK, 5, V.UNK]


def test_frequent_pieces_are_the_first_of_all(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abcé", (5, 3, 1, 1), k=rng.randint(1, 12))): rng.randint(1, 9) for _ in range(300)}
    counts = spark.createDataFrame(list(words.items()), "word string, freq bigint").cache()
    every = sorted(((r.freq, r.piece) for r in V.seed_pieces(counts).collect() if len(r.piece) > 1), key=lambda x: (-x[0], x[1]))
    for size, most in ((1, 2_000_000), (40, 2_000_000), (40, 3), (400, 2_000_000), (10**6, 2_000_000)):
        got = sorted(((r.freq, r.piece) for r in V.frequent_pieces(counts, size, max_broadcast=most).collect()), key=lambda x: (-x[0], x[1]))
        assert got == every[:size], (size, most)
    short = [x for x in every if len(x[1]) < 4]
    assert {(r.freq, r.piece) for r in V.frequent_pieces(counts, 10**6, max_len=3).collect()} == set(short)
    assert V.frequent_pieces(counts, 0).collect() == [] and V.frequent_pieces(counts.limit(0), 5).collect() == []


def test_rare_longer_pieces_are_not_shuffled(spark):
    """Of pieces that hold a rare triple none is counted."""
    counts = spark.createDataFrame([("abcdefgh", 100), ("zyxwvuts", 1)], "word string, freq bigint")
    shared = spark.sparkContext.broadcast(frozenset(["abc", "bcd", "cde"]))
    assert {r.piece for r in V._pieces_of(counts, 4, 8, shared).collect()} == {"abcd", "bcde", "abcde"}
