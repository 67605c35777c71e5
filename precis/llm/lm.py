"""Katz backoff bigram scores.

Texts are packed into chunks: a chunk has the distinct words and the token numbers of some documents. Counting is a
question and an answer: a chunk asks about its distinct words (then its distinct word pairs) with its own counts, dealt
out by hash to buckets; a bucket adds up what all chunks sent, which gives its part of the n-gram table, and answers each
chunk in the order it asked. Thus no n-gram table is ever whole anywhere, and a token is looked up in its chunk.

Counts up to ``CUT`` are discounted by Good-Turing with Katz's cutoff, from the counts of counts of all buckets. The mass
that discounting leaves behind a history goes to the words not seen there, in proportion to their unigram probability;
the backoff weight of every history is the exact quotient, so that each distribution sums to one over the training words,
the end and one class of unknown words. Pairs are dealt out by history; a history with a large share of all tokens is
dealt to several buckets, by its next word, and its parts are added."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, texts

CHUNK = 16 << 20  # bytes of text in a chunk
CUT = 5
END = b" "  # no word holds white space
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _zip(a: np.ndarray | bytes) -> bytes:
    raw = a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else bytes(8)


def _unzip(z: bytes, dtype=None):
    n = int.from_bytes(z[:8], "little")
    raw = pa.decompress(z[8:], n, codec="zstd", asbytes=True) if n else b""
    return raw if dtype is None else np.frombuffer(raw, dtype)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _MIX
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


# ---- chunks -------------------------------------------------------------------------------------------------------

def chunks(docs: DataFrame, id_col: str, text_col: str, trains: Column, size: int = CHUNK) -> DataFrame:
    """One row per chunk: number, ids, train flags and token counts of its documents, token numbers and words."""
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("trains", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.IntegerType())),
        T.StructField("tokens", T.BinaryType()), T.StructField("words", T.BinaryType())])

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        index, tokens, lengths, ids, flags, held = {END: 0}, [], [], [], [], 0

        def close():
            t = np.concatenate(tokens)
            n = np.bincount(t, minlength=len(index))
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            words = list(index)
            own = pa.concat_arrays(ids)
            row = [pa.array([task << 32 | number]), pa.ListArray.from_arrays([0, len(own)], own),
                   pa.array([list(chain(*flags))], pa.list_(pa.bool_())), pa.array([lengths], pa.list_(pa.int32())),
                   pa.array([_zip(rank[t])], pa.binary()),
                   pa.array([_zip(b"\n".join(words[i] for i in order.tolist()))], pa.binary())]
            return pa.RecordBatch.from_arrays(row, names=schema.names)

        for b in batches:
            begin = 0
            for i, d in enumerate(texts(b.column(1))):
                w = d.translate(_LOWER).split()
                t = np.fromiter((index.setdefault(x, len(index)) for x in w), np.int32, len(w))
                tokens.append(np.append(t, np.int32(0)))
                lengths.append(len(w) + 1)
                held += len(d) + 16
                if held > size:
                    ids.append(b.column(0).slice(begin, i + 1 - begin))
                    flags.append(b.column(2).slice(begin, i + 1 - begin).to_pylist())
                    yield close()
                    index, tokens, lengths, ids, flags, held = {END: 0}, [], [], [], [], 0
                    number, begin = number + 1, i + 1
            if begin < b.num_rows:
                ids.append(b.column(0).slice(begin))
                flags.append(b.column(2).slice(begin).to_pylist())
        if lengths:
            yield close()

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"),
                       F.coalesce(trains, F.lit(False)).alias("_trains")).mapInArrow(run, schema)


class _Chunk:
    """A chunk's arrays. Pairs are its distinct (history, word), numbered in order; the start is history ``v``."""

    def __init__(self, row: dict):
        self.words = _unzip(row["words"]).split(b"\n")
        self.tokens = _unzip(row["tokens"], np.int32).astype(np.int64)
        self.lengths = np.array(row["lengths"], np.int64)
        self.trains = np.repeat(np.array(row["trains"], bool), self.lengths)
        self.v = len(self.words)

    def word_buckets(self, buckets: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in self.words), np.int64, self.v)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.trains], minlength=self.v)

    def pairs(self):
        """History and word of each distinct pair, the pair of each token, training count of each pair."""
        history = np.concatenate(([0], self.tokens[:-1]))
        history[np.cumsum(self.lengths) - self.lengths] = self.v
        pair, of = np.unique(history * (self.v + 1) + self.tokens, return_inverse=True)
        return pair // (self.v + 1), pair % (self.v + 1), of, np.bincount(of[self.trains], minlength=len(pair))


def _by_bucket(bucket: np.ndarray):
    """Order by bucket, and (bucket, from, to) of each that occurs."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    return order, list(zip(b[cuts].tolist(), cuts.tolist(), np.append(cuts[1:], len(b)).tolist()))


# ---- discounting --------------------------------------------------------------------------------------------------

def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """Factors for the counts 0..CUT + 1 (the last: undiscounted), from the numbers of n-grams seen 1..CUT + 1 times.
    Good-Turing with Katz's cutoff, at the largest cutoff where every factor lies between 0 and 1; on corpora too
    small for any, absolute discounting by n1 / (n1 + 2 n2)."""
    n = np.concatenate(([0], counts_of_counts)).astype(float)
    for cut in range(CUT, 0, -1):
        if (n[1:cut + 2] > 0).all():
            r = np.arange(1, cut + 1)
            gone = (cut + 1) * n[cut + 1] / n[1]
            if gone < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - gone) / (1 - gone)
                if ((d > 0) & (d < 1)).all():
                    return np.concatenate(([0], d, np.ones(CUT + 1 - cut)))
    r = np.arange(1, CUT + 1)
    take = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return np.concatenate(([0], 1 - take / r, [1]))


class Unigrams:
    """Probabilities of words from their training counts; ``unknown`` is that of the class of all unseen words."""

    def __init__(self, tokens: int, words: int, counts_of_counts: np.ndarray, discounted: np.ndarray):
        self.tokens, self.words, self.factor = tokens, words, discounts(counts_of_counts)
        taken = float((discounted * (1 - self.factor[1:CUT + 1])).sum())  # discounted[r-1]: tokens of words seen r times
        self.taken = taken if taken > 0 else 1.0
        self.total = tokens if taken > 0 else tokens + 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        known = c * self.factor[np.minimum(c, CUT + 1)] / self.total
        return np.where(c > 0, known, self.taken / self.total)


def _mass(c: np.ndarray) -> np.ndarray:
    """Tokens by count class: columns 1..CUT, above."""
    out = np.zeros((len(c), CUT + 1))
    seen = c > 0
    out[np.flatnonzero(seen), np.minimum(c[seen], CUT + 1) - 1] = c[seen]
    return out


def backoff(mass: np.ndarray, unigram_mass: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For histories with tokens by count class and the unigram mass of the words seen: (backoff weight, divisor of
    the discounted counts). A history that loses nothing by discounting gives one count in c + 1 away."""
    total = mass.sum(axis=1)
    kept = mass @ factor[1:]
    none = kept >= total * (1 - 1e-12)
    divisor = np.where(none, total + 1, total)
    left = np.where(none, 1.0, total - kept) / np.maximum(divisor, 1)
    return left / np.maximum(1 - unigram_mass, 1e-12), divisor


# ---- scores -------------------------------------------------------------------------------------------------------

_ANSWER = "chunk long, bucket long, a binary, b binary"


def scores(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text",
           chunk_bytes: int = CHUNK) -> DataFrame:
    """(``id_col``, n_tokens, n_known, train_tokens, base_score, score) for every row; the model learns from the rows
    that ``trains`` selects (null: not). base_score is the add-0.1 unigram score, score the Katz bigram's log10
    probability of the text with its end.

    Null and blank texts are an end alone; repeated rows count and are scored each; an empty table gives an empty
    result; with no training rows every token is unknown and scores log10 of 1."""
    spark = docs.sparkSession
    packed = settle(chunks(docs, id_col, text_col, trains, chunk_bytes))
    buckets = max(1, packed.count())

    # words: question, sum, answer
    def ask_words(batches):
        for b in batches:
            for row in b.to_pylist():
                c = _Chunk(row)
                n = c.word_counts()
                order, cuts = _by_bucket(c.word_buckets(buckets))
                rows = [(row["chunk"], k, _zip(b"\n".join(c.words[i] for i in order[i0:i1].tolist())),
                         _zip(n[order[i0:i1]])) for k, i0, i1 in cuts]
                yield _batch(rows)

    def add_words(group: pa.Table) -> pa.Table:
        index, asked = {}, []
        bucket = group["bucket"][0].as_py()
        for ch, w, n in zip(group["chunk"].to_pylist(), group["a"].to_pylist(), group["b"].to_pylist()):
            w = _unzip(w).split(b"\n")
            at = np.fromiter((index.setdefault(x, len(index)) for x in w), np.int64, len(w))
            asked.append((ch, at, _unzip(n, np.int64)))
        total = np.zeros(len(index), np.int64)
        for _, at, n in asked:
            total[at] += n
        number = 1 + bucket + buckets * np.arange(len(index))  # of the word in the whole corpus
        rows = [(ch, bucket, _zip(total[at]), _zip(number[at])) for ch, at, _ in asked]
        low = total[total <= CUT + 1]
        rows.append((-1, bucket, _zip(np.concatenate(([total.sum(), (total > 0).sum()],
                                                      np.bincount(low, minlength=CUT + 2)[1:]))), b""))
        return pa.Table.from_batches([_batch(rows)])

    word_answers = settle(packed.select("chunk", "words", "tokens", "lengths", "trains").mapInArrow(ask_words, _ANSWER)
                          .groupBy("bucket").applyInArrow(add_words, _ANSWER))
    sums = _added(word_answers, -1, CUT + 3)
    n_tokens, n_words, seen = int(sums[0]), int(sums[1]), sums[2:]
    unigram = Unigrams(n_tokens, n_words, seen, seen[:CUT] * np.arange(1, CUT + 1)) if n_tokens else None

    def known(c: _Chunk, answers: pa.Table, order, cuts) -> tuple[np.ndarray, np.ndarray]:
        """Count and number of each word of a chunk."""
        by = dict(zip(answers["bucket"].to_pylist(), zip(answers["a"].to_pylist(), answers["b"].to_pylist())))
        count, number = np.zeros(c.v, np.int64), np.zeros(c.v, np.int64)
        for k, i0, i1 in cuts:
            count[order[i0:i1]] = _unzip(by[k][0], np.int64)
            number[order[i0:i1]] = _unzip(by[k][1], np.int64)
        return count, number

    n_starts = packed.agg(F.sum(F.size(F.filter("trains", lambda x: x)))).first()[0] or 0

    def dealt(count, number, h, w) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each pair, and whether its history is spread: by history, and by word, too, over more buckets the more frequent the history is."""
        of_history = np.append(count, n_starts)[h]
        spread = np.clip(4 * of_history * buckets // max(n_tokens, 1), 1, buckets)
        numbers = np.append(number, 0)
        return ((_mix(numbers[h]) % np.uint64(buckets)).astype(np.int64)
                + (_mix(numbers[w] + 7) % spread.astype(np.uint64)).astype(np.int64)) % buckets, spread > 1

    # pairs: question, sum, answer
    def ask_pairs(_, own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in own.to_pylist():
            c = _Chunk(row)
            count, number = known(c, answers, *_by_bucket(c.word_buckets(buckets)))
            h, w, _, n = c.pairs()
            bucket, spread = dealt(count, number, h, w)
            order, cuts = _by_bucket(bucket)
            for k, i0, i1 in cuts:
                o = order[i0:i1]
                numbers = np.append(number, 0)
                rows.append((row["chunk"], k, _zip(np.stack((np.diff(numbers[h[o]], prepend=0), numbers[w[o]]))),
                             _zip(np.stack((n[o], count[w[o]], spread[o].astype(np.int64))))))
        return pa.Table.from_batches([_batch(rows)])

    def add_pairs(group: pa.Table) -> pa.Table:
        """Answers: count of each pair asked for; tokens by class and unigram mass of each of their histories. Row -1: counts of counts. Row -2: the parts of spread histories. Row -3: the table."""
        bucket = group["bucket"][0].as_py()
        key, val, names = [], [], group["chunk"].to_pylist()
        for a, b in zip(group["a"].to_pylist(), group["b"].to_pylist()):
            k = _unzip(a, np.int64).reshape(2, -1)
            key.append(np.stack((np.cumsum(k[0]), k[1])))
            val.append(_unzip(b, np.int64).reshape(3, -1))
        sizes = [k.shape[1] for k in key]
        key, val = np.concatenate(key, axis=1), np.concatenate(val, axis=1)
        order = np.lexsort((key[1], key[0]))
        h, w = key[0][order], key[1][order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
        opens = np.flatnonzero(new)
        pair = np.cumsum(new) - 1
        n = np.add.reduceat(val[0][order], opens)
        c_word, spread = val[1][order][opens], val[2][order][opens].astype(bool)
        h, w = h[opens], w[opens]
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        first_h, of_h = np.flatnonzero(new_h), np.cumsum(new_h) - 1
        mass = np.add.reduceat(_mass(n), first_h)
        seen_mass = np.add.reduceat(np.where(n > 0, unigram(c_word), 0.0), first_h) if unigram else np.zeros(len(first_h))
        stats = np.column_stack((mass, seen_mass))
        back = np.empty(len(order), np.int64)
        back[order] = pair
        rows, at = [], 0
        for ch, size in zip(names, sizes):
            p = back[at:at + size]
            at += size
            asked_h = of_h[p]
            asked_h = asked_h[np.concatenate(([True], asked_h[1:] != asked_h[:-1]))]
            rows.append((ch, bucket, _zip(n[p]), _zip(stats[asked_h])))
        rows.append((-1, bucket, _zip(np.bincount(n[n <= CUT + 1], minlength=CUT + 2)[1:]), b""))
        hot = spread[first_h]
        rows.append((-2, bucket, _zip(h[first_h][hot]), _zip(stats[hot])))
        rows.append((-3, bucket, _zip(np.stack((h, w, n))[:, n > 0]), b""))
        return pa.Table.from_batches([_batch(rows)])

    own = packed.select("chunk", "tokens", "words", "lengths", "trains")
    pair_answers = settle(own.groupBy("chunk").cogroup(word_answers.where("chunk >= 0").groupBy("chunk"))
                          .applyInArrow(ask_pairs, _ANSWER)
                          .groupBy("bucket").applyInArrow(add_pairs, _ANSWER))
    factor = discounts(_added(pair_answers, -1, CUT + 1)) if n_tokens else None
    # a spread history has over 1 / (4 * buckets) of all tokens, so there are fewer than 4 * buckets of them
    hot: dict[int, np.ndarray] = {}
    for r in pair_answers.where("chunk = -2").select("a", "b").toLocalIterator():
        for h, s in zip(_unzip(r["a"], np.int64).tolist(), _unzip(r["b"], float).reshape(-1, CUT + 2)):
            hot[h] = hot[h] + s if h in hot else s
    shared = spark.sparkContext.broadcast(hot)

    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("train_tokens", T.LongType()),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def finish(_, own: pa.Table, answers: pa.Table) -> pa.Table:
        kind = answers["words"].to_numpy(zero_copy_only=False).astype(bool)
        words, pairs = answers.filter(pa.array(kind)), answers.filter(pa.array(~kind))
        out = []
        for i, row in enumerate(own.to_pylist()):
            c = _Chunk(row)
            count, number = known(c, words, *_by_bucket(c.word_buckets(buckets)))
            h, w, of, _ = c.pairs()
            bucket, spread = dealt(count, number, h, w)
            order, cuts = _by_bucket(bucket)
            by = dict(zip(pairs["bucket"].to_pylist(), zip(pairs["a"].to_pylist(), pairs["b"].to_pylist())))
            log, numbers = np.zeros(len(h)), np.append(number, 0)
            for k, i0, i1 in cuts if unigram else ():
                o = order[i0:i1]
                n, stats = _unzip(by[k][0], np.int64), _unzip(by[k][1], float).reshape(-1, CUT + 2).copy()
                opens = np.concatenate(([True], h[o[1:]] != h[o[:-1]]))
                for j in np.flatnonzero(spread[o[opens]]).tolist():
                    stats[j] = shared.value[int(numbers[h[o[opens][j]]])]
                weight, divisor = (x[np.cumsum(opens) - 1] for x in backoff(stats[:, :-1], stats[:, -1], factor))
                seen_p = n * factor[np.minimum(n, CUT + 1)] / np.maximum(divisor, 1)
                log[o] = np.log10(np.where(n > 0, seen_p, weight * unigram(count[w[o]])))
            base = np.log10((count + 0.1) / (n_tokens + 0.1 * (n_words + 1)))
            first = np.cumsum(c.lengths) - c.lengths
            ids = own["ids"].combine_chunks() if isinstance(own["ids"], pa.ChunkedArray) else own["ids"]
            out.append(pa.RecordBatch.from_arrays(
                [ids[i].values, pa.array(c.lengths), pa.array(np.add.reduceat((count > 0)[c.tokens].astype(np.int64), first)),
                 pa.array(np.full(len(first), n_tokens)), pa.array(np.add.reduceat(base[c.tokens], first)),
                 pa.array(np.add.reduceat(log[of], first))], names=schema.names))
        return pa.Table.from_batches(out)

    answers = (word_answers.withColumn("words", F.lit(True)).unionAll(pair_answers.withColumn("words", F.lit(False)))
               .where("chunk >= 0"))
    return (packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema)
            .withColumnRenamed("_id", id_col))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()),
                                       pa.array(c[3], pa.binary())], names=["chunk", "bucket", "a", "b"])


def _added(answers: DataFrame, kind: int, width: int) -> np.ndarray:
    """Sum of the small vectors that every bucket has (one row each, read one after the other)."""
    total = np.zeros(width, np.int64)
    for r in answers.where(F.col("chunk") == kind).select("a").toLocalIterator():
        total += _unzip(r["a"], np.int64)
    return total
