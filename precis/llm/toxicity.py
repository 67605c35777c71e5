"""Toxicity scores from subword-bag embeddings and a linear softmax.

A word is the bag of itself and its character n-grams (word boundaries included), each hashed to one of ``buckets``
embedding rows; unseen misspellings thus share vectors with the words they come from. A passage of ``passage`` words
is the mean of its words' vectors and goes into a two-class linear softmax; a document is as toxic as its worst
passage, so that a few words in a very long text count. Embeddings and softmax are trained together, in numpy on a
bounded sample of labelled documents: first every passage takes its document's label, then only the worst passage.

As everything up to the softmax is linear, a word's share of the logit is one number; scoring looks it up for each
distinct word of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, texts

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STRIP = b".,;:!?\"'()[]{}<>|*-_~`"
_BATCH = 4 << 20


def split_words(text: bytes) -> list[bytes]:
    """Lower-case words without the punctuation around them; punctuation alone stays."""
    return [w.strip(_STRIP) or w for w in text.translate(_LOWER).split()]


def subwords(words: list[bytes], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of all words one after the other, and how many each word has. The n-grams of ``<word>`` are
    byte n-grams, hashed all at once."""
    marked = b"".join(b"<%b>" % w for w in words)
    data = np.frombuffer(marked, np.uint8).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(length) - length
    rows, owner = [], []
    for n in (*sizes, 0):  # 0: the whole word
        if n:
            at = ragged(start, np.maximum(length - n + 1, 0))
            of = np.repeat(np.arange(len(words)), np.maximum(length - n + 1, 0))
            h = np.full(len(at), 1469598103934665603 + n, np.uint64)
            for i in range(n):
                h = (h ^ data[at + i]) * np.uint64(1099511628211)
        else:
            weight = np.cumprod(np.full(int(length.max()) if len(length) else 1, 6364136223846793005, np.uint64))
            inside = np.arange(len(data)) - np.repeat(start, length)
            h = np.add.reduceat(data * weight[inside], start) if len(words) else np.zeros(0, np.uint64)
            of = np.arange(len(words))
        h ^= h >> np.uint64(29)
        rows.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(buckets))
        owner.append(of)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(rows).astype(np.int32)[order], np.bincount(owner, minlength=len(words))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``; every stretch has at least one."""
    return np.add.reduceat(values, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)


class Model:
    """Embedding rows and softmax weights. ``word_logits`` folds them into one number a word."""

    def __init__(self, table: np.ndarray, weights: np.ndarray, bias: np.ndarray, sizes, passage: int):
        self.table, self.weights, self.bias, self.sizes, self.passage = table, weights, bias, sizes, passage

    def word_logits(self, words: list[bytes]) -> np.ndarray:
        rows, counts = subwords(words, self.sizes, len(self.table))
        per_row = self.table @ (self.weights[:, 1] - self.weights[:, 0])
        return _sums(per_row[rows], counts) / np.maximum(counts, 1)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(logits + self.bias[1] - self.bias[0])))


def passages(n_words: int, size: int) -> list[int]:
    """Words of each passage of a text: equal shares of at most ``size``; a text without words is one of none."""
    n = max(1, -(-n_words // size))
    return [n_words * (i + 1) // n - n_words * i // n for i in range(n)]


def train(docs: list[bytes], labels: np.ndarray, dim: int = 8, buckets: int = 1 << 16, sizes=(3, 4, 5),
          passage: int = 4, warm: int = 30, steps: int = 150, rate: float = 0.15, decay: float = 1e-6,
          seed: int = 7) -> Model:
    """Full-batch Adam on the joint loss; classes weigh the same. Without both classes the model says 0.5 or less."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (buckets, dim))
    weights = rng.normal(0, 0.3, (dim, 2))
    bias = np.zeros(2)
    model = Model(table, weights, bias, sizes, passage)
    y = np.asarray(labels, float)
    if not len(y) or not 0 < y.sum() < len(y):
        weights[:], bias[:] = 0, (5.0, 0.0)
        return model
    index: dict[bytes, int] = {}
    tokens, shares, owner = [], [], []
    for i, d in enumerate(docs):
        w = split_words(d)
        tokens += [index.setdefault(x, len(index)) for x in w]
        cut = [n for n in passages(len(w), passage) if n]
        shares += cut
        owner += [i] * len(cut)
    tokens, shares, owner = (np.array(x, np.int32) for x in (tokens, shares, owner))
    distinct = list(index)
    parts = [subwords(distinct[i:i + 50_000], sizes, buckets) for i in range(0, len(distinct), 50_000)]
    rows, per_word = (np.concatenate(x) for x in zip(*parts))
    del index, distinct, parts
    in_doc = np.bincount(owner, minlength=len(y))
    firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    class_weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    memory = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, weights, bias)]
    for step in range(1, steps + 1):
        slope = weights[:, 1] - weights[:, 0]
        word = _sums((table @ slope)[rows], per_word) / per_word
        z = _sums(word[tokens], shares) / shares + bias[1] - bias[0]
        if step <= warm:
            g = (1 / (1 + np.exp(-z)) - y[owner]) * (class_weight / np.maximum(in_doc, 1))[owner]
        else:  # the worst passage of each document
            top = np.maximum.reduceat(z, firsts)
            worst = z == np.repeat(top, in_doc[in_doc > 0])
            g = np.where(worst, (1 / (1 + np.exp(-z)) - y[owner]) * class_weight[owner], 0)
            g /= np.bincount(owner, worst, len(y))[owner]
        per_token = np.repeat(g / shares, shares)
        on_word = np.bincount(tokens, per_token, len(per_word)) / per_word
        on_row = np.bincount(rows, np.repeat(on_word, per_word), buckets)
        d_slope = table.T @ on_row
        grads = (np.outer(on_row, slope) + decay * table, np.stack((-d_slope, d_slope), 1) + decay * weights,
                 np.array((-g.sum(), g.sum())))
        for p, d, m in zip((table, weights, bias), grads, memory):
            m[0] = 0.9 * m[0] + 0.1 * d
            m[1] = 0.99 * m[1] + 0.01 * d * d
            p -= rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-9) * (0.3 if p is weights else 1)
    return model


def fit(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", per_class: int = 1500, **settings) -> Model:
    """Train on a sample of the labelled rows that ``trains`` (over ``id_col``) selects: ``per_class`` documents of each
    label at most, those whose hashed id is smallest. The sample (2 * per_class texts) goes to the driver."""
    known = (labels.where(trains & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
             .withColumn("_order", F.xxhash64("_id")))
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy("_order", "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    sample = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
              .join(F.broadcast(chosen), "_id")  # 2 * per_class rows
              .select("_text", "_y", "_order"))
    rows = sorted((r["_order"], r["_text"] or "", r["_y"]) for r in sample.toLocalIterator())
    return train([t.encode() for _, t, _ in rows], np.array([y for _, _, y in rows]), **settings)


def _scorer(m: Model, max_words: int):
    """Probabilities of many texts; remembers the logits of up to ``max_words`` words, then starts anew."""
    memory: dict[bytes, float] = {}

    def logits(held: list[list[bytes]]) -> np.ndarray:
        words = [w for ws in held for w in ws]
        new = [w for w in dict.fromkeys(words) if w not in memory]
        if len(memory) + len(new) > max_words:
            memory.clear()
            new = list(dict.fromkeys(words))
        for at in range(0, len(new), 50_000):
            part = new[at:at + 50_000]
            memory.update(zip(part, m.word_logits(part).tolist()))
        values = np.fromiter(map(memory.__getitem__, words), float, len(words))
        n = np.fromiter(map(len, held), np.int64, len(held))
        parts = np.maximum(1, -(-n // m.passage))
        i = ragged(np.zeros(len(n), np.int64), parts)
        of = np.repeat(np.arange(len(n)), parts)
        size = n[of] * (i + 1) // parts[of] - n[of] * i // parts[of]
        total = np.concatenate(([0.0], np.cumsum(values)))
        ends = np.cumsum(size)
        z = (total[ends] - total[ends - size]) / np.maximum(size, 1)
        return np.maximum.reduceat(z, np.cumsum(parts) - parts)

    def probabilities(docs) -> np.ndarray:
        out, held, size = [], [], 0
        for d in docs:
            held.append(split_words(d))
            size += len(d)
            if size > _BATCH:
                out.append(logits(held))
                held, size = [], 0
        if held:
            out.append(logits(held))
        return m.probability(np.concatenate(out) if out else np.zeros(0))

    return probabilities


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          max_words: int = 500_000) -> DataFrame:
    """``id_col`` and ``score``, one row per row: probability of the worst passage of the whole text. Null, empty and
    blank texts get the probability of a passage of no words. Repeated rows stay; other columns go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets * dim numbers
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches):
        probabilities = _scorer(shared.value, max_words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(probabilities(texts(b.column(1))))],
                                             names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7,
               max_words: int = 500_000) -> DataFrame:
    """The rows of ``docs`` whose score is under ``threshold``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    at = docs.columns.index(text_col)

    def run(batches):
        probabilities = _scorer(shared.value, max_words)
        for b in batches:
            low = probabilities(texts(b.column(0).field(at))) < threshold
            yield b.filter(pa.array(low))

    return packed.mapInArrow(run, packed.schema).select("_row.*")
