"""Best-two-fit packing of tokenised documents into sequences of fixed capacity.

Packing looks at lengths only, so the plan is made on the histogram of lengths (at most ``capacity`` numbers,
whatever the size of the corpus). Bins are filled greedily, largest piece first; then a bin's smallest piece is
replaced by the two unpacked pieces that fill its expanded gap best, if they fit more tightly. A bin pattern
is repeated as long as its lengths last, so the plan is a short list of (pattern, repeats), also bounded by
the capacity. Pieces are numbered within their length in Spark, and each looks its place up in the plan."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, settle, shuffle_partitions, texts

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TRAIL = b".,;:!?|"
_SLICE = 2 << 20  # bytes of text tokenised at once

# byte-level alphabet of the tokenizer family: printable bytes stand for themselves, the rest for 256, 257, ..
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


class WordIds:
    """Token ids word by word. The tokenizer drops white space and never joins across it, so the ids of a text
    are those of its words one after the other; each distinct word is tokenised once for each worker.

    Travels to the workers as a broadcast variable (the tokenizer's JSON text); the memory of words is rebuilt
    there. Beyond ``max_words`` it forgets the words met once, so that it stays bounded."""

    def __init__(self, tokenizer_json: str, max_words: int = 400_000):
        self.json, self.max_words, self.tok = tokenizer_json, max_words, None

    def __getstate__(self):
        return {"json": self.json, "max_words": self.max_words, "tok": None}

    def _start(self):
        if self.tok is None:
            from tokenizers import Tokenizer
            self.tok = Tokenizer.from_str(self.json)
            self.tok.encode_special_tokens = True  # added tokens are found in the raw text, before it is lower-cased
            self.added = {}
            for t in json.loads(self.json)["added_tokens"]:
                if t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]:
                    raise ValueError(f"added token {t['content']!r} is not matched as it stands")
                self.added[b" " + t["content"].encode()] = t["id"]  # as a word: the space keeps it apart from all others
            found = b"|".join(re.escape(t[1:]) for t in sorted(self.added, key=len, reverse=True))
            self.split_added = re.compile(b"(" + found + b")").split if found else None
        self.index: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    def _forget(self):
        n = len(self.index)
        kept = np.flatnonzero(self.uses[:n] > 1)
        if len(kept) > self.max_words // 2:
            kept = kept[:0]  # nearly all are frequent: start anew
        words = list(self.index)
        size, uses = self.size[kept], self.uses[kept] // 2
        flat = self.flat[ragged(self.at[kept], size)]
        self._start()
        room = max(1 << 14, 1 << int(len(kept)).bit_length())
        self.at, self.size, self.uses = (np.zeros(room, np.int64) for _ in range(3))
        self.flat, self.used = np.concatenate((flat, np.zeros(1 << 16, np.uint32))), len(flat)
        self.at[:len(kept)], self.size[:len(kept)], self.uses[:len(kept)] = np.cumsum(size) - size, size, uses
        self.index = {words[i]: j for j, i in enumerate(kept.tolist())}

    def _ids(self, word: bytes) -> list[int]:
        if word.isalpha() and word.islower():  # ASCII letters only
            return [t.id for t in self.tok.model.tokenize(word.decode())]
        text = word.decode("utf-8", "replace")
        if text.isalpha() and max(text) < "ɐ" and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return [t.id for t in self.tok.model.tokenize(word.decode("latin-1").translate(_BYTE_CHARS))]
        return self.tok.encode(text, add_special_tokens=False).ids

    def _known(self, word: bytes) -> np.ndarray:
        k = self.index[word] if word in self.index else self._add(word)
        return self.flat[self.at[k]:self.at[k] + self.size[k]]

    def _words(self, text: bytes) -> list[bytes]:
        """The text's lower-cased words; an added token, which splits the text wherever it stands, is a word too."""
        if self.tok is None:
            self._start()
        parts = self.split_added(text) if self.split_added else [text]
        if len(parts) == 1:
            return text.translate(_LOWER).split()
        return [w for i, p in enumerate(parts) for w in ([b" " + p] if i % 2 else p.translate(_LOWER).split())]

    def _add(self, word: bytes) -> int:
        body = word.rstrip(_TRAIL)
        if word in self.added:
            ids = [self.added[word]]
        elif body != word and body[-1:].isalnum():  # an ASCII letter or digit before ASCII punctuation ends a piece
            ids = np.concatenate((self._known(body), self._known(word[len(body):])))
        else:
            ids = self._ids(word)
        k, n = len(self.index), len(ids)
        if k == len(self.at):
            self.at, self.size, self.uses = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.size, self.uses))
        while self.used + n > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used:self.used + n] = ids
        self.at[k], self.size[k] = self.used, n
        self.used += n
        self.index[word] = k
        return k

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each word."""
        if self.tok is None:
            self._start()
        elif len(self.index) > self.max_words:
            self._forget()
        k = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(k < 0).tolist()
        for i in missing:
            w = words[i]
            k[i] = self.index[w] if w in self.index else self._add(w)
        self.uses[:len(self.index)] += np.bincount(k, minlength=len(self.index))
        size = self.size[k]
        return self.flat[ragged(self.at[k], size)], size

    def encode(self, docs) -> "iterator":
        """The ids of each text, in order. Texts are taken together up to some size; long ones go in slices cut at
        white space."""
        words, counts, held = [], [], 0

        def flush():
            ids, size = self._encode(words)
            ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
            return [ids[a:b] for a, b in zip(ends[:-1], ends[1:])]

        for d in docs:
            if len(d) > _SLICE:
                if counts:
                    yield from flush()
                    words, counts, held = [], [], 0
                yield np.concatenate([self._encode(self._words(part))[0] for part in _slices(d)])
                continue
            w = self._words(d)
            words += w
            counts.append(len(w))
            held += len(d)
            if held > _SLICE:
                yield from flush()
                words, counts, held = [], [], 0
        if counts:
            yield from flush()


def _slices(d: bytes):
    at = 0
    while at < len(d):
        end = at + _SLICE
        while end < len(d) and d[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield d[at:end]
        at = end


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenised documents, each followed by ``end_id``, cut into pieces of at most ``capacity`` ids: ``id_col``,
    piece, start, length, ids_crc32 and, if asked for, the ids. The tokenizer file is read on the driver (its
    size is fixed by the vocabulary)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(WordIds(f.read()))
    fields = [T.StructField("_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]

    def run(batches):
        coder = shared.value
        for b in batches:
            row, start, size, crc, held = [], [], [], [], []
            for i, ids in enumerate(coder.encode(texts(b.column(1)))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    part = ids[at:at + capacity]
                    row.append(i), start.append(at), size.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        held.append(part.astype(np.int32))
            start = np.array(start, np.int64)
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array((start // capacity).astype(np.int32)),
                    pa.array(start), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.array(held, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).alias("_id"), text_col).mapInArrow(run, T.StructType(fields))


def plan_bins(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """``counts[n]``: pieces of length n, up to the capacity (its last index). Returns (pattern, repeats): a pattern
    has how many pieces of each length a bin takes, and stands for so many equal bins one after the other."""
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    out = []
    while left[1:].any():
        have = left.copy()
        bin_, gap = {}, capacity
        while gap:
            fits = np.flatnonzero(have[1:gap + 1])
            if not len(fits):
                break
            n = int(fits[-1]) + 1
            take = int(min(have[n], gap // n))
            bin_[n] = bin_.get(n, 0) + take
            have[n] -= take
            gap -= n * take
        first, small = max(bin_), min(bin_)
        if gap and (small != first or bin_[small] > 1):
            pair = _best_pair(have, gap + small)
            if pair is not None and sum(pair) > small:
                bin_[small] -= 1
                for n in pair:
                    bin_[n] = bin_.get(n, 0) + 1
                bin_ = {n: m for n, m in bin_.items() if m}
        k = min(int(left[n]) // m for n, m in bin_.items())
        for n, m in bin_.items():
            left[n] -= k * m
        out.append((bin_, k))
    return out


def _best_pair(have: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum within ``room``."""
    room = min(room, len(have) - 1)
    sizes = np.arange(room + 1)
    below = np.maximum.accumulate(np.where(have[:room + 1] > 0, sizes, 0))  # largest length present up to each
    a = np.flatnonzero(have[:room] > 0)
    a = a[a > 0]
    if not len(a):
        return None
    b = below[room - a]
    alone = (b == a) & (have[a] < 2)
    b = np.where(alone, below[np.maximum(a - 1, 0)], b)
    total = np.where(b > 0, a + b, 0)
    best = int(np.argmax(total))
    return (int(a[best]), int(b[best])) if total[best] else None


def _places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and stretch of its numbering: first number, pieces a bin, first bin and offset, sorted."""
    rows, bins, taken = [], 0, {}
    for pattern, k in plan:
        offset = 0
        for n in sorted(pattern, reverse=True):
            m = pattern[n]
            rows.append((n, taken.get(n, 0), m, bins, offset))
            taken[n] = taken.get(n, 0) + m * k
            offset += m * n
        bins += k
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "number", "each", "bin", "offset"), cols))


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """Pieces (as made by ``pieces``) with ``sequence_id`` and ``offset``: every piece lies whole in one sequence,
    sequences are gapless from 0 and hold at most ``capacity`` ids. An empty table gives an empty result; pieces
    of repeated rows are pieces like any other."""
    spark = cut.sparkSession
    deal = shuffle_partitions(spark)
    # numbering a length: by bucket of a row hash, so that a very common length is no single group
    rows = settle(cut.withColumn("_bucket", F.pmod(F.xxhash64("_id", "piece", "ids_crc32"), F.lit(deal)).cast("int")))
    counts = settle(rows.groupBy("_bucket", "length").agg(F.count("*").alias("n")))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        histogram[r["length"]] = r["n"]
    places = _places(plan_bins(histogram))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_bucket", "length").orderBy("_id", "piece", "ids_crc32")
    numbered = (rows.withColumn("_number", F.row_number().over(inside) - 1)
                .join(first, ["_bucket", "length"])
                .select(*cut.columns, (F.col("_first") + F.col("_number")).alias("_number")))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType())])
    names = schema.names

    def run(batches):
        key = places["length"] << 44 | places["number"]
        for b in batches:
            n, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            p = np.searchsorted(key, n << 44 | number, side="right") - 1
            past = number - places["number"][p]
            each = places["each"][p]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(places["bin"][p] + past // each),
                 pa.array(places["offset"][p] + past % each * n)], names=names)

    return numbered.mapInArrow(run, schema)
