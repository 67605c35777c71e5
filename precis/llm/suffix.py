"""Suffix-array removal of repeated byte strings.

Spark brings together what may repeat. Every window of ``length`` bytes has an anchor: its smallest hashed ``ANCHOR``-gram
(the leftmost of equals), which depends on the window's bytes alone, so equal windows have equal anchors at equal
places. Consecutive windows of one anchor are a run; its region is the bytes they cover. Runs whose anchor occurs
once hold nothing repeated. Equal regions of an anchor are one class, with a count; classes of anchors that have several
are dealt out by anchor, and each task builds the suffix array of its share. An anchor with more than SHARE bytes of
classes (a short notice between ever other text) is dealt on by its windows instead: by the bytes that STEP windows
next to each other have in common, and where those are found twice, by whole windows.

The suffix array is sorted in two stages: only suffixes smaller than their successors are sorted directly (to
``length`` bytes, by groups of 8 bytes, skipping what a whole group shares), the rest are induced by one scan over the
buckets of first bytes. Suffixes that start no window (the last bytes of each region, four fifths of most) are left out,
but for those that others are induced from. Adjacent common prefixes then show the windows that occur twice. Regions, not texts, lie in a
task, so a very long text or a large group of copies is spread like anything else."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, settle, texts

ANCHOR = 160
_SLICE = 1 << 20  # bytes of text looked at once: so few that their hashes stay near the core; positions take 24 bits
SHARE = 2 << 20  # bytes of regions for one suffix array
STEP = 16  # windows of a region that are first dealt together
_GAP = b"\xff"  # between regions; never part of UTF-8


# ---- anchors ------------------------------------------------------------------------------------------------------

def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on."""
    n = len(data) - 7
    h = np.ndarray((n,), "<u8", data, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
    done = 8
    while done < size:
        step = min(done, size - done)
        n -= step
        x = h[:n] ^ (h[:n] >> np.uint64(31))
        x *= np.uint64(0xC2B2AE3D27D4EB4F)
        x += h[step:step + n]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x165667B19E3779F9)
        h, done = x, done + step
    return h ^ (h >> np.uint64(32))


def _anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each position's gram, and the anchor's position for each window."""
    h = _gram_hashes(data, gram)
    width, n = length - gram + 1, len(h)
    low = np.uint64((1 << 24) - 1)
    key = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    key[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    blocks = key.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - length + 1
    return h, (np.minimum(after[:windows], before[width - 1:width - 1 + windows]) & low).astype(np.int64)


def _runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Runs of windows with one anchor, for texts lying one after the other: text, first window, last window (as
    positions in ``data``), anchor hash."""
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h, at = _anchors(data, length, gram)
    start = np.arange(len(at))
    text = np.searchsorted(ends, start, side="right")
    whole = start + length <= ends[text]
    edge = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])
                                          | (whole[1:] != whole[:-1]))))
    last = np.append(edge[1:], len(at)) - 1
    ok = whole[edge]
    edge, last = edge[ok], last[ok]
    return text[edge], edge, last, h[at[edge]]


def runs(docs: DataFrame, length: int, gram: int = ANCHOR) -> DataFrame:
    """``docs`` (_key binary, _text) -> (anchor, region, key, first, last): region is a hash of the run's bytes."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("region", T.LongType()),
                           T.StructField("key", T.BinaryType()), T.StructField("first", T.LongType()),
                           T.StructField("last", T.LongType())])

    def slices(batch):
        """(row numbers, offsets in their texts, texts): about _SLICE bytes at once, texts whole or cut with overlap."""
        rows, offsets, held, size = [], [], [], 0
        for i, t in enumerate(texts(batch.column(1))):
            for at in range(0, max(1, len(t) - length + 1), _SLICE // 2):
                part = t[at:at + _SLICE // 2 + length - 1]
                if len(part) < length:
                    continue
                rows.append(i), offsets.append(at), held.append(part)
                size += len(part)
                if size > _SLICE // 2:
                    yield rows, offsets, held
                    rows, offsets, held, size = [], [], [], 0
        if held:
            yield rows, offsets, held

    def run(batches):
        for b in batches:
            for rows, offsets, held in slices(b):
                joined = b"".join(held)
                ends = np.cumsum([len(x) for x in held])
                text, first, last, anchor = _runs(np.frombuffer(joined, np.uint8), ends, length, gram)
                region = [xxhash.xxh64_intdigest(joined[i:j]) for i, j in
                          zip(first.tolist(), (last + length).tolist())]
                move = (np.array(offsets) - (ends - [len(x) for x in held]))[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(np.array(region, np.uint64).view(np.int64)),
                     b.column(0).take(pa.array(np.array(rows, np.int64)[text])),
                     pa.array(first + move), pa.array(last + move)], names=schema.names)

    return docs.select("_key", "_text").mapInArrow(run, schema)


# ---- suffix array -------------------------------------------------------------------------------------------------

def _smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    out = np.zeros(n, bool)  # the last run: its shorter suffix is a prefix of the longer, thus smaller
    if len(change):
        sizes = np.diff(np.concatenate(([0], change + 1)))
        out[:change[-1] + 1] = np.repeat(text[change] < text[change + 1], sizes)
    return out


def _sorted_directly(words: np.ndarray, pos: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes. ``words``: 8 bytes from each position on, big-endian."""
    if not len(pos):
        return pos
    key = words[pos].astype(np.uint64)
    order = np.argsort(key)
    out, key = pos[order], key[order]
    index, p = np.arange(len(out)), out
    opens = np.concatenate(([True], key[1:] != key[:-1]))
    at = np.full(len(p), 8)
    rounds = 0
    while True:
        starts = np.flatnonzero(opens)
        sizes = np.diff(np.append(starts, len(p)))
        many = (sizes > 1) & (at[starts] < depth)
        inside = np.repeat(many, sizes)
        index, p, at, sizes = index[inside], p[inside], at[inside], sizes[many]
        if not len(p):
            return out
        starts = np.cumsum(sizes) - sizes
        rounds += 1
        shared = np.zeros(len(sizes), np.int64)
        if rounds > 2:  # words that a whole group shares are skipped, eight at most
            head = np.repeat(p[starts] + at[starts], sizes)
            mine, same, count = p + at, np.ones(len(p), bool), np.zeros(len(p), np.int8)
            for j in range(0, 64, 8):
                same &= words[mine + j] == words[head + j]
                count += same
            shared = np.minimum.reduceat(count, starts).astype(np.int64)
            at = at + 8 * np.repeat(shared, sizes)
        opens = np.zeros(len(p), bool)
        opens[starts] = True
        split = np.repeat(shared < 8, sizes)
        if split.any():
            q, group = p[split], np.repeat(np.arange(len(sizes)), sizes)[split]
            key = words[q + at[split]].astype(np.uint64)
            order = np.lexsort((key, group))
            q, key = q[order], key[order]
            p = p.copy()
            p[split] = q
            out[index[split]] = q
            opens[split] |= np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
            at = at + 8 * split


def _needed(wanted: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """The ``wanted`` suffixes and those that they are induced from: one that is no smaller than its successor needs that."""
    at = np.arange(len(wanted))
    direct = np.maximum.accumulate(np.where(smaller, at, -1))
    return np.maximum.accumulate(np.where(wanted, at, -1)) > np.concatenate(([-1], direct))[:-1]


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """All suffixes of ``text`` in order of at least their first ``depth`` bytes; with ``wanted`` (whether each suffix is) those
    alone and the few they are induced from."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(depth + 80, np.uint8)))
    words = np.ndarray((n + depth + 72,), ">u8", padded, 0, (1,))
    smaller = _smaller_than_next(text)
    needed = np.ones(n, bool) if wanted is None else _needed(wanted, smaller)
    direct = _sorted_directly(words, np.flatnonzero(smaller & needed), depth)
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced = [[] for _ in range(256)]
    if n and needed[n - 1]:
        induced[text[n - 1]].append(np.array([n - 1]))  # the suffix before the empty one
    done = []
    for c in range(256):
        layer = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        parts = []
        while len(layer):  # runs of one byte induce within their own bucket
            parts.append(layer)
            layer = layer[layer > 0] - 1
            layer = layer[(text[layer] == c) & needed[layer]]
        parts.append(direct[bounds[c]:bounds[c + 1]])
        bucket = np.concatenate(parts)
        done.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = text[before]
        up = (byte > c) & needed[before]
        before, byte = before[up], byte[up]
        if len(before):
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cuts = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
            for a, b in zip(cuts, np.append(cuts[1:], len(byte))):
                induced[byte[a]].append(before[a:b])
    return np.concatenate(done)


def repeated_windows(regions: list[bytes], length: int) -> list[np.ndarray]:
    """For each region the starts of the ``length``-byte windows that occur more than once in all regions."""
    sizes = np.array([len(r) for r in regions])
    text = np.frombuffer(b"".join(r + _GAP for r in regions), np.uint8)
    starts = np.cumsum(sizes + 1) - sizes - 1
    windows = np.maximum(sizes - length + 1, 0)
    whole = np.zeros(len(text), bool)
    whole[ragged(starts, windows)] = True
    order = suffix_array(text, length, whole)
    pairs = np.flatnonzero(whole[order[1:]] & whole[order[:-1]])
    a, b = order[pairs], order[pairs + 1]
    padded = np.concatenate((text, np.zeros(16, np.uint8)))
    words = np.ndarray((len(text) + 8,), "<u8", padded, 0, (1,))
    for at in [*range(0, length - 7, 8), length - 8]:  # adjacent common prefixes, as far as ``length``
        same = words[a + at] == words[b + at]
        if not same.all():
            a, b = a[same], b[same]
    hit = np.zeros(len(text), bool)
    hit[a] = hit[b] = True
    return [np.flatnonzero(hit[s:s + w]) for s, w in zip(starts, windows)]


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals; those that touch become one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


# ---- Spark --------------------------------------------------------------------------------------------------------

_SPANS = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("region", T.LongType()),
                       T.StructField("starts", T.ArrayType(T.LongType())),
                       T.StructField("ends", T.ArrayType(T.LongType()))])


def _packed_texts(docs: DataFrame, once: bool) -> DataFrame:
    """``docs`` (_key, _text, others) -> the same with the text compressed; ``once``: one row per key and task."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != "_text"] + [T.StructField("_z", T.BinaryType())])
    others = [f.name for f in schema.fields[:-1]]

    def run(batches):
        codec, seen = pa.Codec("zstd"), set()
        for b in batches:
            if once:
                keys = b.column("_key").to_pylist()
                new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
                b = b.take(pa.array(new, pa.int64()))
            z = [len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True) for t in texts(b.column("_text"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(z, pa.binary())],
                                             names=schema.names)

    return docs.mapInArrow(run, schema)


def _unpacked(z: bytes) -> bytes:
    n = int.from_bytes(z[:8], "little")
    return pa.Codec("zstd").decompress(z[8:], n, asbytes=True) if n else b""


def _cut_regions(joined: DataFrame, length: int, shares: int) -> DataFrame:
    """(_z, parts) -> (share, anchor, region, bytes)."""
    schema = T.StructType([T.StructField("share", T.IntegerType()), T.StructField("anchor", T.LongType()),
                           T.StructField("region", T.LongType()), T.StructField("bytes", T.BinaryType())])

    def run(batches):
        for b in batches:
            for z, parts in zip(b.column(0), b.column(1)):
                t, parts = _unpacked(z.as_py()), parts.values
                anchor = parts.field("anchor").to_numpy()
                share = ((anchor.view(np.uint64) >> np.uint64(7)) % np.uint64(shares)).astype(np.int32)
                cut = [t[i:j + length] for i, j in zip(parts.field("first").to_pylist(), parts.field("last").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(share), pa.array(anchor), parts.field("region"), pa.array(cut, pa.binary())],
                    names=schema.names)

    return joined.select("_z", "parts").mapInArrow(run, schema)


def _steps(length: int, gram: int) -> list[tuple[int, int]]:
    """First and last place of the anchor in the windows dealt together, 60 steps at most."""
    width = length - gram
    step = max(STEP, -(-(width + 1) // 60))
    return [(a, min(a + step - 1, width)) for a in range(0, width + 1, step)]


def _deal_windows(joined: DataFrame, length: int, gram: int, whole: bool) -> DataFrame:
    """(_z, parts) -> (anchor, region, at, hash): for each step of a region a hash of what its windows have in common (at:
    the step); ``whole``: for each window of the steps of ``parts.steps`` its own (at: its start in the region)."""
    schema = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("region", T.LongType()),
                           T.StructField("at", T.IntegerType()), T.StructField("hash", T.BinaryType())])
    steps = _steps(length, gram)

    def table_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))],
            names=schema.names)

    def run(batches):
        for b in batches:
            for z, parts in zip(b.column(0), b.column(1)):
                t, rows = _unpacked(z.as_py()), []
                for part in (p.as_py() for p in parts.values):
                    r = t[part["first"]:part["last"] + length]
                    at = int(_anchors(np.frombuffer(r[:length], np.uint8), length, gram)[1][0])  # of all its windows
                    last = part["last"] - part["first"]
                    for k, (a, e) in enumerate(steps):
                        low, high = max(0, at - e), min(last, at - a)  # starts of the windows of the step
                        if low > high or not part["steps"] >> k & 1:
                            continue
                        cuts = [(i, r[i:i + length]) for i in range(low, high + 1)] if whole else [
                            (k, k.to_bytes(1, "little") + r[at - a:at - e + length])]
                        rows += [(part["anchor"], part["region"], i, xxhash.xxh3_128_digest(c)) for i, c in cuts]
                    if len(rows) > 1 << 16:
                        yield table_of(rows)
                        rows = []
                if rows:
                    yield table_of(rows)

    dealt = settle(joined.select("_z", "parts").mapInArrow(run, schema).distinct())  # copies in several tasks
    often = dealt.groupBy(F.col("hash").alias("_h")).agg(F.count("*").alias("n")).where("n > 1").select("_h")
    return dealt.join(often, F.col("hash") == F.col("_h")).drop("_h")


def _found_by_windows(packed: DataFrame, parts: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans as in ``repeated_spans``'s ``found`` for the classes of ``parts`` (key, part), in tasks of any size."""
    def joined(rows, steps):
        by_key = rows.groupBy("key").agg(F.collect_list(F.struct("part.*", steps.alias("steps"))).alias("parts"))
        return packed.join(by_key, F.col("_key") == F.col("key"))

    steps = _deal_windows(joined(parts, F.lit(-1).cast("bigint")), length, gram, whole=False)
    steps = steps.groupBy(F.col("anchor").alias("_a"), F.col("region").alias("_r")).agg(
        F.expr("bit_or(shiftleft(1L, at))").alias("_steps"))
    left = settle(parts.join(steps, (F.col("part.anchor") == F.col("_a")) & (F.col("part.region") == F.col("_r")))
                  .select("key", "part", "_steps"))
    windows = _deal_windows(joined(left, F.col("_steps")), length, gram, whole=True)
    # windows of a region hold its anchor, so repeated ones leave no gap between them
    return windows.groupBy("anchor", "region").agg(
        F.array(F.min("at").cast("bigint")).alias("starts"),
        F.array(F.max("at").cast("bigint") + length).alias("ends"))


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = ANCHOR) -> DataFrame:
    """``docs`` (_key binary: the same for equal texts only, _text) -> (key, starts, ends): for each text with any, the
    maximal byte spans covered by strings of ``length`` bytes that start at another place, too, in any row."""
    empty = docs.sparkSession.createDataFrame([], _SPANS)
    every = settle(runs(docs, length, gram))
    # counts are written first: a join of two plain exchanges is dealt anew where one anchor has very many rows
    often = settle(every.groupBy(F.col("anchor").alias("_a")).agg(F.count("*").alias("n")).where("n > 1").select("_a"))
    every = settle(every.join(often, F.col("anchor") == F.col("_a")).drop("_a"))
    classes = settle(every.groupBy("anchor", "region").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "first", "last")).alias("at")))
    several = settle(classes.groupBy(F.col("anchor").alias("_a")).agg(
        F.count("*").alias("n_classes"), F.sum(F.col("at.last") - F.col("at.first") + length).alias("size")
    ).where("n_classes > 1").select("_a", "size"))
    mixed = settle(classes.join(several, F.col("anchor") == F.col("_a")).select(
        F.col("at.key").alias("key"), F.struct("anchor", "region", "at.first", "at.last").alias("part"), "size"))
    total, most = mixed.agg(F.sum(F.when(F.col("size") <= SHARE, F.col("part.last") - F.col("part.first") + length)),
                            F.max("size")).first()
    packed = _packed_texts(docs.select("_key", "_text"), once=True)
    found = empty
    if total:
        shares = -(-total // SHARE)
        parts = mixed.where(F.col("size") <= SHARE).groupBy("key").agg(
            F.collect_list("part").alias("parts"))  # at most one for each text byte
        cut = _cut_regions(packed.join(parts, F.col("_key") == F.col("key")), length, shares)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = {}  # copies in other tasks bring a class more than once
            for b in batches:
                for a, r, t in zip(b["anchor"].to_pylist(), b["region"].to_pylist(), b["bytes"]):
                    if (a, r) not in rows:
                        rows[a, r] = t.as_py()
            out = []
            for (a, r), w in zip(rows, repeated_windows(list(rows.values()), length)):
                if len(w):
                    s, e = _merged(w, w + length)
                    out.append((a, r, s.tolist(), e.tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 4,
                                                (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                names=_SPANS.names)

        found = cut.groupBy("share").applyInArrow(search, _SPANS)
    if most and most > SHARE:
        found = found.unionAll(_found_by_windows(packed, mixed.where(F.col("size") > SHARE).select("key", "part"),
                                                 length, gram))
    single = classes.where("n = 1").select(F.col("anchor").alias("_a"), F.col("region").alias("_r"))
    found = found.join(single, (F.col("anchor") == F.col("_a")) & (F.col("region") == F.col("_r"))).select(*_SPANS.names)
    copies = classes.where("n > 1").select(  # equal regions: repeated from end to end
        "anchor", "region", F.array(F.lit(0).cast("bigint")).alias("starts"),
        F.array(F.col("at.last") - F.col("at.first") + length).alias("ends"))
    spans = settle(found.unionAll(copies))
    placed = (every.join(spans, ["anchor", "region"])
              .select("key", F.inline(F.arrays_zip("starts", "ends")), "first")
              .select("key", (F.col("first") + F.col("starts")).alias("start"),
                      (F.col("first") + F.col("ends")).alias("end")).distinct())
    return placed.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _cleaned(docs: DataFrame, others: list[str], length: int, run, schema: T.StructType) -> DataFrame:
    """Texts with their spans through ``run`` (batches of others, _z, spans)."""
    keyed = docs.withColumn("_key", F.unhex(F.md5(F.coalesce(F.col("_text"), F.lit("")))))
    spans = settle(repeated_spans(keyed.select("_key", "_text"), length))
    packed = _packed_texts(keyed, once=False)
    return (packed.join(spans, F.col("_key") == F.col("key"), "left").select(*others, "_z", "spans")
            .mapInArrow(run, schema))


def _kept(text: bytes, spans) -> tuple[bytes, int]:
    """The text without the spans, and how many maximal runs were taken out."""
    if not len(spans):
        return text, 0
    flat = spans.flatten()
    s, e = _merged(flat[0].to_numpy(), flat[1].to_numpy())
    edges = np.concatenate(([0], np.stack((s, e), 1).ravel(), [len(text)])).tolist()
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])), len(s)


def _parts(batch):
    for z, spans in zip(batch.column("_z"), batch.column("spans")):
        t = _unpacked(z.as_py())
        yield t, *_kept(t, spans.values if spans.is_valid else ())


def removal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(``id_col``, n_bytes, n_removed, n_spans, kept_sha256) for every row, see ``repeated_spans``. Null texts are empty;
    texts shorter than ``length`` keep all; rows repeated, with one id or several, repeat each other's strings; an
    empty table gives an empty result."""
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        for b in batches:
            rows = [(len(t), len(t) - len(k), n, hashlib.sha256(k).hexdigest()) for t, k, n in _parts(b)]
            n, gone, spans, sha = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [b.column("_id"), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(sha, pa.string())],
                names=schema.names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return _cleaned(rows, ["_id"], length, run, schema).withColumnRenamed("_id", id_col)


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text_col``, all other columns as they are. What a cut leaves of a
    character goes; null texts stay null."""
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(c) for c in others], F.lit(0)).alias("_rest"),
                       F.col(text_col).isNull().alias("_null"), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema["_rest"], T.StructField("_kept", T.StringType())])

    def run(batches):
        for b in batches:
            kept = [None if null else k.decode("utf-8", "ignore")
                    for null, (_, k, _) in zip(b.column("_null").to_pylist(), _parts(b))]
            yield pa.RecordBatch.from_arrays([b.column("_rest"), pa.array(kept, pa.string())], names=schema.names)

    out = _cleaned(rows, ["_rest", "_null"], length, run, schema)
    return out.select(*[F.col("_kept").alias(c) if c == text_col else F.col("_rest")[c].alias(c) for c in docs.columns])
