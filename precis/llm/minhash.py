"""b-bit MinHash near-duplicates.

A document is the set of its distinct word shingles. ``HASHES`` permutations give its minima; two bits of each minimum
are kept, packed into 8 longs, and bands of whole minima (six at 0.8) give the candidates. The packed signatures estimate the
similarity of a candidate by counting equal two-bit lanes, corrected for the lanes that are equal by chance; what may
reach the threshold (six standard deviations below it at least) is confirmed on the full sets.

Candidates stay far below all pairs of a band's documents. Equal sets collapse to one node first. Each band bucket then
offers only the pairs of its hub (the member with most band mates) with the others. After their links are followed, a
hub whose mates are all connected has nothing to add. The mates of the others carry their exact difference from the
hub's set, from which the similarity of two mates follows without their whole sets; those that are not connected yet
are compared inside the join, by signature, then by differences, and only links come out. So no link between
unconnected texts is lost, and no list of pairs is made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle
from .components import components
from .words import codes, mix, salts, slices, word_lists

HASHES = 256
BITS = 2
MISS = 1e-5  # the most a pair at the threshold may be missed with; 3e-6 with the 42 bands of 6 minima for 0.8
SIGMAS = 6
_BLOCK = 1 << 15
_LANES = 0x5555555555555555
_HASH_MUL = (salts(HASHES, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_HASH_XOR = (salts(HASHES, 12) >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one after the other, and n + 1 offsets. A text with fewer
    words is one shingle; one without words has none."""
    flat, offs = word_lists(texts, lower=True)
    code, hashes = codes(flat)
    words, n = hashes[code], len(code)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    left = offs[1:][owner] - np.arange(n)  # words from here to the end of the text
    mul = salts(shingle + 1, 14)
    x = np.minimum(left, shingle).astype(np.uint64) * mul[-1]
    for k in range(min(shingle, n)):
        x[:n - k] += np.where(left[:n - k] > k, words[k:] * mul[k], np.uint64(0))
    first = np.arange(n) == offs[:-1][owner]
    use = (left >= shingle) | first
    x, owner = mix(x[use]), owner[use]
    starts = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(offs) - 1)))).astype(np.int64)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        x[a:b].sort()
    fresh = np.ones(len(x), bool)
    fresh[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    upto = np.concatenate(([0], np.cumsum(fresh)))
    return x[fresh], upto[starts]


def minima(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts with shingles) x HASHES minima of 32 bits; long sets are taken in blocks."""
    sizes = np.diff(offs)
    starts, sizes = offs[:-1][sizes > 0], sizes[sizes > 0]
    if not len(starts):
        return np.zeros((0, HASHES), np.uint32)
    cuts = np.unique(np.concatenate((starts, np.arange(0, len(sets), _BLOCK))))  # a block holds whole pieces
    out = np.empty((len(cuts), HASHES), np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(sets), _BLOCK):
        block = x[at:at + _BLOCK]
        a, b = np.searchsorted(cuts, (at, at + _BLOCK))
        pieces = cuts[a:b] - at
        for j in range(HASHES):
            out[a:b, j] = np.minimum.reduceat((block ^ _HASH_XOR[j]) * _HASH_MUL[j], pieces)
    return np.minimum.reduceat(out, np.searchsorted(cuts, starts), axis=0)


def band_width(percent: int) -> int:
    """Most minima in a band with which a pair at the threshold shares a band but for a chance of ``MISS``."""
    return max([r for r in range(1, 17) if (1 - (percent / 100) ** r) ** (HASHES // r) <= MISS], default=1)


def signatures(low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of minima: the packed low bits (8 longs a text) and the keys of the bands of ``width`` minima."""
    v = low ^ (low >> np.uint32(16))  # the low bits must not follow the order of the minima
    v = (v * np.uint32(0x85EBCA6B)) ^ _HASH_XOR
    v = (v ^ (v >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    lanes = ((v >> np.uint32(16)) & np.uint32((1 << BITS) - 1)).astype(np.uint64)
    per = 64 // BITS
    packed = np.bitwise_or.reduce(
        lanes.reshape(-1, HASHES // per, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)
    bands = HASHES // width
    grouped = low[:, :bands * width].reshape(-1, bands, width).astype(np.uint64)
    keys = mix((grouped * salts(bands * width, 13).reshape(bands, width)).sum(axis=2, dtype=np.uint64) + salts(bands, 15))
    return packed.view(np.int64), keys.view(np.int64)


def _longs(flat: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat.view(np.int64)))


def _sketches(docs: DataFrame, shingle: int, width: int) -> DataFrame:
    """(_id, _digest, _text) -> (_id, _digest, n, hi, lo, sig, bands); hi, lo: 128-bit hash of the set, n: its size."""
    long = T.LongType()
    schema = T.StructType([docs.schema["_id"], T.StructField("_digest", long), T.StructField("n", long),
                           T.StructField("hi", long), T.StructField("lo", long),
                           T.StructField("sig", T.ArrayType(long)), T.StructField("bands", T.ArrayType(long))])

    def run(batches):
        for whole in batches:
            for b in slices(whole, 2):
                sets, offs = shingle_sets(b.column(2), shingle)
                sizes = np.diff(offs)
                raw, at = sets.view(np.uint8), (offs * 8).tolist()
                keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(at[:-1], at[1:])),
                                     ">i8").astype(np.int64).reshape(-1, 2)
                packed, bands = signatures(minima(sets, offs), width)
                some = np.concatenate(([0], np.cumsum(sizes > 0)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                     _longs(packed.ravel(), some * packed.shape[1]), _longs(bands.ravel(), some * bands.shape[1])],
                    names=schema.names)

    return docs.mapInArrow(run, schema)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, _text) -> (node, shingles)."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), _longs(*shingle_sets(b.column(1), shingle))],
                                                 names=schema.names)

    return texts.mapInArrow(run, schema)


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from two packed signatures: equal lanes, less those that are equal by chance."""
    differ = None
    for i in range(HASHES * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        ones = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_LANES)))
        differ = ones if differ is None else differ + ones
    chance = 1 / (1 << BITS)
    return ((F.lit(float(HASHES)) - differ) / HASHES - chance) / (1 - chance)


def _cut(percent: int) -> float:
    """The least estimate that a pair at the threshold may have."""
    s, chance = percent / 100, 1 / (1 << BITS)
    equal = chance + (1 - chance) * s
    return s - SIGMAS * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def _may_link(percent: int, n1: Column, sig1: Column, n2: Column, sig2: Column) -> Column:
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (estimate(sig1, sig2) >= _cut(percent))


def _node_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the nodes ``wanted``: only their texts are read into sets again."""
    of = nodes.join(wanted, "node").select("node", F.col("low._id").alias("_i"), F.col("low._digest").alias("_d"))
    found = docs.join(of, docs["_id"].eqNullSafe(of["_i"]) & (docs["_digest"] == of["_d"])).select("node", "_text")
    return settle(_sets(found.dropDuplicates(["node"]), shingle))


def _reaches(percent: int, nu: Column, nv: Column, differ: Column) -> Column:
    """Whether sets of these sizes that differ in so many elements reach the threshold."""
    return 100 * (nu + nv - differ) >= percent * (nu + nv + differ)


def _links(nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (u, v) between nodes that connect whatever the links of all pairs would connect."""
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    rows = settle(rows.join(shared, "key"))
    mates = rows.groupBy("node").agg(F.sum("size").alias("mates"))
    rows = rows.select("key", "node").join(mates, "node")
    hubs = rows.groupBy("key").agg(F.max(F.struct("mates", "node")).alias("hub"))
    rows = settle(rows.join(hubs, "key").select(F.col("hub.node").alias("hub"), "node").where("node <> hub").distinct())

    left = nodes.select(F.col("node").alias("hub"), F.col("n").alias("nu"), F.col("sig").alias("su"))
    right = nodes.select("node", F.col("n").alias("nv"), F.col("sig").alias("sv"))
    near = _may_link(percent, F.col("nu"), F.col("su"), F.col("nv"), F.col("sv"))
    stars = settle(rows.join(left, "hub").join(right, "node").where(near).select("hub", "node", "nu", "nv"))
    sets = _node_sets(stars.select("node").unionAll(stars.select("hub")).distinct(), nodes, docs, shingle)
    of_hub = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("h"))
    both = F.size(F.array_intersect("h", "shingles"))
    first = settle(stars.join(of_hub, "hub").join(sets, "node")
                   .where(_reaches(percent, F.col("nu"), F.col("nv"), F.col("nu") + F.col("nv") - 2 * both))
                   .select(F.col("hub").alias("u"), F.col("node").alias("v")))

    rows = rows.join(components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("hub").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 < r2").select("hub")
    rows = settle(rows.join(mixed, "hub").select("hub", "node", "root"))
    sets = _node_sets(rows.select("node").unionAll(rows.select("hub")).distinct(), nodes, docs, shingle)
    of_hub = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("h"))
    differs = F.concat(F.array_except("h", "shingles"), F.array_except("shingles", "h"))
    rows = settle(rows.join(of_hub, "hub").join(sets, "node").select("hub", "node", "root", differs.alias("d"))
                  .join(nodes.select("node", "n", "sig"), "node"))
    a, b = (rows.select(*[F.col(c).alias(c + side) for c in rows.columns]) for side in "uv")
    sym = F.size("du") + F.size("dv") - 2 * F.size(F.array_intersect("du", "dv"))
    rest = a.join(b, (F.col("hubu") == F.col("hubv")) & (F.col("nodeu") < F.col("nodev")) & (F.col("rootu") != F.col("rootv"))
                  & _may_link(percent, F.col("nu"), F.col("sigu"), F.col("nv"), F.col("sigv"))
                  & _reaches(percent, F.col("nu"), F.col("nv"), sym))
    return settle(first.unionAll(rest.select(F.col("nodeu").alias("u"), F.col("nodev").alias("v")).distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id`` (the smallest id reachable) and ``kept``
    (the row's id is that id).

    Documents are linked where their shingle sets have 100 * intersection >= percent * union. Null, empty and blank
    texts have no shingles and link with nothing, not even each other; texts of fewer words than a shingle are one
    shingle. Repeated rows are rows of their own with the same result. Null ids do not count for ``component_id``
    (null if the component has no other, which keeps its rows); an empty table gives an empty result. Columns beside
    the two named are not looked at."""
    docs = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_digest"), F.col(text_col).alias("_text"))
    rows = settle(_sketches(docs, shingle, band_width(percent)))
    nodes = settle(
        rows.where("n > 0").groupBy("hi", "lo").agg(
            F.min(F.struct("_id", "_digest")).alias("low"), F.min("_id").alias("least"), F.first("n").alias("n"),
            F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()))
    roots = components(_links(nodes, docs, shingle, percent))
    named = nodes.select("hi", "lo", "node", "least").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "root").select("hi", "lo", "component_id")
    out = rows.select("_id", "n", "hi", "lo").join(named, ["hi", "lo"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                         percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component (see ``near_duplicates``); ids must be distinct and
    not null for one row a component to stay. Columns stay as they are, whatever their names."""
    kept = near_duplicates(docs, id_col, text_col, shingle, percent).where("kept").select(F.col(id_col).alias("_kept")).distinct()
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"))
    return packed.join(kept, packed["_id"].eqNullSafe(kept["_kept"]), "left_semi").select("_row.*")
