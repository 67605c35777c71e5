"""SimHash near-duplicates with deletion-variant signatures.

A 64-bit fingerprint is cut into ``max_distance // 2 + 1`` segments: with at most ``max_distance`` differing bits
one segment differs in at most one bit. For every segment and every bit of it, the segment with that bit left out
is a signature; two segments at most one bit apart share one. Distinct fingerprints are joined on equal
signatures and the whole distance is verified inside the join, where a pair is kept only at its first common
signature, so that every link comes out once.

Only distinct fingerprints are joined (copies collapse before), and links never leave the executors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, texts
from .components import components

SEED = 42
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CHUNK = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: bytes, shingle: int) -> int:
    """Signed 64-bit SimHash of the text's word shingles (A-Z lower-cased, split at ASCII white space)."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _CHUNK], stops[at:at + _CHUNK])],
                     dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4,
                 keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``fingerprint`` (bigint, the 64 bits). Null and blank texts: 0. Other columns go."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("fingerprint", T.LongType())])
    n_keep = len(keep)

    def run(batches):
        for b in batches:
            f = np.fromiter((fingerprint(t, shingle) for t in texts(b.column(n_keep))), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], pa.array(f)], names=[*keep, "fingerprint"])

    return docs.select(*keep, text_col).mapInArrow(run, schema)


def _segments(max_distance: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = max_distance // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(first: int, width: int) -> Column:
    value = ((1 << width) - 1) << first
    return F.lit(value - (1 << 64) if value >> 63 else value)


def _first_common(diff: Column, segments: list[tuple[int, int]]) -> Column:
    """Bit number of the first signature that two fingerprints with the XOR ``diff`` share (null: none)."""
    out = F.lit(None).cast("int")
    for first, width in reversed(segments):
        part = diff.bitwiseAND(_mask(first, width))
        ones = F.bit_count(part)
        # with one differing bit: its number = bits set below it (the sign bit apart)
        at = (F.when(ones == 0, F.lit(first)).when((ones == 1) & (part < 0), F.lit(63))
              .when(ones == 1, F.bit_count(part - F.lit(1))))
        out = F.coalesce(at.cast("int"), out)
    return out


def links(prints: DataFrame, max_distance: int = 4) -> DataFrame:
    """``prints`` (fingerprint, distinct) -> (u, v), u < v, each pair at most ``max_distance`` bits apart, once."""
    segments = _segments(max_distance)
    variants = F.array(*[
        F.struct(F.lit(bit).alias("bit"),
                 F.col("fingerprint").bitwiseAND(_mask(first, width)).bitwiseAND(F.lit(_but(bit))).alias("part"))
        for first, width in segments for bit in range(first, first + width)])
    rows = prints.select("fingerprint", F.inline(variants))
    left = rows.select("bit", "part", F.col("fingerprint").alias("u"))
    right = rows.select("bit", "part", F.col("fingerprint").alias("v"))
    diff = F.col("u").bitwiseXOR(F.col("v"))
    return (left.alias("l").join(
        right.alias("r"),
        (F.col("l.bit") == F.col("r.bit")) & (F.col("l.part") == F.col("r.part")) & (F.col("u") < F.col("v"))
        & (F.bit_count(diff) <= max_distance) & (_first_common(diff, segments) == F.col("l.bit")))
        .select("u", "v"))


def _but(bit: int) -> int:
    """All bits but one, signed."""
    return ~(1 << bit) if bit < 63 else (1 << 63) - 1


def _members(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_distance: int) -> DataFrame:
    """(_id, _digest, fingerprint, root, component_id) for every row; _digest is a hash of the text."""
    rows = cut_lineage(fingerprints(
        docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_digest"), F.col(text_col).alias("_text")),
        "_text", shingle, ("_id", "_digest")))
    nodes = cut_lineage(rows.groupBy("fingerprint").agg(F.min("_id").alias("low")))
    roots = components(links(nodes.select("fingerprint"), max_distance))
    linked = nodes.join(roots, nodes.fingerprint == roots.node, "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root"))
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(linked.select("fingerprint", "root").join(lowest, "root"), "fingerprint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_distance: int = 4) -> DataFrame:
    """One row per input row: ``id_col``, ``fingerprint`` (bigint), ``root`` (the component's smallest fingerprint)
    and ``component_id`` (its smallest id).

    Fingerprints at most ``max_distance`` bits apart are linked, links are followed to the end. Blank and null
    texts share fingerprint 0 and are linked like any other; repeated rows and equal texts share a fingerprint;
    an empty table gives an empty result; null ids do not count for ``component_id`` (null if there is no other)."""
    return _members(docs, id_col, text_col, shingle, max_distance).select(
        F.col("_id").alias(id_col), "fingerprint", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                         max_distance: int = 4) -> DataFrame:
    """The rows of ``docs`` with one row kept of each component: the one with its smallest id (of repeated rows,
    one). A component without any id keeps one row as well. Columns stay as they are, whatever their names."""
    found = _members(docs, id_col, text_col, shingle, max_distance)
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_digest")).alias("c"))
    chosen = chosen.select(F.col("c._id").alias("_id"), F.col("c._digest").alias("_digest"))
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col(id_col).alias("_id"),
                         F.xxhash64(text_col).alias("_digest"))
    kept = packed.join(chosen, packed["_id"].eqNullSafe(chosen["_id"]) & (packed["_digest"] == chosen["_digest"]),
                       "left_semi")
    same = Window.partitionBy("_id", "_digest").orderBy("_digest")
    return kept.withColumn("_n", F.row_number().over(same)).where("_n = 1").select("_row.*")
