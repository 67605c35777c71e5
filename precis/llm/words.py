"""Words of whole Arrow text columns as flat arrays (A-Z lower-cased on request, split at ASCII white space)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import utf8

SLICE_BYTES = 1 << 22


def slices(batch: pa.RecordBatch, text: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``size`` bytes of text (column number ``text``), one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def word_lists(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """All words, one text after the other, and n + 1 offsets; a null text has none."""
    data, offs = utf8(texts)
    data = data[offs[0]:offs[-1]]  # string kernels get an array of its own: a slice's offsets do not start at 0
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    own = pa.LargeStringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs - offs[0]), pa.py_buffer(data))
    parts = pc.ascii_split_whitespace(own)
    flat, offs = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offs = offs - offs[0]
    real = pc.greater(pc.binary_length(flat), 0)  # white space at the ends of a text splits off empty parts
    upto = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    return flat.filter(real), upto[offs].astype(np.int64)


def codes(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of each word and the 64-bit hash of each numbered word."""
    coded = flat.dictionary_encode()
    words = map(str.encode, coded.dictionary.to_pylist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(coded.dictionary))
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), hashes


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that follow from the seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
