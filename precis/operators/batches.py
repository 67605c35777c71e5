"""Helpers of the row-local Arrow kernels: tokens of a whole batch as integer codes, and batches in parts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART = 512  # rows handled at once: bounds a kernel's working memory


def bytes_through(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts with every byte replaced by ``table`` (256 bytes); null texts are empty."""
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    changed = table[np.frombuffer(data, np.uint8)[at[0]:at[-1]]] if data else np.zeros(0, np.uint8)
    return type(texts).from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(changed))


def token_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Code and text number of every token of space-separated texts, and how many codes there are (1 at least)."""
    split = pc.ascii_split_whitespace(texts)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy())
    words = split.flatten()
    filled = pc.greater(pc.binary_length(words), 0)  # white space at an edge leaves an empty piece
    coded = words.filter(filled).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return codes, owner[filled.to_numpy(zero_copy_only=False)], max(1, len(coded.dictionary))


def _joined(parts: list[pa.Array]) -> pa.Array:
    """The parts as one array. What they have freed goes back to the system: workers outlive their task and serve other
    steps, so each would keep the most that any step took, and ever more of it in pieces too small to be used again."""
    out = parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
    parts.clear()
    pa.default_memory_pool().release_unused()
    return out


def in_parts(kernel):
    """``kernel`` (arrays of equal length to one array) over PART rows after the other."""
    def run(*columns: pa.Array) -> pa.Array:
        n = len(columns[0])
        parts = [kernel(*[c.slice(at, PART) for c in columns]) for at in range(0, max(n, 1), PART)]
        return _joined(parts)
    return run


def in_slices(kernel, most: int = 200_000):
    """``kernel`` (array of lists to one array) over slices of rows with about ``most`` elements, one row at least."""
    def run(lists: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        parts, at = [], 0
        while at < len(lists) or not parts:
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            parts.append(kernel(lists.slice(at, stop - at)))
            at = stop
        return _joined(parts)
    return run
