"""Compatibility-fold to ASCII (NFKD, then drop every non-ASCII code point).

Spark has no Unicode normaliser, so this is the one Python step of cleaning. It is an
Arrow UDF over whole batches and runs in pyarrow's C++ kernels (no per-row Python).
pyarrow's tables are one Unicode version newer than CPython 3.13's: 36 code points added
in Unicode 16 (U+1CCD6 ... ) fold to letters here and to nothing in CPython.

The UDF is declared nondeterministic on purpose: a deterministic Python UDF is planned
twice when a later filter is pushed through it (also through an aggregate). Apply native
filters *before* calling it so they still reach the Parquet scan.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators.batches import in_parts


def _fold_part(arr: pa.Array) -> pa.Array:
    if len(arr) == 0:
        return arr
    # ASCII-only rows are returned untouched (a CASE WHEN around a Python UDF
    # does not stop it from being evaluated, so the early exit lives here).
    non_ascii = pc.invert(pc.fill_null(pc.string_is_ascii(arr), True))
    if not pc.any(non_ascii).as_py():
        return arr
    folded = pc.replace_substring_regex(
        pc.utf8_normalize(arr.filter(non_ascii), form="NFKD"), pattern="[^\\x00-\\x7F]+", replacement=""
    )
    return pc.replace_with_mask(arr, non_ascii, folded)


_fold_array = in_parts(_fold_part)
_fold_array.__name__ = "_fold_array"  # its name in plans
_FOLD_UDF = F.arrow_udf(_fold_array, StringType()).asNondeterministic()


def fold_ascii(col: Column) -> Column:
    return _FOLD_UDF(col)


def fold_python(text: str | None) -> str | None:
    """Plain-Python statement of the rule, for tests."""
    import unicodedata

    if text is None:
        return None
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
