"""Arrow string columns as flat numpy code-point buffers.

Everything that has to look at single characters works on these buffers, a
slice of rows at a time, so that no Python call is made per row or character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import unicodedata

import numpy as np
import pyarrow as pa

MAX_CP = 0x110000


def row_slices(lengths: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose summed length stays near ``limit``.

    A single row longer than ``limit`` forms a range of its own; no row is cut.
    """
    total = np.cumsum(lengths)
    start, n = 0, len(lengths)
    while start < n:
        done = total[start - 1] if start else 0
        end = int(np.searchsorted(total, done + limit, side="right"))
        end = max(end, start + 1)
        yield start, end
        start = end


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, row offsets of length n + 1) of a string column; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(off):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, row offsets in code points) of UTF-8 bytes with row offsets in bytes."""
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
    return cps, lead[offsets]


def rows_to_strings(cps: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The inverse of :func:`code_points`: a string array from code points and row offsets."""
    size = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    data = cps.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    mask = None
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    off = at[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(off.tobytes()), pa.py_buffer(data), mask).cast(pa.string())


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Per code point: 1 letter, 2 number, 3 white space, 0 anything else."""
    kinds = np.zeros(MAX_CP, np.uint8)
    for cp in range(MAX_CP):
        major = unicodedata.category(chr(cp))[0]
        if major == "L":
            kinds[cp] = 1
        elif major == "N":
            kinds[cp] = 2
    # the White_Space property
    kinds[[0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)]] = 3
    return kinds
