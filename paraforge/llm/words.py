"""Vectorised word hashes over batches of whole texts.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, which is the
same as ``[^\\x20\\x09-\\x0D]+`` on code points. All functions work on the concatenation of a
bounded slice of texts (``SLICE_BYTES``), so memory does not grow with the batch.

Hashes are polynomial prefix sums modulo 2**64 over randomised byte values, finished with a
64-bit mixer. Whoever needs certainty beyond 64 bits takes two hashes with different seeds.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=8)
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 7919 + 1)) | U64(1)


#: One table a seed, as long as the longest slice so far: a worker that many stages use holds no second copy.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i from 0 to n at least (the base is odd)."""
    if seed not in _POWERS or len(_POWERS[seed][0]) <= n:
        base = int(mix(np.array([seed + 17], dtype=U64))[0]) | 5
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(1 << max(10, int(n).bit_length()), b, dtype=U64)
            steps[0] = 1
            out.append(np.cumprod(steps, dtype=U64))
        _POWERS[seed] = out[0], out[1]
    return _POWERS[seed]


def slices(col: pa.Array, limit: int = SLICE_BYTES):
    """(first row, data bytes, row offsets) for runs of rows of about ``limit`` bytes; a longer
    text is a run of its own. Nulls count as empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if n == 0:
        return
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, raw[off[at]:off[end]], off[at:end + 1] - off[at]
        at = end


def word_spans(data: np.ndarray, off: np.ndarray):
    """Start and end bytes of each word, and the first word of each row (one entry more)."""
    white = (data == 32) | ((data >= 9) & (data <= 13))
    solid = np.zeros(len(data) + 1, dtype=bool)
    solid[:-1] = ~white
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = solid[:-1]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[off] = True  # words never run over the end of a text
    starts = np.flatnonzero(solid & (~before | cut))
    ends = np.flatnonzero(before & (~solid | cut))
    first = np.searchsorted(starts, off)
    return starts, ends, first


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    if len(starts) == 0:
        return np.zeros(0, dtype=U64)
    up, down = powers(seed, len(data))
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_byte_values(seed)[data] * up[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def window_hashes(words: np.ndarray, length: int, seed: int = 1) -> np.ndarray:
    """Hash of words[i:i+length] for each i with a whole window in the array (rows ignored)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    up, down = powers(seed + 101, len(words))
    sums = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return mix((sums[length:] - sums[:n]) * down[:n])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row that each of n words belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Leftmost position of the least of values[s:s+width], for each whole window."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        take = right < left
        best = np.where(take, right, left)
        at = np.where(take, at[step:], at[:-step])
        span += step
    return at[:n]


def as_signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64, copy=False).view(np.int64)
