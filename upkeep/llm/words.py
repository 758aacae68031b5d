"""Vectorised word and byte hashing over Arrow string columns (used inside tasks).

All functions work on one flat ``uint8`` buffer that holds many texts one after the
other plus the offsets between them, so their cost is a few nanoseconds a byte and
no Python loop runs over words. Buffers are cut at text borders into slices of about
``SLICE`` bytes; only a single longer text makes a longer slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LETTER_OR_DIGIT = np.zeros(256, bool)
_LETTER_OR_DIGIT[48:58] = _LETTER_OR_DIGIT[97:123] = _LETTER_OR_DIGIT[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base & (2**64 - 1)
    return np.multiply.accumulate(out)


_POWER: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; grown by doubling and kept."""
    if len(_POWER.get("up", ())) < n:
        m = max(n, SLICE + 1024)
        _POWER["up"], _POWER["down"] = _powers(_BASE, m), _powers(_INVERSE, m)
    return _POWER["up"][:n], _POWER["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; the argument is overwritten."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one text after the other, and the n + 1 offsets.

    Null and empty texts both have no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at least one row whose texts hold about ``most`` bytes together."""
    i, n = 0, len(at) - 1
    while i < n:
        j = int(np.searchsorted(at, at[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def words(
    flat: np.ndarray, at: np.ndarray, kind: np.ndarray = ~_SPACE, lower: bool = True
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of every text: 64-bit hashes, byte starts, byte ends, and n + 1 word offsets.

    A word is a longest run of bytes for which ``kind`` holds, after lower-casing A-Z;
    it never crosses a text border. Empty texts have no words.
    """
    n = len(flat)
    if lower:
        flat = _LOWER[flat]
    inside = kind[flat]
    border = np.zeros(n + 1, bool)
    border[at] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    after = np.zeros(n + 1, bool)
    after[:-1] = inside
    starts = np.flatnonzero(after & (~before | border))
    ends = np.flatnonzero(before & (~after | border))
    hashes = spans(flat, starts, ends)
    return hashes, starts, ends, np.searchsorted(starts, at)


def spans(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges that are sorted by start; equal bytes give equal hashes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # by blocks, so that the powers stay short for a very long text
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, low + SLICE)))
        high = int(ends[i:j].max())
        up, down = powers(high - low + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum((flat[low:high].astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        out[i:j] = (total[ends[i:j] - low] - total[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    return mix(out)


def rolling(flat: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all byte strings of length k, in blocks; empty if there are none."""
    n = len(flat) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for low in range(0, n, SLICE):
        high = min(n, low + SLICE)
        part = flat[low : high + k - 1].astype(np.uint64)
        part += np.uint64(1)
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[:-1], out=total[1:])
        out[low:high] = (total[k:] - total[:-k]) * down[: high - low]
    return mix(out)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, for every start but the last k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out *= np.uint64(0x9DDFEA08EB382D69)
        out += hashes[i : i + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values, by doubling."""
    n, have = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    x = x.copy()
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x[:n]


def winnow(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions whose hash is smallest in some window of ``width`` hashes.

    With fewer hashes than ``width`` there are none. Which positions are chosen in a
    window depends on that window alone, so equal windows choose alike.
    """
    low = sliding_min(hashes, width)
    if not len(low):
        return np.zeros(0, np.int64)
    pad = np.zeros(width - 1, hashes.dtype)
    high = ~sliding_min(~np.concatenate([pad, low, pad]), width)
    return np.flatnonzero(high == hashes)
