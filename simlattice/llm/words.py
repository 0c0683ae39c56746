"""Words of whole text columns as NumPy arrays, inside Arrow batches.

A word is a run of bytes other than space and 0x09-0x0D. Words and shingles
are known by 64-bit hashes; two different ones among 10**9 share a hash with a
probability of about 3 %, two of one document of 10**5 words with 10**-9.
Null texts count as empty. Work arrays take about 40 bytes per byte of text,
so batches are cut into chunks of ``CHUNK`` bytes (a longer document is a
chunk of its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BYTE_SEED = np.uint64(0xD6E8FEB86659FD93)
_SLOTS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of every row; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Row ranges ``(first, last)`` of at most ``size`` bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + np.uint8(32) * ((data >= 65) & (data <= 90))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses the end of a row."""
    n = len(data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:n]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every byte span, equal for equal bytes wherever they stand."""
    powers = np.full(len(data) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    table = mix(np.arange(1, 257, dtype=np.uint64) * _BYTE_SEED)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers[:-1], out=sums[1:])
    powers[1:] = _BASE_INVERSE
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * powers[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every ``size``-word window; a shorter text is one window."""
    counts = np.bincount(rows, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    place = np.arange(len(words)) - first[rows]
    windows = np.flatnonzero(place + size <= counts[rows])
    value = np.zeros(len(windows), np.uint64)
    for j in range(size):
        value += words[windows + j] * _SLOTS[j % 5]
    short = np.flatnonzero((place == 0) & (counts[rows] < size))
    length = counts[rows[short]]
    whole = length.astype(np.uint64)
    for j in range(size - 1):
        has = np.flatnonzero(length > j)
        whole[has] += words[short[has] + j] * _SLOTS[j % 5]
    return mix(np.concatenate([value, whole])), np.concatenate([rows[windows], rows[short]])
