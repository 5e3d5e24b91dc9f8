"""Vectorised text kernels shared by the operators that run in Arrow batches.

A batch of texts is handled as one UTF-8 buffer plus document offsets, so that
splitting into words and hashing them are a handful of numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z are lower case: digits, letters, all non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of `[^\x20\x09-\x0D]`.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, so that every bit depends on all of them."""
    h = h ^ (h >> U(33))
    h *= _MIX1
    h ^= h >> U(29)
    h *= _MIX2
    h ^= h >> U(32)
    return h


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 17, 1 << int(n - 1).bit_length())
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[:] = tables
    return _powers


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text; a longer text stands alone."""
    _, at = text_buffer(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        yield row, end
        row = end


def split_words(data: np.ndarray, at: np.ndarray, wordbyte: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and n+1 word offsets of the documents."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = wordbyte[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = at[:-1][at[1:] > at[:-1]], at[1:][at[1:] > at[:-1]] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """64-bit hashes of the byte spans, which are in order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    for i in range(0, len(starts), step):
        s, e = starts[i : i + step], ends[i : i + step]
        low = int(s[0])
        n = int(e[-1]) - low
        powers, inverse = _power_tables(n + 1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data[low : low + n]] * powers[:n], out=total[1:])
        h = (total[e - low] - total[s - low]) * inverse[s - low]
        out[i : i + step] = mix(h + (e - s).astype(np.uint64) * _MIX2)
    return out


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words with A-Z lower-cased."""
    return hash_spans(LOWER[data], starts, ends)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and their document offsets.

    A document of fewer words, but not none, has one shingle of all its words.
    """
    n = np.diff(at)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    to = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(to[-1]) + np.repeat(at[:-1] - to[:-1], count)
    short = np.repeat(n, count)
    out = np.zeros(to[-1], dtype=np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for j in range(k):
        part = padded[first + j] * U((_BASE * (2 * j + 3)) % (1 << 64) | 1)
        out += part if j == 0 else np.where(j < short, part, U(0))
    return mix(out + np.minimum(short, k).astype(np.uint64)), to


def doc_of(at: np.ndarray) -> np.ndarray:
    """Document number of every item, from the n+1 offsets."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
