"""Vectorised word and shingle hashing over the buffers of Arrow text batches.

Texts stay UTF-8 bytes.  A batch is cut into chunks of whole rows (about
``CHUNK`` bytes, one very long text makes a chunk of its own), and all passes
over a chunk are numpy passes, so memory is bounded by the chunk and no Python
code runs per word.

Hashes are 64-bit: a polynomial over the bytes (mod 2**64, odd random base),
then a finaliser.  Operators that must be exact compare the texts or the whole
sets afterwards, or say that they rely on 64 or 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK = 1 << 20
_BASE = 0x9E6C63D0876A46AD | 1
_INV = pow(_BASE, -1, 1 << 64)
_POW: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i below n (kept between calls)."""
    if len(_POW[0]) < n:
        size = max(n, CHUNK + 4096)
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(size, base, U64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0][:n], _POW[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift, multiply), in place where it can be."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def ascii_lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = ascii_lower()


def alnum_or_high() -> np.ndarray:
    """Bytes of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z is lower-cased."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = True
    t[0x61:0x7B] = True
    t[0x80:] = True
    return t


def not_space() -> np.ndarray:
    """Bytes of [^\\x20\\x09-\\x0D]+."""
    t = np.ones(256, bool)
    t[0x20] = False
    t[0x09:0x0E] = False
    return t


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its int64 bounds (rows + 1); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def chunks(column: pa.Array, size: int = CHUNK, most: int = 8192) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds from 0) of whole rows, about size bytes and at most so many rows each."""
    if not len(column):
        return
    data, bounds = text_buffer(column)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(bounds, bounds[first] + size, side="right")) - 1
        end = min(max(end, first + 1), first + most, len(column))
        yield first, end, data[bounds[first] : bounds[end]], bounds[first : end + 1] - bounds[first]
        first = end


def word_hashes(low: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word, and the rows' bounds in words (rows + 1).

    low: the chunk's bytes as they count; table: which bytes make words.  Words
    end at the end of their row.
    """
    n = len(low)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = table[low]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    left = np.empty(n, bool)
    left[0], left[1:] = False, inside[:-1]
    left &= ~edge[:n]
    starts = np.flatnonzero(inside & ~left)
    right = np.empty(n, bool)
    right[-1], right[:-1] = False, inside[1:]
    right &= ~edge[1:]
    ends = np.flatnonzero(inside & ~right) + 1
    up, down = powers(n + 1)
    total = np.empty(n + 1, U64)
    total[0] = 0
    np.cumsum((low.astype(U64) + U64(1)) * up[:n], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64)), starts, ends, np.searchsorted(starts, bounds)


_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_at(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position."""
    h = np.full(len(at), k, U64)
    for j in range(k):
        h += words[at + j] * _STEP[j % 8] * U64(2 * (j // 8) + 1)
    return mix(h)


def row_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each item, from the rows' bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int, whole_short: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every k-word shingle, in row order.

    whole_short: a row of 1 to k - 1 words gives one shingle of all its words.
    """
    count = np.diff(bounds)
    row = row_of(bounds)
    at = np.flatnonzero(np.arange(len(words)) + k <= bounds[1:][row])
    h, r = shingle_at(words, at, k), row[at]
    if whole_short and (0 < count).any() and ((0 < count) & (count < k)).any():
        parts = [(h, r, at)]
        for m in range(1, k):
            rows = np.flatnonzero(count == m)
            parts.append((shingle_at(words, bounds[rows], m), rows, bounds[rows]))
        h, r, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(r, kind="stable")
        h, r, at = h[order], r[order], at[order]
    return h, r, at


def packed(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list array from flat values and bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values, kind))
