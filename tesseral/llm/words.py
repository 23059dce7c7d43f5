"""Words of whole Arrow text columns in numpy: spans, 64-bit hashes and rows, without a Python object per word."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_FOLD = U(0xD6E8FEB86659FD93)
#: For 0 to 8 bytes that are left of a word, the bits of a little-endian number that they fill.
_LEFT = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)
#: Longer words are hashed one by one.
LONG_WORD = 512
#: Bytes of text that are handled at once; a longer row is cut at separators, a longer word is not cut.
BLOCK = 1 << 19


def byte_table(separators: bytes) -> np.ndarray:
    """For each byte 0 if it separates words, else its A-Z-lower-cased value plus one (of 16 bits)."""
    table = np.arange(1, 257, dtype=np.uint16)
    table[ord("A") + 0 : ord("Z") + 1] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: Words are runs of anything but ASCII white space.
SPACED = byte_table(b"\x20\t\n\x0b\x0c\r")
#: Words are runs of digits, a-z and non-ASCII characters, after lower-casing A-Z.
ALNUM = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit of x."""
    x = x ^ U((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its length, and its bytes by eights, each mixed into those before (no sum of powers,
    whose structure lets regular words collide). Words of up to eight bytes never collide with words of their length."""
    padded = np.zeros(len(lower) + 8, np.uint8)
    padded[: len(lower)] = lower
    eights = np.ndarray(len(lower) + 1, "<u8", padded, strides=(1,))
    length = ends - starts
    out = mix(length.astype(U), 9)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(lower[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    left, k = np.flatnonzero(length <= LONG_WORD), 0
    while len(left):
        rest = length[left] - k
        out[left] = mix(out[left] ^ (eights[starts[left] + k] & _LEFT[np.minimum(rest, 8)]))
        k += 8
        left = left[rest > 8]
    return out


def equal_words(one: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes of ``one`` from a and of ``other`` from b are equal over a length, for arrays of places and lengths."""
    eights = []
    for data in (one, other):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eights.append(np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)))
    same = np.ones(len(length), bool)
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        same[i] = np.array_equal(one[a[i] : a[i] + length[i]], other[b[i] : b[i] + length[i]])
    left, k = np.flatnonzero(length <= LONG_WORD), 0
    while len(left):
        rest = length[left] - k
        same[left] &= ((eights[0][a[left] + k] ^ eights[1][b[left] + k]) & _LEFT[np.minimum(rest, 8)]) == 0
        k += 8
        left = left[rest > 8]
    return same


def text_slices(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of pieces of about ``limit`` bytes of a string column; nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of rows that lie one after another in data."""
    parts, at, n, size = [], 0, len(data), BLOCK
    while at < n:
        end = min(n, at + size)
        if end < n:  # cut after a separator or between rows
            gap = np.flatnonzero(table[data[at:end]] == 0)
            row = offsets[np.searchsorted(offsets, end, "right") - 1]
            cut = max(at + int(gap[-1]) + 1 if len(gap) else at, int(row))
            if cut <= at:
                size *= 2
                continue
            end = cut
        size = BLOCK
        codes = table[data[at:end]]
        word = codes > 0
        fresh = np.zeros(end - at, bool)
        rows = offsets[(offsets >= at) & (offsets < end)] - at
        fresh[rows] = True
        fresh[0] = True
        starts = np.flatnonzero(word & (fresh | np.concatenate(([True], ~word[:-1]))))
        over = np.concatenate((~word[1:] | fresh[1:], [True]))
        ends = np.flatnonzero(word & over) + 1
        parts.append((starts + at, ends + at, word_hashes((codes - 1).astype(np.uint8), starts, ends)))
        at = end
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for the n words that start at each word, where as many are left."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.full(m, U(n))
    for k in range(n):
        out = (out * _FOLD) ^ hashes[k : k + m]
        out ^= out >> U(29)
    return mix(out)
