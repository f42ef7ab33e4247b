"""Vectorised hashing of words and word n-grams of whole texts, for use inside Arrow tasks.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased. Hashes are 64-bit
polynomials over a table of random byte values, mixed at the end; they depend on nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 19

_WIDE = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_bytes = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _WIDE(2) + _WIDE(1)
_bytes[65:91] = _bytes[97:123]
_space = np.zeros(256, bool)
_space[[32, *range(9, 14)]] = True
#: Separators under which words are runs of letters, digits and non-ASCII characters.
MARKS = np.zeros(256, bool)
MARKS[:128] = True
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_powers = [np.ones(1, _WIDE), np.ones(1, _WIDE)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = x.astype(_WIDE, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _WIDE(30)
        x *= _WIDE(0xBF58476D1CE4E5B9)
        x ^= x >> _WIDE(27)
        x *= _WIDE(0x94D049BB133111EB)
        x ^= x >> _WIDE(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, _WIDE)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets) of runs of rows with about CHUNK bytes; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
        last = min(last, n)
        yield first, last, raw[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _space) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the first word of each text (one entry more than texts), and each word's byte span."""
    n = len(data)
    counts = np.zeros(len(offsets), np.int64)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _WIDE), counts, none, none
    inside = ~space[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    starts[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, _WIDE)
        sums[0] = 0
        np.cumsum(_bytes[data] * up[:n], out=sums[1:])
        words = mix((sums[ends] - sums[starts]) * down[starts])
    return words, np.searchsorted(starts, offsets), starts, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashed n-grams in ascending order, and where each text's begin.

    A text with fewer words than size has its whole sequence as one; a text without words has none.
    """
    words, first, _, _ = word_hashes(data, offsets)
    n = np.diff(first)
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(words) - size + 1), _WIDE)
        for k in range(size):
            grams = grams * _WIDE(_BASE) + words[k : k + len(grams)]
        grams = mix(grams + _WIDE(size))
        sets = []
        for k, count in enumerate(n):
            if count >= size:
                own = np.sort(grams[first[k] : first[k] + count - size + 1])
                sets.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif count:
                total = np.zeros(1, _WIDE)
                for w in words[first[k] : first[k] + count]:
                    total = total * _WIDE(_BASE) + w
                sets.append(mix(total + _WIDE(int(count))))
            else:
                sets.append(grams[:0])
    lengths = np.array([len(s) for s in sets], np.int64)
    return np.concatenate(sets) if sets else grams[:0], np.concatenate(([0], np.cumsum(lengths)))
