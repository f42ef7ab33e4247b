"""Adaptive context-mixing range coder for token ids below 2**16, vectorised over independent blocks.

All blocks of a batch advance together, one id per step, each with its own models that start empty. Order 1 and order 2
each predict one id, the one that last followed the context, with a confidence. Which of the two comes true is coded with
frequencies mixed from two adaptive tables, one chosen by the order-2 model's confidence and one by the order-1 model's.
An id that neither predicts follows by the frequencies of order 0: what share of the batch's ids it is. That table is kept
beside the blocks (pack_frequencies), so a block needs nothing but its own words, its number of ids and the table.

The coder is a 64-bit range coder that writes a digit of 32 bits when the width falls below that; digits keep their
carries until the end. A step takes 31 bits at most, so one digit a step is enough and all blocks do the same work. Both
frequency scales are powers of two, so coding divides by shifts.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 512
SLOTS = 8  # bits of a context table
_MASK = (1 << SLOTS) - 1
_DIGIT, _LEAST, _LOW32 = np.uint64(32), np.uint64(1 << 32), np.uint64((1 << 32) - 1)
# Three frequencies are kept in one word, 16 bits each, and always sum to 1 << 14; a product with _ONES makes running sums.
_START = np.uint64(2500 | 2500 << 16 | ((1 << 14) - 5000) << 32)
_ONES, _LOW16, _RATE, _FADED = np.uint64(0x000100010001), np.uint64(0xFFFF), np.uint64(4), np.uint64(0x0FFF0FFF0FFF)
_SHIFTS = np.arange(3, dtype=np.uint64) * np.uint64(16)
_MIXED, _SCALE = np.uint64(15), np.uint64(16)  # bits of the sum of two tables, and of order 0
_BOTH = _MIXED + _SCALE
_FOUR, _FIVE, _ONE64 = np.uint64(4), np.uint64(5), np.uint64(1)
_ONE, _TWO, _THREE = np.uint32(1), np.uint32(2), np.uint32(3)


def frequencies(ids: np.ndarray) -> np.ndarray:
    """For each id below 65,536 its frequency in ids, scaled to a sum of 65,536; at least 1 for an id that occurs."""
    count = np.bincount(ids, minlength=1 << 16).astype(np.int64)
    there = np.flatnonzero(count)
    scaled = np.zeros(1 << 16, np.int64)
    if not len(there):
        return scaled
    spare = (1 << 16) - len(there)
    scaled[there] = 1 + count[there] * spare // count.sum()
    scaled[np.argmax(scaled)] += (1 << 16) - scaled.sum()
    return scaled


def pack_frequencies(scaled: np.ndarray) -> bytes:
    """The table of order 0 as bytes: its length, ids and frequencies less one."""
    there = np.flatnonzero(scaled)
    packed = zlib.compress(np.diff(there, prepend=0).astype("<u2").tobytes() + (scaled[there] - 1).astype("<u2").tobytes(), 6)
    return struct.pack("<II", len(there), len(packed)) + packed


def unpack_frequencies(data: bytes) -> tuple[np.ndarray, int]:
    """The table and how many bytes it took."""
    kinds, size = struct.unpack_from("<II", data)
    plain = zlib.decompress(data[8 : 8 + size])
    scaled = np.zeros(1 << 16, np.int64)
    scaled[np.cumsum(np.frombuffer(plain, "<u2", kinds).astype(np.int64))] = np.frombuffer(plain, "<u2", kinds, 2 * kinds).astype(np.int64) + 1
    return scaled, 8 + size


class _Models:
    """The models of all blocks; rows are blocks. A slot of a context table holds id * 4 + confidence (0 to 3)."""

    def __init__(self, rows: int):
        self.base = np.arange(rows, dtype=np.int64) << SLOTS
        self.slots1, self.slots2 = np.zeros(rows << SLOTS, np.uint32), np.zeros(rows << SLOTS, np.uint32)
        self.mix1, self.mix2 = (np.full(rows * 4, _START) for _ in "ab")
        self.four = np.arange(rows, dtype=np.int64) * 4
        self.last, self.hashed = np.zeros(rows, np.int64), np.zeros(rows, np.int64)

    def predict(self, k: int) -> None:
        """For the first k blocks: slots, predicted ids, frequencies (freq) and their running sums (sums)."""
        last = self.last[:k]
        self.at1 = self.base[:k] + ((last * 0x9E5F) >> 3 & _MASK)
        self.at2 = self.base[:k] + ((last * 0x3D4D51 + self.hashed[:k]) >> 5 & _MASK)
        was1, was2 = self.slots1.take(self.at1, mode="clip"), self.slots2.take(self.at2, mode="clip")
        self.p1, self.p2 = was1 >> _TWO, was2 >> _TWO
        self.sure1, self.sure2 = was1 & _THREE, was2 & _THREE
        self.m1, self.m2 = self.four[:k] + self.sure1, self.four[:k] + self.sure2
        self.f1, self.f2 = self.mix1.take(self.m1, mode="clip"), self.mix2.take(self.m2, mode="clip")
        self.freq = self.f1 + self.f2
        self.sums = self.freq * _ONES

    def update(self, k: int, ids: np.ndarray, shift: np.ndarray) -> None:
        """shift: the place of the coded symbol's frequency in its word."""
        fresh = ids << _TWO
        self.slots1[self.at1] = fresh + np.minimum(self.sure1 + _ONE, _THREE) * (self.p1 == ids)
        self.slots2[self.at2] = fresh + np.minimum(self.sure2 + _ONE, _THREE) * (self.p2 == ids)
        for table, at, now in ((self.mix1, self.m1, self.f1), (self.mix2, self.m2, self.f2)):
            faded = (now >> _RATE) & _FADED
            table[at] = now - faded + (((faded * _ONES) >> _SHIFTS[2] & _LOW16) << shift)
        np.multiply(self.last[:k], 0x1E35A7, out=self.hashed[:k])
        self.last[:k] = ids


def _order0(scaled: np.ndarray) -> np.ndarray:
    """Frequency less one (low 16 bits) and the sum of those before (the next 16) of each id."""
    return ((np.maximum(scaled, 1) - 1) | (np.minimum(np.cumsum(scaled) - scaled, (1 << 16) - 1) << 16)).astype(np.uint64)


def _part(freq: np.ndarray, upto: np.ndarray, miss: np.ndarray, order0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and start, out of 1 << _BOTH, of a symbol's share; for one that nobody predicted, of its id's part of it."""
    missed = freq * miss
    return (freq - missed << _SCALE) + missed * ((order0 & _LOW16) + _ONE64), (upto - freq << _SCALE) + missed * (order0 >> _SCALE)


def encode_blocks(ids: np.ndarray, scaled: np.ndarray) -> list[bytes]:
    """ids (uint16) in blocks of BLOCK_IDS, the last maybe shorter; one byte string for each. scaled: frequencies(ids).

    A digit is 32 bits; bit 32 of what is kept for it says that it carries into the digit before.
    """
    rows = -(-len(ids) // BLOCK_IDS)
    if not rows:
        return []
    whole, rest = divmod(len(ids), BLOCK_IDS)
    grid = np.zeros((BLOCK_IDS, rows), np.uint32)
    grid[:, :whole] = ids[: whole * BLOCK_IDS].reshape(whole, BLOCK_IDS).T
    grid[:rest, whole:] = ids[whole * BLOCK_IDS :][:, None] if rest else grid[:0, whole:]
    table, models = _order0(scaled), _Models(rows)
    all_low, all_width, all_carry = np.zeros(rows, np.uint64), np.full(rows, (1 << 64) - 1, np.uint64), np.zeros(rows, np.uint64)
    room = min(BLOCK_IDS, len(ids)) + 3
    digits, first = np.zeros(rows * room, np.uint64), np.arange(rows, dtype=np.int64) * room
    at = first.copy()
    for t in range(min(BLOCK_IDS, len(ids))):
        k = rows if not rest or t < rest else whole
        low, width, carry, place = all_low[:k], all_width[:k], all_carry[:k], at[:k]
        models.predict(k)
        now = grid[t, :k]
        unlike2 = now != models.p2
        miss = unlike2 & (now != models.p1)
        shift = (unlike2.astype(np.uint64) + miss) << _FOUR
        size, start = _part((models.freq >> shift) & _LOW16, (models.sums >> shift) & _LOW16, miss, table.take(now, mode="clip"))
        width >>= _BOTH
        start *= width
        low += start
        carry |= low < start
        width *= size
        # A digit is written in any case, and stays if the place moves on.
        digits[place] = (low >> _DIGIT) | (carry << _DIGIT)
        out = width < _LEAST
        place += out
        move = out.astype(np.uint64) << _FIVE
        low <<= move
        width <<= move
        carry *= ~out
        models.update(k, now, shift)
    digits[at] = (all_low >> _DIGIT) | (all_carry << _DIGIT)
    digits[at + 1] = all_low & _LOW32
    while len(over := np.flatnonzero(digits >> _DIGIT)):
        digits[over] &= _LOW32
        digits[over - 1] += _ONE64
    return [digits[a : b + 2].astype("<u4").tobytes() for a, b in zip(first.tolist(), at.tolist(), strict=True)]


def decode_blocks(data: np.ndarray, starts: np.ndarray, ids: int, scaled: np.ndarray) -> np.ndarray:
    """The ids of blocks whose digits begin at starts in data (uint32). Damaged data gives other ids, or fails."""
    rows = len(starts)
    if not rows:
        return np.zeros(0, np.uint16)
    whole, rest = divmod(ids, BLOCK_IDS)
    grid = np.zeros((BLOCK_IDS, rows), np.uint16)
    table, named = _order0(scaled), np.repeat(np.arange(len(scaled), dtype=np.uint32), scaled)
    data, at = data.astype(np.uint64), starts.astype(np.int64) + 2
    # What the code exceeds low by is all that decoding needs.
    all_over, all_width = (data[starts] << _DIGIT) | data[np.minimum(starts + 1, len(data) - 1)], np.full(rows, (1 << 64) - 1, np.uint64)
    models = _Models(rows)
    for t in range(min(BLOCK_IDS, ids)):
        k = rows if not rest or t < rest else whole
        over, width, place = all_over[:k], all_width[:k], at[:k]
        models.predict(k)
        width >>= _BOTH
        value = over // width
        high = value >> _SCALE
        unlike2 = high >= (models.sums & _LOW16)
        miss = high >= ((models.sums >> _SHIFTS[1]) & _LOW16)
        shift = (unlike2.astype(np.uint64) + miss) << _FOUR
        freq, upto = (models.freq >> shift) & _LOW16, (models.sums >> shift) & _LOW16
        now = np.where(unlike2, models.p1, models.p2)
        slot = named.take(((value - (upto - freq << _SCALE)) // freq).view(np.int64), mode="clip")
        np.copyto(now, slot, where=miss)
        size, start = _part(freq, upto, miss, table.take(now, mode="clip"))
        over -= start * width
        width *= size
        out = width < _LEAST
        move = out.astype(np.uint64)
        width <<= move << _FIVE
        over <<= move << _FIVE
        over |= data.take(place, mode="clip") * move
        place += out
        grid[t, :k] = now
        models.update(k, now, shift)
    return np.concatenate((grid[:, :whole].T.reshape(-1), grid[:rest, whole] if rest else grid[:0, 0]))
