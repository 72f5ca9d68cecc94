"""Elias-Fano sequences and a two-level n-gram trie made of them.

A sorted sequence keeps its elements' low bits in packed fields and their high bits in unary,
about two bits and log(universe / n) each. Everything lies in flat arrays with a header, so a
trie can be mapped from a file and searched where it lies.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
BLOCK = 8  # words of the unary part between two directory entries


class EliasFano:
    """A non-decreasing sequence of unsigned numbers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, ((top + 1) // max(1, n)).bit_length() - 1)
        at = np.arange(n, dtype=U64) * U64(bits)
        low = np.zeros((n * bits + 63) // 64 + 2, dtype=U64)
        if bits:
            part = values & U64((1 << bits) - 1)
            word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + U64(bits) > U64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (U64(64) - shift[over]))
        size = n + (top >> bits) + 2
        words = -(-size // (64 * BLOCK)) * BLOCK
        unary = np.zeros(words * 64, dtype=np.uint8)
        unary[(values >> U64(bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view(U64)
        return cls(n, bits, low, high, cls._directory(high))

    @staticmethod
    def _directory(high: np.ndarray) -> np.ndarray:
        """Zeros before each block of the unary part."""
        count = 64 * BLOCK - np.bitwise_count(high.reshape(-1, BLOCK)).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(count)])

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the zero number k, from 0."""
        block = np.searchsorted(self.zeros, k, side="right") - 1
        left = k - self.zeros[block]
        words = self.high.reshape(-1, BLOCK)[block]
        before = np.cumsum(64 - np.bitwise_count(words).astype(np.int64), axis=1)
        word = (before <= left[:, None]).sum(axis=1)
        row = np.arange(len(k))
        left = left - np.where(word > 0, before[row, word - 1], 0)
        x, at = ~words[row, word], np.zeros(len(k), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):  # the bit of x with ``left`` ones before it
            ones = np.bitwise_count((x >> at.astype(U64)) & U64((1 << half) - 1)).astype(np.int64)
            on = ones <= left
            at, left = at + half * on, left - ones * on
        return (block * BLOCK + word) * 64 + at

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=U64)
        at = i.astype(U64) * U64(self.low_bits)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        rest = np.where(shift > 0, self.low[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
        return ((self.low[word] >> shift) | rest) & U64((1 << self.low_bits) - 1)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """Elements whose high part is less."""
        out = np.zeros(len(high), dtype=np.int64)
        on = high > 0
        out[on] = self._select_zero(high[on] - 1) - high[on] + 1
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first element that is at least x; n if there is none."""
        if not self.n:
            return np.zeros(len(x), dtype=np.int64)
        last = int(self.zeros[-1]) - 1
        high = np.minimum(x >> U64(self.low_bits), U64(last)).astype(np.int64)
        lo, hi = self._before(high), self._before(np.minimum(high + 1, last))
        beyond = (x >> U64(self.low_bits)) >= U64(last)
        low = x & U64((1 << self.low_bits) - 1)
        going = np.flatnonzero(lo < hi)
        while len(going):
            mid = (lo[going] + hi[going]) >> 1
            less = self._low(mid) < low[going]
            lo[going] = np.where(less, mid + 1, lo[going])
            hi[going] = np.where(less, hi[going], mid)
            going = going[lo[going] < hi[going]]
        lo[beyond] = self.n
        return lo

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements at places i, by a search for the one in the unary part before them."""
        ones = np.arange(len(self.zeros)) * 64 * BLOCK - self.zeros
        block = np.searchsorted(ones, i, side="right") - 1
        left = i - ones[block]
        words = self.high.reshape(-1, BLOCK)[block]
        before = np.cumsum(np.bitwise_count(words).astype(np.int64), axis=1)
        word = (before <= left[:, None]).sum(axis=1)
        row = np.arange(len(i))
        left = left - np.where(word > 0, before[row, word - 1], 0)
        x, at = words[row, word], np.zeros(len(i), dtype=np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count((x >> at.astype(U64)) & U64((1 << half) - 1)).astype(np.int64)
            on = count <= left
            at, left = at + half * on, left - count * on
        high = (block * BLOCK + word) * 64 + at - i
        return (high.astype(U64) << U64(self.low_bits)) | self._low(i)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high)], dtype=U64), self.low, self.high]

    @classmethod
    def read(cls, flat: np.ndarray, at: int) -> tuple[EliasFano, int]:
        n, bits, a, b = (int(v) for v in flat[at : at + 4])
        low, high = flat[at + 4 : at + 4 + a], flat[at + 4 + a : at + 4 + a + b]
        return cls(n, bits, low, high, cls._directory(high)), at + 4 + a + b


STEP = 1 / 4096  # of quantised logarithms


class Trie:
    """Words, and below each the contexts it was seen after, with a quantised value each.

    Level one: the words' keys. Pointers: where each word's contexts begin. Level two:
    contexts relative to their word, as word place * 2**32 + context.
    """

    def __init__(self, words: EliasFano, pointers: EliasFano, contexts: EliasFano, codes: np.ndarray):
        self.words, self.pointers, self.contexts, self.codes = words, pointers, contexts, codes

    @classmethod
    def build(cls, words: np.ndarray, word_of: np.ndarray, context: np.ndarray, value: np.ndarray) -> Trie:
        """words: sorted keys; entries sorted by (word_of, context); value: logarithms from 0 to 15."""
        codes = np.minimum(np.rint(value / STEP), 65535).astype(np.uint16)
        pointers = np.searchsorted(word_of, np.arange(len(words) + 1)).astype(U64)
        return cls(EliasFano.build(words), EliasFano.build(pointers), EliasFano.build((word_of.astype(U64) << U64(32)) | context.astype(U64)), codes)

    def lookup(self, word_at: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Value of each context below the word at a place; 0 for one that wasn't seen."""
        key = (word_at.astype(U64) << U64(32)) | context.astype(U64)
        at = self.contexts.successor(key)
        words, which = np.unique(word_at, return_inverse=True)
        end = self.pointers.get(words + 1).astype(np.int64)[which] if len(words) else at
        found = np.flatnonzero(at < end)
        found = found[self.contexts.get(at[found]) == key[found]]
        out = np.zeros(len(key))
        out[found] = self.codes[at[found]] * STEP
        return out

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Places of words' keys, -1 for an unknown one."""
        at = self.words.successor(keys)
        known = np.flatnonzero(at < self.words.n)
        out = np.full(len(keys), -1, dtype=np.int64)
        known = known[self.words.get(at[known]) == keys[known]]
        out[known] = at[known]
        return out

    def to_bytes(self) -> bytes:
        codes = np.zeros(-(-len(self.codes) // 4) * 4, dtype=np.uint16)
        codes[: len(self.codes)] = self.codes
        head = np.array([len(self.codes)], dtype=U64)
        return np.concatenate([head, *self.words.arrays(), *self.pointers.arrays(), *self.contexts.arrays(), codes.view(U64)]).tobytes()

    @classmethod
    def map(cls, buffer) -> Trie:
        """A trie over bytes where they lie: an ``mmap`` of a file, or a buffer."""
        flat = np.frombuffer(buffer, dtype=U64)
        words, at = EliasFano.read(flat, 1)
        pointers, at = EliasFano.read(flat, at)
        contexts, at = EliasFano.read(flat, at)
        return cls(words, pointers, contexts, flat[at:].view(np.uint16)[: int(flat[0])])
