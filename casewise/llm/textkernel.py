"""Whole-batch text kernels: words, hashes and shingles of an Arrow batch, in NumPy.

A batch's texts lie end to end in one byte buffer with a separator after each, so one
pass over bytes finds all words of all texts. UTF-8 keeps ASCII separators unambiguous.
Work is cut into slices of a bounded number of bytes; a longer single text is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 2 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _letters() -> np.ndarray:
    x = np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_LETTER = _letters()
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)

#: Bytes that belong to a word. SPACED: all but white space. ALNUM: digits, letters, non-ASCII.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    up = _powers(_BASE, 1 << 10)
    down = _powers(_INVERSE, 1 << 10)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)


class Words:
    """Words of a run of texts. ``buf``: lower-cased bytes, a space after each text.

    start, end: byte range of each word; first: index of each text's first word (one more
    entry than texts); hash: 64 bits per word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, lower: bool = True):
        size = np.diff(offsets)
        n = len(size)
        text_end = np.cumsum(size + 1)
        buf = np.full(int(text_end[-1]) if n else 0, 0x20, dtype=np.uint8)
        keep = np.ones(len(buf), dtype=bool)
        keep[text_end - 1] = False
        body = data[offsets[0] : offsets[-1]]
        buf[keep] = _LOWER[body] if lower else body
        self.buf = buf
        self.text_start = text_end - size - 1
        inside = classes[buf]
        inside[text_end - 1] = False
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.concatenate([self.text_start, [len(buf)]]))
        self.text_of = np.repeat(np.arange(n), np.diff(self.first))
        self.n_texts = n

    @property
    def hash(self) -> np.ndarray:
        n = len(self.buf) + 1
        _Powers.reach(n)
        total = np.zeros(n, dtype=U64)
        np.cumsum(_LETTER[self.buf] * _Powers.up[: n - 1], out=total[1:])
        sums = (total[self.end] - total[self.start]) * _Powers.down[self.start]
        return mix(sums + (self.end - self.start).astype(U64))

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def string_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, offsets) of slices of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    kind = np.int64 if wide == pa.large_binary() else np.int32
    column = column.cast(wide).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, raw, values = column.buffers()
    offsets = np.frombuffer(raw, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data, offsets[at : to + 1]
        at = to


def shingle_sets(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, bounds): text i has hashes[bounds[i]:bounds[i+1]], ascending.

    A text of fewer than ``width`` words, but not none, has one shingle: its whole sequence.
    """
    h, n = words.hash, len(words.start)
    odd = mix(np.arange(1, width + 1, dtype=U64)) | U64(1)
    counts = np.diff(words.first)
    if n >= width:
        acc = np.zeros(n - width + 1, dtype=U64)
        for j in range(width):
            acc += h[j : n - width + 1 + j] * odd[j]
        acc = mix(acc)
        whole = words.text_of[: n - width + 1] == words.text_of[width - 1 :]
        acc, owner = acc[whole], words.text_of[: n - width + 1][whole]
    else:
        acc, owner = np.empty(0, U64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), dtype=U64)
        for j in range(width - 1):
            has = counts[short] > j
            extra[has] += h[words.first[short[has]] + j] * odd[j]
        extra = mix(extra + counts[short].astype(U64) * U64(0xD6E8FEB86659FD93))
        owner = np.concatenate([owner, short])
        acc = np.concatenate([acc, extra])
        order = np.argsort(owner, kind="stable")
        owner, acc = owner[order], acc[order]
    bounds = np.searchsorted(owner, np.arange(words.n_texts + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            acc[a:b].sort()
    new = np.ones(len(acc), dtype=bool)
    new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    return acc[new], np.searchsorted(owner[new], np.arange(words.n_texts + 1))
