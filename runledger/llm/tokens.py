"""Words of Arrow string batches as numpy arrays: spans, 64-bit hashes, hashes of word windows.

A batch is cut into pieces of a few MB so that the arrays made per byte stay small;
only a text that is longer by itself makes a larger piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, about.
PIECE = 1 << 20
LONG_WORD = 512
_BASE = 0x9E3779B97F4A7C15 | 1
_LANES = np.array([0x8C2F9D71A4E35B06, 0x51D7348EC96A0BF2], dtype=np.uint64)
#: Masks of the first 0 to 8 bytes of a little-endian number.
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 1)
        tables = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            t = np.full(n, b, dtype=np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers


@dataclass
class Words:
    """The words of ``rows`` texts; text i has words first[i] to first[i + 1]."""

    data: np.ndarray  # the bytes
    offsets: np.ndarray  # text i is data[offsets[i]:offsets[i + 1]]
    start: np.ndarray  # byte span of each word in data
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lane: int = 0) -> np.ndarray:
        """A 64-bit hash of each word's bytes; the two lanes are independent of each other.

        Eight bytes at a time go through a mixing step that is no polynomial, so no pattern of letters makes words collide
        but by the chance of random numbers. Words beyond LONG_WORD bytes are hashed by BLAKE2b.
        """
        key = _LANES[lane]
        size = self.end - self.start
        out = mix64(size.astype(np.uint64) + key)
        longer = np.flatnonzero(size > LONG_WORD)
        todo = np.flatnonzero(size <= LONG_WORD) if len(longer) else np.arange(len(size))
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eights = np.ndarray((len(self.data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
        at, step = self.start, 0
        while len(todo):
            x = eights[at[todo] + 8 * step]
            left = size[todo] - 8 * step
            x &= _LOW_BYTES[np.minimum(left, 8)]
            out[todo] = mix64(out[todo] ^ mix64(x + key))
            todo, step = todo[left > 8], step + 1
        for i in longer.tolist():
            digest = hashlib.blake2b(self.data[self.start[i] : self.end[i]], digest_size=16).digest()
            out[i] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
        return out


def split_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words are maximal runs of bytes that are not white space; none crosses a text's border."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = data[lo:hi]
    offsets = (offsets - lo).astype(np.int64)
    word = ~_IS_SPACE[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    before = np.empty_like(word)
    if len(word):
        before[0] = False
        before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | border[:-1]))
    after = np.empty_like(word)
    if len(word):
        after[-1] = False
        after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | border[1:])) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)), offsets.astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batches with the words of their column text_at."""
    for batch in batches:
        data, offsets = text_buffers(batch.column(text_at))
        a, n = 0, batch.num_rows
        while a < n:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
            b = min(b, n)
            yield batch.slice(a, b - a), split_words(data, offsets[a : b + 1])
            a = b


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words of the flat array (runs across texts are the caller's to drop)."""
    if len(words) < k:
        return np.empty(0, dtype=np.uint64)
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out *= np.uint64(0xD1342543DE82EF95)
        out += words[j : len(words) - k + 1 + j]
    return mix64(out)


def windows_inside(first: np.ndarray, k: int) -> np.ndarray:
    """Marks, for flat windows 0 .. n - k, those that lie within one text."""
    n = int(first[-1])
    ok = np.ones(max(0, n - k + 1), dtype=bool)
    for e in np.unique(first[1:-1]):  # a border between texts
        ok[max(0, e - k + 1) : e] = False
    return ok


def repeats(keys: np.ndarray, group: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does an equal one stand in its group, and does an equal one stand earlier there? other: a second hash to be equal too."""
    order = np.argsort(mix64(keys ^ mix64(group.astype(np.uint64))), kind="stable")
    k, g = keys[order], group[order]
    same = (k[1:] == k[:-1]) & (g[1:] == g[:-1])
    if other is not None:
        same &= other[order][1:] == other[order][:-1]
    anywhere, earlier = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    earlier[order[1:]] = same
    anywhere[order[1:]] = same
    anywhere[order[:-1]] |= same
    return anywhere, earlier
