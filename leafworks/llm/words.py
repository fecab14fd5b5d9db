"""Whole-batch tokenising and hashing of UTF-8 texts with numpy, for use inside Spark tasks."""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa

U64 = np.uint64
_K1, _K2, _K3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_LANE = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=U64)

#: Separators: space and \x09-\x0D.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Separators: all of ASCII but digits and letters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> U64(30))
    h = h * _K2
    h ^= h >> U64(27)
    h *= _K3
    h ^= h >> U64(31)
    return h


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end, and len + 1 offsets; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, dtype=np.uint8)
    return raw, at - at[0]


class Words:
    """Words of a batch of texts: start and end (bytes), first[i]:first[i+1] are those of text i. cuts: bytes before which a word ends too."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, separators: np.ndarray = BLANK, cuts: np.ndarray | None = None):
        self.raw, self.at = raw, at
        n = len(raw)
        inside = ~separators[raw]
        edge = np.zeros(n + 1, dtype=bool)
        if cuts is not None:
            edge[:-1] = cuts
        edge[at] = True
        before, after = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[:1], after[-1:] = False, False
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text's number of every word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def only(self, which: np.ndarray) -> Words:
        """Some of the words, for hashes alone."""
        some = copy.copy(self)
        some.start, some.end = self.start[which], self.end[which]
        return some

    def hashes(self, lower: bool = False, seed: int = 0) -> np.ndarray:
        """64-bit hashes of the words' bytes, eight bytes at a time."""
        raw = LOWER[self.raw] if lower else self.raw
        padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
        lanes = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        size = self.end - self.start
        h = (size.astype(U64) + U64(seed * 2 + 1)) * _K1
        rest, at, who = size.copy(), self.start.copy(), slice(None)
        while True:
            lane = lanes[at] & _LANE[np.minimum(rest, 8)]
            h[who] = mix((h[who] ^ lane) * _K1)
            more = np.flatnonzero(rest > 8)
            if not len(more):
                return h
            who = more if isinstance(who, slice) else who[more]
            rest, at = rest[more] - 8, at[more] + 8

    def windows(self, k: int) -> np.ndarray:
        """The numbers of the words at which k consecutive words of one text start."""
        here = np.arange(len(self.start))
        return here[here + k <= np.repeat(self.first[1:], self.count)]


def sequence_hashes(h: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive word hashes from each start."""
    out = np.full(len(start), k, dtype=U64) * _K1
    for i in range(k):
        out = (out + h[start + i]) * _K2
        out ^= out >> U64(29)
    return mix(out)


def span_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of values over [start, end)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[end] - total[start]


def covered(n: int, start: np.ndarray, k: int) -> np.ndarray:
    """Which of n places lie in a window of k places from one of the starts."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + k, -1)
    return np.cumsum(step[:-1]) > 0


def counting(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, end to end."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
