"""Word shingles of whole texts as sorted 64-bit hashes, and their circulant MinHash signatures, on whole Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64 and of its inverse."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for factor in (_BASE, inverse):
        steps = np.full(n, factor, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def _word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words before each text."""
    n = len(data)
    inside = _WORD[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = 1 << max(21, int(n).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def sets(column: pa.Array, words: int, characters: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (null: none).

    Words are runs without ASCII white space, A-Z lower-cased. A shingle is ``words`` words; a
    text of fewer is one shingle as a whole, a text without words has none. Texts are hashed some
    at a time, so memory follows the longest text rather than the batch.
    """
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + characters, "right")) - 1)
        part = data[offsets[low]: offsets[high]]
        bounds = offsets[low: high + 1] - offsets[low]
        hashes, first = _word_hashes(part, bounds) if len(part) else (np.zeros(0, np.uint64), np.zeros(high - low + 1, np.int64))
        whole = len(hashes) - words + 1
        joined = hashes[:max(whole, 0)].copy()
        for k in range(1, words):
            joined = mixed(joined) + hashes[k: k + len(joined)] * np.uint64(2 * k + 1)
        joined = mixed(joined)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= words:
                yield np.unique(joined[a: b - words + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for h in hashes[a:b]:
                    short = mixed(short * _BASE + h)
                yield short
            else:
                yield np.zeros(0, np.uint64)
        low = high


class Circulant:
    """Circulant MinHash: two permutations and circular shifts of one of them give every coordinate.

    The first permutation places shingles in a universe of ``2 ** bits`` dimensions (their hash
    does so at random); the second, ``pi``, is drawn once. Coordinate k of a set is the least
    ``pi[place + k]``, indices taken circularly, so a shingle's values for all coordinates are one
    contiguous slice.
    """

    def __init__(self, coordinates: int, bits: int = 20, seed: int = 7):
        pi = np.random.default_rng(seed).permutation(1 << bits).astype(np.uint32)
        self.slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coordinates]]), coordinates)
        self.coordinates, self.shift = coordinates, np.uint64(64 - bits)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        place = (shingles * _BASE) >> self.shift
        out = np.full(self.coordinates, 0xFFFFFFFF, np.uint32)
        for low in range(0, len(place), 1024):
            np.minimum(out, self.slices[place[low: low + 1024]].min(axis=0), out=out)
        return out

    @staticmethod
    def bands(signatures: np.ndarray, bands: int) -> np.ndarray:
        """One 64-bit key per band for each row of signatures."""
        parts = signatures.reshape(len(signatures), bands, -1).astype(np.uint64)
        key = mixed(np.arange(1, bands + 1, dtype=np.uint64))[None, :]
        for k in range(parts.shape[2]):
            key = mixed(key * _BASE + parts[:, :, k])
        return key.view(np.int64)


@lru_cache(maxsize=2)
def circulant(coordinates: int) -> Circulant:
    return Circulant(coordinates)
