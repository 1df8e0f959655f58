"""Arrow text columns as flat byte buffers: runs of bytes, words by number, 64-bit keys, and sorted key blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from arborscan.llm.shingles import _powers, mixed

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Keys of blocks keep this many bits of a 64-bit hash, where not said otherwise.
KEY_BITS = 48


def parts(column: pa.Array, characters: int = 1 << 24) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, bounds) of some texts at a time (null: empty), about ``characters`` bytes or one text.

    ``bounds`` has the start of every text and the end of the last, counted from the first byte.
    """
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + characters, "right")) - 1)
        yield low, high, data[offsets[low]: offsets[high]], offsets[low: high + 1] - offsets[low]
        low = high


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes marked ``inside``; a run ends where its text does."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    before[cuts] = False
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
    """The byte ranges as a string column."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    flat = np.ascontiguousarray(data[places])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(flat))


def numbered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """The number of every byte range among the distinct ones, and these."""
    coded = strings(data, starts, lengths).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def hashes(words: pa.StringArray) -> np.ndarray:
    """A 64-bit hash of every string."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset: words.offset + len(words) + 1].astype(np.int64)
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    power, inverse = _powers(1 << max(21, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    starts, ends = offsets[:-1], offsets[1:]
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def slice_bounds(slices: int, bits: int = KEY_BITS) -> np.ndarray:
    """First key of every slice of the range of ``bits``-bit keys, and the end of the last; slices end at multiples of 2 ** (bits - 16)."""
    return (np.arange(slices + 1) * (1 << 16) + slices - 1).astype(np.uint64) // np.uint64(slices) << np.uint64(bits - 16)


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def packed(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys and a 64-bit value each as one compressed block: differences and values, byte by byte."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(_planes(steps) + _planes(np.ascontiguousarray(values, np.int64)))


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    steps, values = (np.ascontiguousarray(half.reshape(8, -1).T).view(np.uint64).ravel() for half in np.split(flat, 2))
    return np.cumsum(steps, dtype=np.uint64), values.view(np.int64)


def sliced(keys: np.ndarray, values: np.ndarray, slices: int, bits: int = KEY_BITS) -> Iterator[tuple[int, bytes]]:
    """(slice, block) of every slice that holds some of the sorted keys."""
    cuts = np.searchsorted(keys, slice_bounds(slices, bits))
    for number in np.flatnonzero(np.diff(cuts)):
        low, high = cuts[number], cuts[number + 1]
        yield int(number), packed(keys[low:high], values[low:high])
