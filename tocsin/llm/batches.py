"""Texts of an Arrow batch as byte arrays: word hashes and character shapes without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_random = np.random.default_rng(20240517)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.uint64(0xD6E8FEB86659FD93 | 1)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WHITE = np.zeros(256, dtype=bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BYTE[_IS_WHITE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(4095, _POWER)]))

#: Bytes handled at once; a longer text is handled alone.
CHUNK = 1 << 20


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(29))


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of parts of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the number of words of each text.

    A word's hash is the sum of random 64-bit values of its bytes times powers by place, mixed.
    """
    none = np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    if not len(data):
        return none
    white = _IS_WHITE[data]
    opens = ~white
    opens[1:] &= white[:-1]
    firsts = offsets[:-1]
    firsts = firsts[firsts < len(data)]
    opens[firsts] = ~white[firsts]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return none
    body = data[starts[0] :]
    values = _BYTE[_LOWER[body] if lower else body]
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    global _powers
    if len(_powers) <= lengths.max():
        _powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()) * 2, _POWER)]))
    values *= _powers[place]
    hashes = mixed(np.add.reduceat(values, starts - starts[0]))
    ends = np.searchsorted(starts, offsets)
    return hashes, np.diff(ends)


def segment_means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean of each run of values; 0 where it is empty."""
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(counts)
    return (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)


def _shape_classes() -> np.ndarray:
    """Letters, digits, white space and bytes beyond ASCII as classes; every other sign is its own."""
    out = np.zeros(256, dtype=np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 1, 2, 3, 4
    out[[9, 11, 12, 13, 32]], out[10] = 5, 6
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    out[signs] = np.arange(7, 7 + len(signs))
    return out


SHAPE = _shape_classes()
N_SHAPES = int(SHAPE.max()) + 1


def shape_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring character classes with the number of their text; pairs do not cross texts."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    same = owner[1:] == owner[:-1]
    classes = SHAPE[data]
    return (classes[:-1] * N_SHAPES + classes[1:])[same], owner[:-1][same]
