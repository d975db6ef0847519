"""Distinct runs of bytes in a block of text, found on whole arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Longer runs are not compared: each counts as distinct.
LONGEST = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def distinct(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, inverse): the index of one run of each distinct kind, and each run's kind.

    Runs of up to eight bytes are keyed by their bytes; longer ones by a 64-bit hash of their
    eight-byte lanes and length, up to ``LONGEST``; beyond that each run is a kind of its own.
    """
    size = end - start
    padded = raw + b"\0" * (LONGEST + 8)
    lanes = np.ndarray((len(raw) + LONGEST,), "<u8", padded, strides=(1,))
    key = lanes[start] & _MASK[np.minimum(size, 8)]
    key *= _ODD
    rest = np.flatnonzero((size > 8) & (size <= LONGEST))
    lane = 1
    while len(rest):
        value = lanes[start[rest] + 8 * lane] & _MASK[np.minimum(size[rest] - 8 * lane, 8)]
        mixed = key[rest]
        mixed ^= mixed >> np.uint64(29)
        mixed *= _ODD2
        mixed += value
        mixed *= _ODD
        key[rest] = mixed
        lane += 1
        rest = rest[size[rest] > 8 * lane]
    key ^= key >> np.uint64(32)
    key *= _ODD2
    key += size.astype(np.uint64) * _ODD
    long = np.flatnonzero(size > LONGEST)
    key[long] = long.astype(np.uint64) * _ODD2 + np.uint64(1)
    inverse, kinds = pd.factorize(key)  # by hashing, in order of first occurrence
    first = np.empty(len(kinds), np.int64)
    first[inverse[::-1]] = np.arange(len(key))[::-1]
    if len(long):  # a kind of its own each, whatever their keys are
        inverse[long] = len(first) + np.arange(len(long))
        first = np.append(first, long)
    return first, inverse


def spread(flat: np.ndarray, size: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The entries of each kind, written out for a sequence of kinds."""
    begin = np.append(0, np.cumsum(size))[:-1]
    each = size[kinds]
    ends = np.cumsum(each)
    index = np.repeat(begin[kinds] - ends + each, each)
    index += np.arange(len(index))
    return flat[index]
