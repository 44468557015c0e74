"""Spans of UTF-8 texts as numpy arrays, for work inside a task.

A column of texts is one array of bytes and an array of offsets, as Arrow
stores it; no Python string is made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20  # bytes hashed at once

_FACTOR = 0x9E3779B97F4A7C15


def _powers(factor: int) -> np.ndarray:
    powers = np.full(BLOCK + 1, factor, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


_FACTORS = _powers(_FACTOR)
_INVERSES = _powers(pow(_FACTOR, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a column of texts without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that are ``inside``, cut at texts.

    Also, for each text, the number of runs before it (n + 1 numbers).
    """
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first[cut] = inside[cut]
    last[cut[1:] - 1] = inside[cut[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes; spans ascend and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = int(np.searchsorted(ends, low + BLOCK, "right"))
        if to == at:  # one span that is longer than a block
            digest = hashlib.blake2b(data[low : ends[at]].tobytes(), digest_size=8).digest()
            out[at] = np.frombuffer(digest, np.uint64)[0]
            at += 1
            continue
        values = data[low : ends[to - 1]].astype(np.uint64) + np.uint64(1)
        out[at:to] = _sums(values, starts[at:to] - low, ends[at:to] - low)
        at = to
    return mix(out ^ (ends - starts).astype(np.uint64))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial of each range of values, by differences of one running sum."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _FACTORS[: len(values)], out=total[1:])
    return (total[ends] - total[starts]) * _INVERSES[starts]


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``n``-word shingles.

    ``first``: where each text's word hashes begin (one more number ends the
    last). A text with fewer words has its whole sequence as one, a text
    without words none.
    """
    if len(words) >= n:
        joined = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            joined = mix(joined * np.uint64(_FACTOR) + words[k : len(words) - n + 1 + k])
    else:
        joined = np.zeros(0, np.uint64)
    out = []
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= n:
            out.append(np.unique(joined[low : high - n + 1]))
        elif high > low:
            short = np.array([high - low], np.uint64)
            for k in range(low, high):
                short = mix(short * np.uint64(_FACTOR) + words[k : k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
