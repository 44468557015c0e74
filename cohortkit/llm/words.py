"""Words of many texts as numpy arrays: where they are, their hashes, texts without some of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from cohortkit.llm.spans import SPACE, hashes, mix, runs, texts

PART = 1 << 21  # bytes of text worked on at once; a longer text is one part


@dataclass
class Words:
    """Words between ASCII white space of some texts: bytes, spans, 64-bit hashes.

    ``first``: the number of each text's first word, and one more that ends
    the last text.
    """

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def text(self) -> np.ndarray:
        """Which text each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def parts(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """Consecutive rows of a column of texts without nulls, ``PART`` bytes or one row at a time."""
    data, offsets = texts(column)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART, "right")) - 1)
        some = data[offsets[row] : offsets[to]]
        starts, ends, first = runs(~SPACE[some], offsets[row : to + 1] - offsets[row])
        yield row, to, Words(some, starts, ends, first, hashes(some, starts, ends))
        row = to


def joined(words: Words, kept: np.ndarray) -> pa.Array:
    """Each text's kept words joined by one space; a text without any is empty.

    Between two words of a text is white space, so a kept word brings the byte
    after it along unless it is the last kept one of its text.
    """
    some = np.flatnonzero(kept)
    owner = words.text[some]
    follows = np.append(owner[1:] == owner[:-1], False)[: len(some)]
    ends = words.ends[some] + follows
    step = np.zeros(len(words.data) + 1, np.int8)
    # A word's end may be the next one's start: add both.
    np.add.at(step, words.starts[some], 1)
    np.add.at(step, ends, -1)
    inside = np.cumsum(step[:-1], dtype=np.int8).view(bool)
    out = words.data[inside]
    out[SPACE[out]] = 0x20
    sizes = np.bincount(owner, ends - words.starts[some], len(words.first) - 1).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    buffers = [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(out))]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), buffers).cast(pa.string())


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each place on; ``n`` - 1 fewer than words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out
