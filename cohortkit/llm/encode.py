"""Token ids of many texts from a file of the tokenizers library.

Text is cut where no pre-token of either file can reach across: after a
character that is certainly no white space and before ASCII white space. Equal
pieces have equal ids, so a piece is encoded once and kept in a table of fixed
size; what is new goes to the library many pieces at a time.
"""

from __future__ import annotations

import os

import numpy as np
from tokenizers import Tokenizer

from cohortkit.llm.spans import SPACE, hashes, texts

SLOT_BITS = 21  # places of pieces (46 MB)
POOL = 1 << 23  # ids kept (32 MB)
LONGEST = 64  # bytes of a piece that is kept
TOGETHER = 256  # pieces in one call's text
PART = 1 << 20  # bytes of text worked on at once
_MARK = 0x01  # a character that stands alone between pieces

_SURE = np.zeros(256, bool)  # ASCII characters that are no white space
_SURE[0x21:0x7F] = True

_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of eight

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file; its table outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        slots = 1 << SLOT_BITS
        self.key = np.zeros(slots, np.uint64)
        self.head = np.zeros(slots, np.uint64)
        self.size = np.zeros(slots, np.uint8)
        self.at = np.zeros(slots, np.int32)
        self.count = np.zeros(slots, np.uint8)
        self.pool = np.zeros(POOL, np.uint32)
        self.used = 0
        mark = self._plain([" \x01 "])[0]
        self.marked, self.mark = len(mark) == 1, mark[0]
        # Where white space is kept, ids spell the text byte by byte.
        vocabulary = self.library.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(x) for x in vocabulary]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and n + 1 offsets into them.

        Works through parts of bounded size, cut between pieces.
        """
        ids, at = [np.zeros(0, np.uint32)], np.zeros(len(offsets), np.int64)
        low = 0
        while low < len(data):
            high = _cut_before(data, low, low + PART)
            found, first = self._encode(data[low:high], np.clip(offsets, low, high) - low)
            ids.append(found)
            at += first
            low = high
        return np.concatenate(ids), at

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, first = _pieces(data, offsets)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        key = hashes(data, starts, ends)
        head = _heads(data, starts, size)
        slot = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = (
            (self.key[slot] == key)
            & (self.head[slot] == head)
            & (self.size[slot] == size)
            & (size <= LONGEST)
        )
        at, count = self.at[slot].astype(np.int64), self.count[slot].astype(np.int64)
        new = np.flatnonzero(~known)
        _, one, same = np.unique(key[new], return_index=True, return_inverse=True)
        one = new[one]
        pieces = [data[a:b].tobytes() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        fresh = self._encode_pieces(pieces)
        lengths = np.array([len(x) for x in fresh], np.int64)
        added = np.concatenate([np.zeros(0, np.uint32), *fresh])
        place = self.used + np.cumsum(lengths) - lengths
        at[new], count[new] = place[same], lengths[same]
        if self.used + len(added) <= POOL:
            self.pool[self.used : self.used + len(added)] = added
            self.used += len(added)
            ids = _gather(self.pool, at, count)
            short = (size[one] <= LONGEST) & (lengths < 256)
            kept, to = one[short], slot[one[short]]
            self.key[to], self.head[to], self.size[to] = key[kept], head[kept], size[kept]
            self.at[to], self.count[to] = place[short], lengths[short]
        else:  # start anew
            ids = _gather(np.concatenate([self.pool[: self.used], added]), at, count)
            self.used = 0
            self.size[:] = 0
        total = np.concatenate([[0], np.cumsum(count)])
        return ids, total[first]

    def _encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Many pieces in one text: where each ends is seen from a mark, or from its bytes."""
        if self.marked:
            joins = [_MARK not in p for p in pieces]
        else:
            joins = [SPACE[p[0]] and _SURE[p[-1]] for p in pieces]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        alone = [i for i, j in enumerate(joins) if not j]
        for i, ids in zip(alone, self._plain([pieces[i].decode() for i in alone]), strict=True):
            out[i] = ids
        rest = [i for i, j in enumerate(joins) if j]
        groups = [rest[k : k + TOGETHER] for k in range(0, len(rest), TOGETHER)]
        between = b" \x01 " if self.marked else b""
        joined = [between.join(pieces[i] for i in g).decode() for g in groups]
        for group, ids in zip(groups, self._plain(joined), strict=True):
            if self.marked:
                ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
                starts = np.append(0, ends[:-1] + 1)
            else:
                wanted = np.cumsum([len(pieces[i]) for i in group])
                ends = np.searchsorted(np.cumsum(self.bytes[ids]), wanted) + 1
                starts = np.append(0, ends[:-1])
            for i, a, b in zip(group, starts.tolist(), ends.tolist(), strict=True):
                out[i] = ids[a:b]
        return out

    def _plain(self, strings: list[str]) -> list[np.ndarray]:
        return [
            np.array(x.ids, np.uint32)
            for x in self.library.encode_batch_fast(strings, add_special_tokens=False)
        ]


def _cuts(data: np.ndarray) -> np.ndarray:
    """Which bytes may begin a piece, by what stands before and there."""
    cut = np.zeros(len(data), bool)
    if len(data) > 1:
        sure = _SURE[data]
        # After 0xC3 comes one of the letters U+00C0 to U+00FF.
        sure[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        cut[1:] = SPACE[data[1:]] & sure[:-1]
    return cut


def _cut_before(data: np.ndarray, low: int, high: int) -> int:
    """The last place up to ``high`` where a piece may begin, or the next after it."""
    if high >= len(data):
        return len(data)
    found = np.flatnonzero(_cuts(data[low : high + 1]))
    while len(found) == 0 and high < len(data):
        high = min(high + PART, len(data))
        found = np.flatnonzero(_cuts(data[low : high + 1]))[:1]
    return low + int(found[-1]) if len(found) else len(data)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces, and per text the number of pieces before it."""
    cut = _cuts(data)
    begins = offsets[:-1][np.diff(offsets) > 0]
    cut[begins] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets)


def _with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, at[1:], end).astype(np.uint32), at + np.arange(len(at))


def encoded(column, path: str, end: int):
    """Per text of an Arrow column its ids with the end id; parts of bounded size at a time.

    Yields the first row of a part, all ids of the part and their offsets.
    """
    data, offsets = texts(column)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART, "right")) - 1)
        ids, at = encoder(path).encode(data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        yield row, *_with_end(ids, at, end)
        row = to


def _heads(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of each piece as a number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # A number at every byte, not only at every eighth.
    every = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    return every[starts] & _FIRST[np.minimum(size, 8)]


def _gather(pool: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ids of all pieces, one after the other."""
    total = np.cumsum(count)
    if len(total) == 0:
        return np.zeros(0, np.uint32)
    index = np.arange(total[-1]) + np.repeat(at - (total - count), count)
    return pool[index]
