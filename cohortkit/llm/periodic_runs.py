"""Periodic runs of words, by maximal pairs from the LCP-interval tree.

A run of smallest period q over words s to s + L - 1 is the maximal pair of
places s and s + q that agree for L - q words: its words before differ and its
words after differ. So a maximal pair whose distance is at most its length is
a run, whole as it is, and no run is missed.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortkit.llm.text import whole
from cohortkit.llm.words import Words, grams, joined, parts

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUNS = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))


def periodic_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = 12
) -> DataFrame:
    """Per document its periodic runs of words and its text with each run cut to one period.

    Words are what ASCII white space parts. A run is a stretch of consecutive
    words with smallest period q (words q apart are identical), of at least
    ``shortest`` and at least 2 q words, that no neighbouring word extends
    keeping the period. Columns: the id; ``n_words``; ``runs``, an array of
    (``start``, ``length``, ``period``) in words, by start, then period;
    ``collapsed``, the words that no run contains after its first q, joined
    by one space.

    Every row is worked on alone, as a whole text, in the task that reads it:
    nothing is shuffled. Within a text, words are the same when their 64-bit
    hashes are. A null text counts as empty; a text without words has no runs
    and collapses to the empty text. Null and repeated ids come back as they
    are, a row per row. No rows give no rows; other columns are not read.
    """
    rows = docs.select(docs[id_column].alias("id"), whole(docs[text_column]).alias("text"))
    id_type = docs.schema[id_column].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for row, to, words in parts(batch.column(1)):
                yield _collapsed(ids.slice(row, to - row), words, shortest)

    schema = f"id {id_type}, n_words bigint, runs {RUNS}, collapsed string"
    return rows.mapInArrow(work, schema).withColumnRenamed("id", id_column)


def _collapsed(ids: pa.Array, words: Words, shortest: int) -> pa.RecordBatch:
    start, length, period = find_runs(words.hash, words.first, shortest)
    text = np.searchsorted(words.first, start, "right") - 1
    # Words of a run after its first period are dropped.
    step = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    kept = np.cumsum(step[:-1]) == 0
    places = [start - words.first[text], length, period]
    each = pa.StructArray.from_arrays([pa.array(p, pa.int64()) for p in places], fields=list(_RUNS.value_type))
    at = np.searchsorted(text, np.arange(len(words.first))).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            ids,
            pa.array(np.diff(words.first), pa.int64()),
            pa.ListArray.from_arrays(pa.array(at), each).cast(_RUNS),
            joined(words, kept),
        ],
        ["id", "n_words", "runs", "collapsed"],
    )


def find_runs(
    words: np.ndarray, first: np.ndarray, shortest: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of the runs of all texts, by start, then period.

    ``first``: where each text's words begin, and the end. Both parts of a run's
    pair agree for half of ``shortest`` words at least. So only places whose
    first so many words come again in their text are sorted.
    """
    half = max(1, (shortest + 1) // 2)
    places, lcp, text = _sorted_suffixes(words, first, half)
    before = np.where(places == first[text], -1, places - 1)
    # Words as numbers, so that a text's first word has a class of its own.
    _, number = np.unique(words[before], return_inverse=True)
    left = dict(zip(places.tolist(), np.where(before < 0, -1, number).tolist(), strict=True))
    found = _pairs(places.tolist(), lcp.tolist(), left, shortest)
    pairs = np.array(found, np.int64).reshape(-1, 3)
    start, period, length = pairs[:, 0], pairs[:, 1], pairs[:, 1] + pairs[:, 2]
    # A stretch has a pair for multiples of its period as well.
    order = np.lexsort((period, length, start))
    start, period, length = start[order], period[order], length[order]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, period, length = start[least], period[least], length[least]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _sorted_suffixes(
    words: np.ndarray, first: np.ndarray, half: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in order of the words from there on, text by text, the number of
    words each shares with the one before it, and its text.

    Left out are places whose first ``half`` words come only once in their
    text. By prefix doubling; only places that still share a rank are sorted again.
    """
    none = np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    every = grams(words, half)
    inside = np.flatnonzero(text[: len(every)] == text[half - 1 :]) if len(every) else none
    inside = inside[_repeated(every[inside], text[inside])]
    if len(inside) == 0:
        return none, none, none
    # The words that their order depends on: three times ``half`` from each place.
    near = np.zeros(len(words) + 3 * half + 1, np.int32)
    np.add.at(near, inside, 1)
    np.add.at(near, inside + 3 * half, -1)
    kept = np.flatnonzero(np.cumsum(near)[: len(words)])
    owner, n = text[kept], len(kept)
    index = np.full(len(words) + 1, n, np.int32)  # n: behind the last kept word
    index[kept] = np.arange(n, dtype=np.int32)

    def after(some: np.ndarray, steps: int) -> np.ndarray:
        """The kept word ``steps`` on; n where the text ends before it."""
        to = kept[some] + steps
        to = np.where(to < first[owner[some] + 1], to, len(words))
        return index[to]

    order = np.lexsort((words[kept], owner))
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    _rank(rank, order, np.zeros(n, np.int32), np.stack([owner[order], words[kept][order].view(np.int64)]))
    wanted = np.zeros(n, bool)
    wanted[index[inside]] = True
    levels, size = [], 1
    while True:
        levels.append((size, rank.copy()))
        places = rank[order]
        open_ = np.zeros(n, bool)
        same = places[1:] == places[:-1]
        open_[1:] |= same
        open_[:-1] |= same
        if size >= half:  # others are told apart by now, as far as the wanted ones need it
            open_ &= wanted[order]
        slots = np.flatnonzero(open_)
        if len(slots) == 0:
            break
        some = order[slots]
        follow = rank[after(some, size)]
        again = np.lexsort((follow, rank[some]))
        order[slots] = some[again]
        base = rank[some[again]]
        _rank(rank, some[again], base, np.stack([base, follow[again]]))
        size *= 2

    order = order[wanted[order]]
    one, other = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(len(order), np.int64)
    shared = np.zeros(len(one), np.int64)
    going = np.arange(len(one))
    for size, ranks in reversed(levels):
        equal = ranks[one] == ranks[other]
        equal &= (one < n) & (other < n) & (one != other)
        going = np.flatnonzero(equal)
        shared[going] += size
        one[going] = after(one[going], size)
        other[going] = after(other[going], size)
    lcp[1:] = shared
    lcp[1:][owner[order[1:]] != owner[order[:-1]]] = 0
    return kept[order], lcp, owner[order]


def _repeated(gram: np.ndarray, text: np.ndarray) -> np.ndarray:
    order = np.lexsort((gram, text))
    same = (gram[order][1:] == gram[order][:-1]) & (text[order][1:] == text[order][:-1])
    out = np.zeros(len(gram), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return np.flatnonzero(out)


def _rank(rank: np.ndarray, order: np.ndarray, base: np.ndarray, keys: np.ndarray) -> None:
    """Rank the ordered places: equal keys share one, ``base`` is the first of a group's."""
    new = np.ones(len(order), bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
    group = np.ones(len(order), bool)
    group[1:] = base[1:] != base[:-1]
    at = np.arange(len(order))
    in_group = at - np.maximum.accumulate(np.where(group, at, 0))
    heads = np.maximum.accumulate(np.where(new, at, 0))
    rank[order] = (base + in_group[heads]).astype(np.int32)


def _pairs(
    places: list[int], lcp: list[int], left: dict[int, int], shortest: int
) -> list[tuple[int, int, int]]:
    """Maximal pairs (place, distance, length) whose distance is at most the length.

    Bottom-up over the LCP intervals. An interval holds its places in order,
    each in the class of its left word; where two children meet, the smaller
    list goes into the larger. Places of one class make no pair, as the word
    before both extends it. Between the two places of a smallest period the
    interval has no third one (it would give a smaller period), so a place is
    held against its neighbours in the list alone.
    """
    found: list[tuple[int, int, int]] = []

    def meet(a: list[int], b: list[int], length: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        least, own = shortest - length, -1  # own: the place of b that went in last
        for p in b:
            at = bisect(a, p)
            if at and a[at - 1] != own:
                q = p - a[at - 1]
                if least <= q <= length and left[a[at - 1]] != left[p]:
                    found.append((a[at - 1], q, length))
            if at < len(a):
                q = a[at] - p
                if least <= q <= length and left[a[at]] != left[p]:
                    found.append((p, q, length))
            a.insert(at, p)
            own = p
        return a

    lists: list[list[int]] = []
    depths: list[int] = []  # of the interval that joins two lists
    for place, depth in zip(places, lcp, strict=True):
        while depths and depths[-1] > depth:
            length, last = depths.pop(), lists.pop()
            lists[-1] = meet(lists[-1], last, length)
        if depth == 0:  # nothing in common with what was before
            lists, depths = [[place]], []
        else:
            depths.append(depth)
            lists.append([place])
    while depths:
        length, last = depths.pop(), lists.pop()
        lists[-1] = meet(lists[-1], last, length)
    return found
