"""Words in passages that an earlier document has, by level-wise doubling of window lengths.

Windows of a length are told apart by hash. Only windows that come in several
documents at one length are extended to the next, at most twice as long, until
the wanted length is reached or none is left. On the first and shortest length,
where most windows are, one in each neighbourhood is enough: every window of
the second length holds the least, by hash, of the short windows in it, and
equal windows hold the same one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.spans import mix
from cohortkit.llm.text import whole
from cohortkit.llm.words import grams, joined, parts

BLOCKS = 4  # per shuffle partition, so that partitions come out even; as many times fewer buckets

_HASHES = "bucket int, block int, hashes binary"
_ANSWER = "block int, hashes binary"


def levels(length: int, shortest: int) -> list[int]:
    """Window lengths up to the wanted one, each at most twice the one before."""
    out = [length]
    while out[0] >= 2 * shortest:
        out.insert(0, (out[0] + 1) // 2)
    return out


def remove_repeated_windows(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = 13,
    shortest: int = 6,
) -> DataFrame:
    """Each text without the words of windows that start in a document with a smaller id, too.

    A window is ``length`` consecutive words (what ASCII white space parts) of
    one document. A word goes if any window over it is found, the same word by
    word, in a document with a smaller id; windows are judged on the texts as
    given. Columns: the id, ``n_words``, ``n_removed`` and ``kept``, the other
    words joined by one space.

    Texts are dealt once, into blocks by a hash of the id; every step reads
    them from that shuffle. What goes between blocks is hashes, each once for
    a block, however many documents in it share the window. A bucket of hashes
    says which of them other blocks hold, too; on the last level also whether
    one of those has it in an earlier document. So a window that a third of
    all documents hold is one number for each block.

    Ids are whole numbers. A null id is neither smaller nor larger than any
    other, so its text is kept whole and removes nothing; rows that repeat an
    id don't remove from each other. A null text counts as empty; shorter texts
    than a window stay whole. Windows are the same when their 64-bit hashes
    are. No rows give no rows; other columns are not read.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = BLOCKS * partitions, max(1, partitions // BLOCKS)
    id_type = docs.schema[id_column].dataType.simpleString()
    ladder = levels(length, shortest)
    text = whole(docs[text_column])
    dealt = (
        docs.select(
            F.pmod(F.xxhash64(docs[id_column], text), F.lit(blocks)).cast("int").alias("block"),
            docs[id_column].cast("bigint").alias("id"),
            text.alias("text"),
        )
        .repartition(partitions, "block")
        .sortWithinPartitions("block", "id")
    )
    by_block = dealt.groupBy("block")

    def first_level(table: pa.Table) -> pa.Table:
        block = _Block(table, ladder)
        if len(ladder) == 1:
            return _sent(table, buckets, *block.firsts(block.fits(length)))
        return _sent(table, buckets, np.unique(block.least[block.fits(ladder[1])]))

    def level(at: int):
        def work(table: pa.Table, shared: pa.Table) -> pa.Table:
            block = _Block(table, ladder)
            some = block.candidates(at, _hashes(shared))
            if ladder[at] == length:
                return _sent(table, buckets, *block.firsts(some))
            return _sent(table, buckets, np.unique(block.windows(ladder[at])[some]))

        return work

    def removed(table: pa.Table, earlier: pa.Table) -> pa.Table:
        return _Block(table, ladder).kept(_hashes(earlier))

    fields = [f"{_HASHES}, firsts binary" if n == length else _HASHES for n in ladder]
    sent = by_block.applyInArrow(first_level, fields[0])
    for at in range(1, len(ladder)):
        shared = sent.groupBy("bucket").applyInArrow(_elsewhere, _ANSWER)
        sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(level(at), fields[at])
    earlier = sent.groupBy("bucket").applyInArrow(_earlier, _ANSWER)
    schema = "id bigint, n_words bigint, n_removed bigint, kept string"
    found = by_block.cogroup(earlier.groupBy("block")).applyInArrow(removed, schema)
    return found.select(F.col("id").cast(id_type).alias(id_column), "n_words", "n_removed", "kept")


class _Block:
    """The documents of a block in order of their ids, and what its windows share."""

    def __init__(self, table: pa.Table, ladder: list[int]):
        table = table.sort_by("id")  # null ids last
        self.ladder, self.table = ladder, table
        self.parts = list(parts(table.column("text")))
        counts = [np.diff(w.first) for _, _, w in self.parts]
        self.hash = np.concatenate([np.zeros(0, np.uint64), *(w.hash for _, _, w in self.parts)])
        n_words = np.concatenate([np.zeros(0, np.int64), *counts])
        ids = table.column("id").combine_chunks()
        self.id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.text = np.repeat(np.arange(len(n_words)), n_words)
        # How many words of its text are left at each word; none without an id.
        end = np.repeat(np.cumsum(n_words), n_words)
        self.left = np.where(known[self.text], end - np.arange(len(end)), 0)

    def fits(self, n: int) -> np.ndarray:
        """Where windows of n words start."""
        return self.left >= n

    def windows(self, n: int) -> np.ndarray:
        """The hash of the n words from each place on; 0 where there are fewer in the block."""
        out = np.zeros(len(self.hash), np.uint64)
        some = grams(self.hash, n)
        out[: len(some)] = some
        return out

    @property
    def least(self) -> np.ndarray:
        """The least of the first level's windows inside the second level's window of each place."""
        short, longer = self.ladder[:2]
        out = self.windows(short)
        each = out.copy()
        for k in range(1, longer - short + 1):
            np.minimum(out[:-k], each[k:], out=out[:-k])
        return out

    def candidates(self, at: int, shared: np.ndarray) -> np.ndarray:
        """Where windows of a level start whose parts come in several documents."""
        n, before = self.ladder[at], self.ladder[at - 1]
        fits = self.fits(n)
        if at == 1:
            return fits & self._in_several(self.least, fits, shared)
        part = self._in_several(self.windows(before), self.fits(before), shared)
        other = np.zeros(len(part), bool)
        other[: len(part) - (n - before)] = part[n - before :]
        return fits & part & other

    def _in_several(self, window: np.ndarray, fits: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Places whose window another block holds, or another document of this one."""
        out = np.zeros(len(window), bool)
        at = np.flatnonzero(fits)
        if len(at) == 0:
            return out
        # Neighbours mostly have the same least window: ask once for each stretch.
        new = np.ones(len(at), bool)
        new[1:] = (window[at[1:]] != window[at[:-1]]) | (self.text[at[1:]] != self.text[at[:-1]])
        asked = at[new]
        value, text = window[asked], self.text[asked]
        order = np.argsort(value, kind="stable")
        value, text = value[order], text[order]
        head = np.ones(len(value), bool)
        head[1:] = value[1:] != value[:-1]
        starts = np.flatnonzero(head)
        # Texts ascend inside a group of equal windows, so its ends tell whether they differ.
        several = text[np.append(starts[1:], len(text)) - 1] != text[starts]
        several |= _among(value[starts], shared)
        answer = np.zeros(len(asked), bool)
        answer[order] = np.repeat(several, np.diff(np.append(starts, len(value))))
        out[at] = answer[np.cumsum(new) - 1]
        return out

    def firsts(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different windows of the last level at some places, and the least id of each."""
        window = self.windows(self.ladder[-1])[some]
        value, first = np.unique(window, return_index=True)
        return value, self.id[self.text[some][first]]

    def kept(self, earlier: np.ndarray) -> pa.Table:
        """Texts without the words of windows that came earlier, here or in another block."""
        n = self.ladder[-1]
        none = np.zeros(0, np.uint64)
        # What only this block's documents share is found by the same steps.
        some = self.fits(n)
        for at in range(1, len(self.ladder)):
            some &= self.candidates(at, none)
        window = self.windows(n)
        gone = self.fits(n) & _among(window, earlier)
        places = np.flatnonzero(some)
        if len(places):
            _, first, group = np.unique(window[places], return_index=True, return_inverse=True)
            ids = self.id[self.text[places]]
            gone[places[ids > ids[first][group]]] = True
        step = np.zeros(len(gone) + n, np.int32)
        step[: len(gone)] += gone
        step[n : n + len(gone)] -= gone
        kept = np.cumsum(step)[: len(gone)] == 0
        texts, words, removed, at = [], [], [], 0
        for _, _, part in self.parts:
            own = kept[at : at + len(part.hash)]
            at += len(own)
            texts.append(joined(part, own))
            words.append(np.diff(part.first))
            before = np.concatenate([[0], np.cumsum(~own)])
            removed.append(np.diff(before[part.first]))
        columns = [
            self.table.column("id"),
            pa.array(np.concatenate(words), pa.int64()),
            pa.array(np.concatenate(removed), pa.int64()),
            pa.chunked_array(texts, pa.string()),
        ]
        return pa.Table.from_arrays(columns, ["id", "n_words", "n_removed", "kept"])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the ascending known ones."""
    if len(known) == 0:
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _sent(table: pa.Table, buckets: int, hashed: np.ndarray, firsts: np.ndarray | None = None) -> pa.Table:
    """A block's hashes by the bucket that compares them, with the first id of each where asked."""
    bucket = (mix(hashed) % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    groups = np.split(order, cuts) if len(order) else []
    columns = {
        "bucket": pa.array([int(bucket[g[0]]) for g in groups], pa.int32()),
        "block": pa.array([table.column("block")[0].as_py()] * len(groups), pa.int32()),
        "hashes": pa.array([hashed[g].tobytes() for g in groups], pa.binary()),
    }
    if firsts is not None:
        columns["firsts"] = pa.array([firsts[g].tobytes() for g in groups], pa.binary())
    return pa.table(columns)


def _hashes(table: pa.Table) -> np.ndarray:
    """All hashes of an answer, ascending."""
    return np.sort(np.frombuffer(b"".join(table.column("hashes").to_pylist()), np.uint64))


def _together(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows and the block each is from."""
    blobs = table.column(column).to_pylist()
    block = table.column("block").to_numpy()
    return np.frombuffer(b"".join(blobs), kind), np.repeat(block, [len(b) // 8 for b in blobs])


def _answers(hashed: np.ndarray, block: np.ndarray) -> pa.Table:
    order = np.argsort(block, kind="stable")
    hashed, block = hashed[order], block[order]
    starts = np.flatnonzero(np.append(True, np.diff(block) != 0)) if len(block) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(block))
    return pa.table(
        {
            "block": pa.array(block[starts], pa.int32()),
            "hashes": pa.array([hashed[a:b].tobytes() for a, b in zip(starts, ends, strict=False)], pa.binary()),
        }
    )


def _elsewhere(table: pa.Table) -> pa.Table:
    """To each block those of its hashes that another block sent, too."""
    hashed, block = _together(table, "hashes", np.uint64)
    order = np.argsort(hashed)
    hashed, block = hashed[order], block[order]
    same = hashed[1:] == hashed[:-1]
    several = np.append(same, False) | np.append(False, same)
    return _answers(hashed[several[: len(hashed)]], block[several[: len(hashed)]])


def _earlier(table: pa.Table) -> pa.Table:
    """To each block those of its hashes that another block holds in an earlier document."""
    hashed, block = _together(table, "hashes", np.uint64)
    first, _ = _together(table, "firsts", np.int64)
    order = np.lexsort((first, hashed))
    hashed, block, first = hashed[order], block[order], first[order]
    head = np.append(True, hashed[1:] != hashed[:-1])[: len(hashed)]
    least = first[np.maximum.accumulate(np.where(head, np.arange(len(hashed)), 0))]
    later = first > least
    return _answers(hashed[later], block[later])
