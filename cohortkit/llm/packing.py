"""Pack documents into training sequences: first-fit decreasing in random groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.encode import encoded
from cohortkit.llm.text import whole

GROUP = 4096

# A piece of a document: (document, start, length).
Piece = tuple[int, int, int]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    length: int = 4096,
    group: int = GROUP,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Encode documents and pack their ids into sequences of at most ``length``.

    One row per piece: the id, ``start`` and ``length`` in its document's ids,
    ``doc_tokens``, ``sequence_id``, ``offset`` there, ``tokens`` (the ids).
    Each document ends with ``end_id``; each of its ids is in one piece.

    Documents are dealt out by hash and ``group`` of them at a time are packed
    on their own: full lengths of a document become sequences at once, what is
    left goes, longest first, into the first sequence with room. Then pieces
    from the emptiest sequences are cut to fill the others, and the last one
    is cut into lengths that are powers of two, which need no padding.
    A task holds at most ``group`` times ``length`` ids of remainders, and one
    document. The result depends on hashes and the number of partitions only.

    A null text counts as empty: a piece with the end id. Repeated rows are
    separate documents, null ids too. No rows give no rows; other columns are
    not read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = iter(range(TaskContext.get().partitionId() << 32, 1 << 62))
        names, rest = [], []
        for batch in batches:
            for row, ids, at in encoded(batch.column(1), tokenizer, end_id):
                full = []
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    name, cut = batch.column(0)[row + k], b - a - (b - a) % length
                    for start in range(0, cut, length):
                        tokens = ids[a + start : a + start + length]
                        full.append((name, start, b - a, next(numbers), 0, tokens))
                    if cut < b - a:
                        names.append((name, cut, b - a))
                        rest.append(ids[a + cut : b].copy())
                if full:
                    yield _rows(full, batch.schema.field(0).type)
                if len(rest) >= group:
                    yield _packed(names, rest, length, numbers, batch.schema.field(0).type)
                    names, rest = [], []
        if rest:
            yield _packed(names, rest, length, numbers, batch.schema.field(0).type)

    id_type = docs.schema[id_column].dataType.simpleString()
    schema = (
        "id {}, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint, ids_crc32 bigint, tokens array<int>"
    ).format(id_type)
    text = whole(docs[text_column])
    rows = docs.select(docs[id_column].alias("id"), text.alias("text"))
    at_random = rows.withColumn("deal", F.xxhash64("id", "text", F.lit("deal")))
    dealt = at_random.repartition("deal").sortWithinPartitions("deal", "id").drop("deal")
    return dealt.mapInArrow(pack, schema).withColumnRenamed("id", id_column)


def pack(sizes: list[int], length: int) -> list[list[Piece]]:
    """Sequences of pieces for documents of the given sizes, each at most ``length``.

    All sequences but the last few are full, and those have powers of two.
    """
    bins = first_fit_decreasing(sizes, length)
    filled = [[(d, 0, sizes[d]) for d in b] for b in bins]
    room = [length - sum(sizes[d] for d in b) for b in bins]
    order = sorted(range(len(filled)), key=lambda b: (room[b], b))
    taker, giver = 0, len(order) - 1
    while taker < giver:
        to, since = order[taker], order[giver]
        if room[to] == 0:
            taker += 1
        elif not filled[since]:
            giver -= 1
        else:
            document, start, size = filled[since].pop()
            moved = min(size, room[to])
            filled[to].append((document, start + size - moved, moved))
            room[to] -= moved
            room[since] += moved
            if moved < size:
                filled[since].append((document, start, size - moved))
    out = []
    for b in order:
        if filled[b]:
            out += [filled[b]] if room[b] == 0 else _powers(filled[b])
    return out


def _powers(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces in sequences whose lengths are powers of two, largest first."""
    total = sum(size for _, _, size in pieces)
    pieces = pieces[::-1]
    out = []
    for bit in reversed(range(total.bit_length())):
        left = total & (1 << bit)
        if left:
            out.append([])
        while left:
            document, start, size = pieces.pop()
            taken = min(size, left)
            out[-1].append((document, start, taken))
            left -= taken
            if taken < size:
                pieces.append((document, start + taken, size - taken))
    return out


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Longest first into the first bin with room, found by a tournament tree.

    The tree's leaves are the room in each bin, an inner node the larger of
    its two, so the first bin with room is a walk from the root.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins: list[list[int]] = []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, node = sizes[item], 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        if node - leaves == len(bins):
            bins.append([])
        bins[node - leaves].append(item)
        room[node] -= size
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def _packed(names, rest, length, numbers, id_type) -> pa.RecordBatch:
    rows = []
    for sequence in pack([len(x) for x in rest], length):
        number, offset = next(numbers), 0
        for document, start, size in sequence:
            name, cut, doc_tokens = names[document]
            tokens = rest[document][start : start + size]
            rows.append((name, cut + start, doc_tokens, number, offset, tokens))
            offset += size
    return _rows(rows, id_type)


def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    name, start, doc_tokens, number, offset, tokens = zip(*rows, strict=True)
    length = np.array([len(t) for t in tokens], np.int64)
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)),
        pa.array(np.concatenate(tokens).view(np.int32)),
    )
    crc = [zlib.crc32(np.ascontiguousarray(t, "<u4")) for t in tokens]
    numbers = [pa.array(x, pa.int64()) for x in (start, length, doc_tokens, number, offset, crc)]
    names = ["id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32", "tokens"]
    ids = pa.array([x.as_py() for x in name], id_type)
    return pa.RecordBatch.from_arrays([ids, *numbers, lists], names)
