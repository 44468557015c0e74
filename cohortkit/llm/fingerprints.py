"""Document fingerprints: a homomorphic hash of the multiset of paragraphs."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortkit.functions import range_index
from cohortkit.llm.spans import SPACE, hashes, mix, runs, texts
from cohortkit.llm.text import whole

CHECK = 32  # lanes that tell unequal multisets apart, from a cryptographic hash
SKETCH = 224  # lanes that count word pairs, for likeness
LANES = CHECK + SKETCH
PART = 1 << 21  # bytes of text worked on at once
RANGES, MOST_RANGES = 4, 4096  # ranges of ids per shuffle partition, and in all (each is in the plan)


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``LANES`` 16-bit numbers per text: the sum, modulo 2^16, over its paragraphs.

    Paragraphs are what line feeds part; an empty text has one, empty. A
    paragraph's vector has 32 lanes of its BLAKE2b hash, then counts of its
    pairs of neighbouring words (a word alone in it counts itself), each added
    with a sign to one of 224 lanes.
    """
    out = np.empty((len(offsets) - 1, LANES), np.uint16)
    out[:, :CHECK] = _check(data, offsets)
    out[:, CHECK:] = _sketch(data, offsets)
    return out


def add(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Fingerprint of all paragraphs of both: insertion."""
    return (one + other).astype(np.uint16)


def remove(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Fingerprint without the other's paragraphs, all of which it has: deletion."""
    return (one - other).astype(np.uint16)


def likeness(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """0 to 1 per pair of rows: 1 for equal multisets, else the cosine of the pair counts.

    Texts without words are unlike all that are not equal to them.
    """
    same = (one[:, :CHECK] == other[:, :CHECK]).all(axis=1)
    a = one[:, CHECK:].view(np.int16).astype(np.float64)
    b = other[:, CHECK:].view(np.int16).astype(np.float64)
    norm = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    cosine = (a * b).sum(axis=1) / np.where(norm > 0, norm, 1)
    return np.where(same, 1.0, np.clip(cosine, 0.0, 1.0))


def written(rows: np.ndarray) -> list[str]:
    """Each fingerprint as base64 of its little-endian lanes."""
    return [base64.b64encode(r.tobytes()).decode() for r in np.ascontiguousarray(rows, "<u2")]


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u2").astype(np.uint16)


def _check(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = memoryview(data.tobytes())
    feeds = np.flatnonzero(data == 10)
    # One paragraph per text and one more per line feed in it.
    begins = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    digests = b"".join(
        [hashlib.blake2b(raw[a:b]).digest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
    )
    lanes = np.frombuffer(digests, "<u2").reshape(-1, CHECK).astype(np.uint16)
    first = np.arange(len(offsets) - 1) + np.searchsorted(feeds, offsets[:-1])
    return np.add.reduceat(lanes, first, axis=0, dtype=np.uint16)


def _sketch(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    starts, ends, _ = runs(~SPACE[data], offsets)
    n = len(offsets) - 1
    if len(starts) == 0:
        return np.zeros((n, SKETCH), np.uint16)
    words = hashes(data, starts, ends)
    text = np.searchsorted(offsets, starts, "right") - 1
    paragraph = np.searchsorted(np.flatnonzero(data == 10), starts)
    joined = (text[1:] == text[:-1]) & (paragraph[1:] == paragraph[:-1])
    alone = ~(np.append(joined, False) | np.insert(joined, 0, False))
    pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    unit = np.concatenate([pairs[joined], words[alone]])
    owner = np.concatenate([text[:-1][joined], text[alone]])
    lane = ((unit >> np.uint64(32)) * np.uint64(SKETCH) >> np.uint64(32)).astype(np.int64)
    sign = 1.0 - 2.0 * (unit & np.uint64(1)).astype(np.float64)
    counts = np.bincount(owner * SKETCH + lane, sign, n * SKETCH)
    return (counts.astype(np.int64) & 0xFFFF).astype(np.uint16).reshape(n, SKETCH)


def fingerprint_with_edits(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Fingerprints of each text and of an edited one, whose second half is the next text's start.

    The last floor(n / 2) of a text's n code points are replaced by the first
    as many (or all) of the next document in ascending id order; after the
    last comes the first. Columns: the id, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, and ``near_edited`` and
    ``near_next``, likeness to the edited text and to the next document.

    Ids are cut into ranges and the first row of the next range goes along
    with each, so one shuffle of the texts brings neighbours together. A null
    text counts as empty. Null ids come first, rows with one id in order of
    their texts; a lone document is its own next. No rows give no rows; other
    columns are not read.
    """
    id_type = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("id"), whole(docs[text_column]).alias("text"))
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(RANGES * partitions, MOST_RANGES)
    firsts = _range_starts(rows.select("id"), ranges)
    bounds = firsts[1:]
    own = rows.withColumns({"part": range_index(F.col("id"), bounds), "guest": F.lit(False)})
    if bounds:
        of_next = rows.filter(F.col("id").isin(bounds))
        own = own.union(
            of_next.withColumns({"part": range_index(F.col("id"), bounds) - 1, "guest": F.lit(True)})
        )
    if firsts:
        first = rows.filter(F.col("id").eqNullSafe(F.lit(firsts[0])))
        own = own.union(first.withColumns({"part": F.lit(len(bounds)), "guest": F.lit(True)}))
    dealt = own.repartition("part").sortWithinPartitions("part", "guest", "id", "text")
    schema = (
        f"id {id_type}, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    compared = dealt.select("id", "text", "guest").mapInArrow(_neighbours, schema)
    return compared.withColumnRenamed("id", id_column)


def _range_starts(ids: DataFrame, ranges: int) -> list:
    """The first id of each of up to ``ranges`` ranges, null first."""
    starts = (
        ids.repartitionByRange(ranges, "id")
        .groupBy(F.spark_partition_id())
        .agg(F.min("id").alias("id"), F.max(F.col("id").isNull()).alias("null"))
        .collect()
    )
    known = sorted({r["id"] for r in starts if r["id"] is not None})
    if any(r["null"] for r in starts):  # they belong to the first range
        return [None, *known[1:]]
    return known


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each followed by its next; guests are only that."""
    held = None
    for batch in batches:
        data, offsets = texts(batch.column(1))
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PART, "right")) - 1)
            ids, guests = batch.column(0).slice(row, to - row), batch.column(2).slice(row, to - row)
            some = data[offsets[row] : offsets[to]]
            at = offsets[row : to + 1] - offsets[row]
            if held is not None:
                ids = pa.concat_arrays([held[0], ids])
                guests = pa.concat_arrays([held[1], guests])
                some = np.concatenate([held[2], some])
                at = np.concatenate([[0], at + len(held[2])])
            if len(ids) > 1:
                yield _compared(ids, guests.to_numpy(zero_copy_only=False), some, at)
            held = ids[-1:], guests[-1:], some[at[-2] :].copy()
            row = to


def _compared(ids: pa.Array, guests: np.ndarray, data: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    before = np.searchsorted(begins, at)
    places = np.append(begins, len(data))
    n = np.diff(before)
    replaced = n[:-1] // 2
    kept_to = places[before[:-2] + n[:-1] - replaced]
    next_to = places[before[1:-1] + np.minimum(replaced, n[1:])]
    pieces = []
    for a, b, c, d in zip(at[:-2].tolist(), kept_to.tolist(), at[1:-1].tolist(), next_to.tolist(), strict=True):
        pieces += [data[a:b], data[c:d]]
    edited = np.concatenate(pieces)
    edited_at = np.concatenate([[0], np.cumsum((kept_to - at[:-2]) + (next_to - at[1:-1]))])
    own = vectors(data, at)
    other = vectors(edited, edited_at)
    raw = memoryview(edited.tobytes())
    digest = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(edited_at[:-1].tolist(), edited_at[1:].tolist(), strict=True)]
    result = pa.RecordBatch.from_arrays(
        [
            ids[:-1],
            pa.array(n[:-1].astype(np.int64)),
            pa.array(digest, pa.string()),
            pa.array(written(own[:-1]), pa.string()),
            pa.array(written(other), pa.string()),
            pa.array(likeness(own[:-1], other)),
            pa.array(likeness(own[:-1], own[1:])),
        ],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
    return result.filter(pa.array(~guests[:-1].astype(bool)))
