"""Repair of conversations: find faults, then the cheapest edits to a lawful order of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm import alternation
from cohortkit.llm.alternation import UNENDED, Turn, chain, outcomes, repaired, whole
from cohortkit.sources import cut_lineage, discard

LARGE = 4096  # rows of a conversation that one task holds at once
BATCH = 2048  # conversations given back at once
SPACES = " \t\n\x0b\x0c\r"
LAWFUL = ("su", "ua", "au")
FAULTS = ("blank", "duplicate", "truncated", "illegal")

_LINES = "array<struct<role:string,text:string>>"
_LINE = pa.struct([("role", pa.string()), ("text", pa.string())])
_SUMS = ("gaps", *FAULTS, "cost")
_COUNTS = ", ".join(f"{name} bigint" for name in _SUMS)


def repair_conversations(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of repaired conversations: counts, the audit of edits, the lines that remain.

    A conversation's rows are taken by turn, nulls first, ties by role, then
    text. A row is ``blank`` without a character that isn't ASCII white space,
    else a ``duplicate`` if its role and text came before, else ``truncated``
    if its last such character is none of ``.!?``. ``illegal`` counts
    neighbours whose roles' initials are not su, ua or au. ``gaps`` is the
    span of turns less the number of different ones (0 where all are null).

    Edits: K keep, 0; R give the role user or assistant, 1; D delete, 2, which
    blank and duplicate rows need; I insert an empty line of user or assistant,
    5. A truncated row that stays adds 5. ``audit`` has the cheapest edits that
    leave initials ``(s?(ua)+)?``, the first by letter among equals; ``cost``
    is theirs. ``repaired`` holds (role, text) of the lines.

    A conversation of at most ``LARGE`` rows is one piece and has ``pieces`` 1.
    A longer one comes as pieces numbered by ``piece`` (``pieces`` null): numbers
    are to be added up, audits and lines put in a row; see
    ``conversation_reports``. Its rows are dealt by ranges of turn over all
    tasks; only numbers, a few for every 64 rows, meet in one.

    Null role and text count as one space; a null id is a conversation of its
    own. No rows give no rows; other columns are not read.
    """
    short, long = _found(turns, id_column, turn_column, role_column, text_column)
    both = short if long is None else short.unionByName(long)
    return both.withColumnRenamed("id", id_column)


def conversation_reports(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per conversation: the counts, ``audit`` and ``repaired_sha256`` of ``repair_conversations``.

    The digest is that of the repaired ``role:text`` lines joined by line
    feeds. Conversations of one piece are read off their row. Pieces of longer
    ones are sorted and read one after the other, as a digest of a whole text
    needs; nothing but the audit is held.
    """
    short, long = _found(turns, id_column, turn_column, role_column, text_column)
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    text = F.array_join(lines, "\n")
    reports = short.select("id", *_SUMS, "audit", F.sha2(text, 256).alias("repaired_sha256"))
    if long is not None:
        lines_there = F.when(F.size("repaired") > 0, text).alias("text")
        pieces = long.select("id", "piece", *_SUMS, "audit", lines_there)
        read = pieces.repartition("id").sortWithinPartitions("id", "piece")
        id_type = turns.schema[id_column].dataType.simpleString()
        schema = f"id {id_type}, {_COUNTS}, audit string, repaired_sha256 string"
        reports = reports.unionByName(read.mapInArrow(_digested, schema))
    return reports.withColumnRenamed("id", id_column)


def _found(
    turns: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str
) -> tuple[DataFrame, DataFrame | None]:
    """Conversations of one piece, and the pieces of longer ones where there are any."""
    blank = lambda c: F.coalesce(turns[c], F.lit(" "))
    rows = turns.select(
        turns[id_column].alias("id"),
        turns[turn_column].cast("bigint").alias("turn"),
        blank(role_column).alias("role"),
        blank(text_column).alias("text"),
    )
    id_type = turns.schema[id_column].dataType.simpleString()
    schema = f"id {id_type}, piece bigint, pieces bigint, {_COUNTS}, audit string, repaired {_LINES}"
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > LARGE)
    long = cut_lineage(sizes.select(F.col("id").alias("long_id")))
    same = F.col("id").eqNullSafe(F.col("long_id"))
    none = long.isEmpty()
    short = rows if none else rows.join(long, same, "left_anti")
    dealt = short.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    found = dealt.mapInArrow(_short, schema)
    if none:
        discard(long)
        return found, None
    return found, _long(rows.join(long, same, "left_semi"), schema, id_type)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def _with_ids(
    work: Callable[[Iterator[tuple]], Iterator[tuple]],
    batches: Iterator[pa.RecordBatch],
    names: list[str],
    types: list[pa.DataType],
    size: int = BATCH,
) -> Iterator[pa.RecordBatch]:
    """``work`` on rows of Python values; the first column keeps its Arrow type."""
    first = next(batches, None)
    if first is None:
        return

    def every() -> Iterator[pa.RecordBatch]:
        yield first
        yield from batches

    yield from _batches(work(_rows(every())), names, [first.schema.field(0).type, *types], size)


_PIECE_NAMES = ["id", "piece", "pieces", "gaps", *FAULTS, "cost", "audit", "repaired"]
_PIECE_TYPES = [*[pa.int64()] * 8, pa.string(), pa.list_(_LINE)]


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _with_ids(_repaired, batches, _PIECE_NAMES, _PIECE_TYPES)


def _repaired(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Whole conversations, rows in order."""
    for key, group in groupby(rows, itemgetter(0)):
        turns, roles, texts = zip(*(row[1:] for row in group), strict=True)
        seen: set[tuple[str, str]] = set()
        faults = []
        for line in zip(roles, texts, strict=True):
            faults.append(_fault(line[1], line in seen))
            seen.add(line)
        known = sorted({t for t in turns if t is not None})
        gaps = known[-1] - known[0] + 1 - len(known) if known else 0
        cost, audit = whole([_turn(r, f) for r, f in zip(roles, faults, strict=True)])
        kept = repaired(audit, list(zip(roles, texts, strict=True)))
        yield key, 0, 1, gaps, *_counts(roles, faults), cost, audit, [{"role": r, "text": t} for r, t in kept]


def _fault(text: str, seen: bool) -> str | None:
    """The first fault of a row."""
    content = text.rstrip(SPACES)
    if not content:
        return "blank"
    if seen:
        return "duplicate"
    return None if content[-1] in ".!?" else "truncated"


def _turn(role: str, fault: str | None) -> Turn:
    return Turn(role[:1], fault in ("blank", "duplicate"), UNENDED if fault == "truncated" else 0)


def _counts(roles: tuple[str, ...], faults: list[str | None]) -> list[int]:
    pairs = zip(roles, roles[1:], strict=False)
    return [*(faults.count(f) for f in FAULTS[:3]), sum(a[:1] + b[:1] not in LAWFUL for a, b in pairs)]


# --- conversations that one task doesn't hold ------------------------------

_OUTCOME = pa.struct([("entry", pa.string()), ("exit", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])
_NUMBERS = ["part", "chunk", *FAULTS, "known", "first_turn", "last_turn"]
_CHUNK_NAMES = ["id", *_NUMBERS, "initials", "open", "closing", "lines"]
_CHUNK_TYPES = [*[pa.int64()] * len(_NUMBERS), pa.string(), pa.list_(_OUTCOME), pa.list_(_OUTCOME), pa.list_(_LINE)]
_OUTCOMES = "array<struct<entry:string,exit:string,cost:bigint,audit:string>>"


def _long(rows: DataFrame, schema: str, id_type: str) -> DataFrame:
    """Pieces of long conversations, each of a chunk of rows in one range of turns.

    A duplicate is a row with a later turn than the first of its role and
    text, or one equal to the row before it. First turns are found by one
    aggregation. Chunks are aligned between all states of the grammar, the
    states are chosen on numbers alone, then each chunk takes its audit.
    """
    key = F.md5("text")
    at = F.struct(F.col("turn").isNotNull().alias("is"), "turn")
    firsts = rows.groupBy("id", "role", key.alias("key")).agg(F.min(at).alias("first"))
    firsts = firsts.select(*(F.col(c).alias(f"_{c}") for c in ("id", "role", "key", "first")))
    known = (F.col("id").eqNullSafe(F.col("_id"))) & (F.col("role") == F.col("_role")) & (key == F.col("_key"))
    flagged = rows.join(firsts, known).select("id", "turn", "role", "text", (at > F.col("_first")).alias("later"))
    order = ["id", "turn", "role", "text"]
    dealt = flagged.repartitionByRange(*order).sortWithinPartitions(*order)
    numbers = ", ".join(f"{c} bigint" for c in _NUMBERS)
    chunk_schema = f"id {id_type}, {numbers}, initials string, open {_OUTCOMES}, closing {_OUTCOMES}, lines {_LINES}"
    chunks = cut_lineage(dealt.mapInArrow(_chunks, chunk_schema))

    narrow = lambda c: F.transform(
        F.array_sort(c, lambda a, b: F.when(a["audit"] < b["audit"], -1).when(a["audit"] > b["audit"], 1).otherwise(0)),
        lambda o: F.struct(o["entry"], o["exit"], o["cost"]),
    ).alias(c)
    some = chunks.select("id", *_NUMBERS, "initials", narrow("open"), narrow("closing"))
    chosen_schema = (
        f"id {id_type}, part bigint, chunk bigint, piece bigint, closes boolean, entry string, exit string, "
        "gaps bigint, illegal bigint"
    )
    chosen = some.groupBy("id").applyInArrow(_chosen, chosen_schema)
    chosen = chosen.select(*(F.col(c).alias(f"_{c}") for c in chosen.columns))
    both = chunks.join(
        chosen,
        F.col("id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part")) & (F.col("chunk") == F.col("_chunk")),
    )
    found = F.when(F.col("_closes"), F.col("closing")).otherwise(F.col("open"))
    taken: Column = F.element_at(
        F.filter(found, lambda o: (o["entry"] == F.col("_entry")) & (o["exit"] == F.col("_exit"))), 1
    )
    audited = both.select(
        "id", F.col("_piece").alias("piece"), F.col("_gaps").alias("gaps"), *FAULTS[:3],
        F.col("_illegal").alias("illegal"), taken["cost"].alias("cost"), taken["audit"].alias("audit"),
        F.col("_entry").alias("entry"), "lines",
    )
    return audited.mapInArrow(_pieces, schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()

    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, group in groupby(rows, itemgetter(0)):
            last, held, number = None, [], 0
            for _, turn, role, text, later in group:
                row = (turn, role, text)
                held.append((turn, role, text, _fault(text, later or row == last)))
                last = row
                if len(held) == alternation.CHUNK:
                    yield key, part, number, *_chunk(held)
                    held, number = [], number + 1
            if held:
                yield key, part, number, *_chunk(held)

    return _with_ids(work, batches, _CHUNK_NAMES, _CHUNK_TYPES, 64)


def _chunk(rows: list[tuple]) -> tuple:
    turns, roles, texts, faults = zip(*rows, strict=True)
    known = {t for t in turns if t is not None}
    aligned = [_turn(r, f) for r, f in zip(roles, faults, strict=True)]
    ways = (
        [{"entry": e, "exit": x, "cost": c, "audit": a} for (e, x), (c, a) in outcomes(aligned, closing).items()]
        for closing in (False, True)
    )
    return (
        *_counts(roles, list(faults)), len(known), min(known, default=None), max(known, default=None),
        roles[0][:1].ljust(1) + roles[-1][:1].ljust(1), *ways,
        [{"role": r, "text": t} for r, t in zip(roles, texts, strict=True)],
    )


def _chosen(table: pa.Table) -> pa.Table:
    """The states that each chunk of one conversation goes between, from numbers alone.

    Outcomes come in order of their audits, so a place stands for an audit.
    """
    rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["chunk"]))
    each = []
    for i, row in enumerate(rows):
        ways = row["closing"] if i == len(rows) - 1 else row["open"]
        each.append({(w["entry"], w["exit"]): (w["cost"], f"{place:04}") for place, w in enumerate(ways)})
    _, path = chain(each)
    known = [r for r in rows if r["known"]]
    gaps = 0
    if known:
        # A turn that goes on in the next chunk was counted in both.
        shared = sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
        different = sum(r["known"] for r in known) - shared
        gaps = known[-1]["last_turn"] - known[0]["first_turn"] + 1 - different
    out = []
    for i, (row, (entry, to)) in enumerate(zip(rows, path, strict=True)):
        illegal = row["illegal"]
        if i:
            illegal += rows[i - 1]["initials"][1] + row["initials"][0] not in LAWFUL
        out.append(
            (row["part"], row["chunk"], i, i == len(rows) - 1, entry, to, gaps if i == 0 else 0, illegal)
        )
    types = [pa.int64()] * 3 + [pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
    names = ["id", "part", "chunk", "piece", "closes", "entry", "exit", "gaps", "illegal"]
    return pa.Table.from_arrays([table.column("id").combine_chunks(), *columns], names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, piece, *numbers, cost, audit, entry, lines in rows:
            kept = repaired(audit, [(r["role"], r["text"]) for r in lines], entry)
            yield key, piece, None, *numbers, cost, audit, [{"role": r, "text": t} for r, t in kept]

    return _with_ids(work, batches, _PIECE_NAMES, _PIECE_TYPES, 64)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def work(rows: Iterator[tuple]) -> Iterator[tuple]:
        for key, group in groupby(rows, itemgetter(0)):
            digest, sums, audits, begun = hashlib.sha256(), [0] * 6, [], False
            for _, _, *numbers, audit, text in group:
                sums = [a + b for a, b in zip(sums, numbers, strict=True)]
                audits.append(audit)
                if text is not None:
                    digest.update((("\n" if begun else "") + text).encode())
                    begun = True
            yield key, *sums, "".join(audits), digest.hexdigest()

    names = ["id", "gaps", *FAULTS, "cost", "audit", "repaired_sha256"]
    return _with_ids(work, batches, names, [*[pa.int64()] * 6, pa.string(), pa.string()], 1)
