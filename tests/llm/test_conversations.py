"""Repair of conversations against every possible edit, a plain search over states, and odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortkit.llm import alternation, conversations
from cohortkit.llm.alternation import Turn, repaired, whole
from cohortkit.llm.conversations import conversation_reports, repair_conversations
from cohortkit.llm.text_queries import op12_repair_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, piece int, rows string, part int"
NEXT = {"S": ("u", "O"), "Q": ("u", "O"), "E": ("u", "O"), "O": ("a", "E")}


def edits(turns, i=0, state="S", cost=0, audit="", most=0):
    """Every audit of at most a cost."""
    if cost > most:
        return
    if i == len(turns) and state in "SE":
        yield cost, audit
    letter, to = NEXT[state]
    yield from edits(turns, i, to, cost + 5, audit + "I", most)
    if i < len(turns):
        t = turns[i]
        yield from edits(turns, i + 1, state, cost + 2, audit + "D", most)
        if not t.must_go:
            if state == "S" and t.initial == "s":
                yield from edits(turns, i + 1, "Q", cost + t.extra, audit + "K", most)
            if t.initial == letter:
                yield from edits(turns, i + 1, to, cost + t.extra, audit + "K", most)
            yield from edits(turns, i + 1, to, cost + t.extra + 1, audit + "R", most)


def searched(turns):
    """The least cost and audit by a search over the grammar's states, row by row."""
    best = {"S": (0, "")}
    for t in [*turns, None]:
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                to = NEXT[state][1]
                best[to] = min(best.get(to, (1 << 40, "")), (cost + 5, audit + "I"))
        if t is None:
            break
        new = {}
        for state, (cost, audit) in best.items():
            letter, to = NEXT[state]
            ways = [(state, cost + 2, "D")]
            if not t.must_go:
                if state == "S" and t.initial == "s":
                    ways.append(("Q", cost + t.extra, "K"))
                ways += [(to, cost + t.extra, "K")] if t.initial == letter else []
                ways.append((to, cost + t.extra + 1, "R"))
            for way, c, edit in ways:
                new[way] = min(new.get(way, (1 << 40, "")), (c, audit + edit))
        best = new
    return min(best[s] for s in "SE" if s in best)


def some_turns(rng, n):
    return [Turn(rng.choice("suauauaux"), rng.random() < 0.15, 5 * (rng.random() < 0.15)) for _ in range(n)]


def test_against_every_edit():
    rng = random.Random(5)
    for _ in range(600):
        turns = some_turns(rng, rng.randint(0, 6))
        assert whole(turns) == min(edits(turns, most=2 * len(turns))) == searched(turns)


@pytest.mark.parametrize("chunk", [1, 2, 5, 64])
def test_chunks_join_to_the_same_audit(monkeypatch, chunk):
    monkeypatch.setattr(alternation, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(150):
        turns = some_turns(rng, rng.randint(0, 40))
        assert whole(turns) == searched(turns)


def report(rows):
    """(turn, role, text) of one conversation to its report, row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        content = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not content else "duplicate" if (role, text) in seen else ""
        faults.append(fault or ("" if content[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    turns = [
        Turn(role[:1], f in ("blank", "duplicate"), 5 * (f == "truncated")) for (_, role, _), f in zip(rows, faults)
    ]
    cost, audit = searched(turns)
    lines = repaired(audit, [r[1:] for r in rows])
    known = {t for t, _, _ in rows if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)


def some_rows(rng, key, n):
    texts = ["Yes.", "No!", "what", "  \n", "", "Fine?  ", "É…", None, "A much longer line. " * 20]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    for i in range(n):
        turn = rng.choice([None, i, i, i, i // 2, i + 3])
        text = rng.choice([*texts, f"Line {i}.", f"Line {i}."])
        yield key, turn, rng.choice(roles), text, "x", 1, "y", 2


def expected(rows):
    groups = {}
    for key, turn, role, text, *_ in rows:
        space = lambda v: " " if v is None else v
        groups.setdefault(key, []).append((turn, space(role), space(text)))
    return {key: report(group) for key, group in groups.items()}


def found(df):
    rows = conversation_reports(df).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    sizes = [1, 2, 3, 5, 8, 20, 90, 300, 500]
    return [r for k, n in enumerate([*sizes, *[6] * 40]) for r in some_rows(rng, None if k == 7 else k, n)]


def test_reports(spark, rows):
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected(rows)


def test_conversations_dealt_by_ranges_of_turn(spark, rows, monkeypatch):
    """The null id with 300 rows and another with 500 go in pieces over several tasks."""
    monkeypatch.setattr(conversations, "LARGE", 64)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    pieces = repair_conversations(df)
    assert pieces.filter("pieces is null").select("conv_id").distinct().count() == 3
    assert found(df) == expected(rows)


def test_pieces_hold_the_lines(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "So.")]
    piece = repair_conversations(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    (row,) = piece.collect()
    assert (row.piece, row.pieces, row.cost, row.audit) == (0, 1, 2, "DKK")
    assert [tuple(r) for r in row.repaired] == [("user", "Hi?"), ("assistant", "So.")]


def test_no_rows(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}


def test_the_query_on_nulls_and_lost_conversations(spark, tmp_path):
    rng = random.Random(8)
    rows = [r[:4] for k in [*range(120), None] for r in some_rows(rng, k, rng.choice([1, 1, 3, 6]))]
    columns = "conv_id bigint, turn bigint, role string, text string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for key, turn, role, text in rows:
        known = lambda v: " " if v is None else str(v)
        fault = zlib.crc32(f"{known(key)}:{known(turn)}".encode()) % 20
        role, text = "user" if fault == 4 else known(role), "" if fault == 1 else known(text)
        if fault == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        damaged += [(key, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    reports = expected(damaged)
    none = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    got = {r.conv_id: tuple(r)[1:] for r in op12_repair_conversations(spark, str(tmp_path)).collect()}
    assert got == {key: reports.get(key, none) for key in {r[0] for r in rows}}
    assert none in got.values()


def test_duplicates_are_kept_apart_by_role(spark):
    df = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "assistant", "A."), (1, 2, "user", "A.")], "conv_id int, turn int, role string, text string")
    row = repair_conversations(df).select("duplicate", "audit", F.size("repaired")).first()
    assert tuple(row) == (1, "KKD", 2)
