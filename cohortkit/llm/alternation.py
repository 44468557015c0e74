"""Alignment of a conversation's rows to the alternating grammar ``(s?(ua)+)?``.

Wagner-Fischer against every feasible length of the target string. All targets
that end alike are ends of one alternating string, so one table, filled from
the last row to the first, holds the cost for each length: the cell (i, j) is
that of aligning the rows from i on with the last j letters. Ukkonen's bands
keep it narrow: with an incumbent cost t no optimal path inserts more than
t / 5 or deletes more than t / 2. Audits of all lengths of least cost are
traced back and compared.

Long conversations are cut into chunks. A chunk is aligned for each state that
the text before can leave the grammar in, and the states are joined after.
"""

from __future__ import annotations

from dataclasses import dataclass

DELETE, INSERT, RENAME, UNENDED = 2, 5, 1, 5  # costs
CHUNK = 64  # rows aligned at once
ROLES = {"u": "user", "a": "assistant"}
FAR = 1 << 60

# States of the grammar: nothing yet, after s, after a, after u.
START, SYSTEM, EVEN, ODD = "S", "Q", "E", "O"
Outcomes = dict[tuple[str, str], tuple[int, str]]


@dataclass(frozen=True, slots=True)
class Turn:
    """What the alignment knows of a row: its role's initial, whether it must go, what keeping it costs."""

    initial: str
    must_go: bool
    extra: int


class _Table:
    """Costs of aligning the rows from i on with the last j letters of a string that ends in ``end``."""

    def __init__(self, turns: list[Turn], end: str, limit: int, closing: bool):
        self.turns, self.end, self.other = turns, end, "u" if end == "a" else "a"
        n = len(turns)
        fewer, more = limit // DELETE, limit // INSERT
        self.low = [max(0, n - i - fewer) for i in range(n + 1)]
        width = more if closing else 0
        row = [INSERT * j for j in range(width + 1)]
        rows = [row]
        for i in range(n - 1, -1, -1):
            turn, low, below = turns[i], self.low[i], self.low[i + 1]
            high = n - i + more
            after, last = row, below + len(row)
            row = []
            left = FAR
            keep, extra, must_go = turn.initial, turn.extra, turn.must_go
            for j in range(low, high + 1):
                best = after[j - below] + DELETE if below <= j < last else FAR
                if left + INSERT < best:
                    best = left + INSERT
                if not must_go and j > 0 and below <= j - 1 < last:
                    letter = end if j & 1 else self.other
                    cost = after[j - 1 - below] + extra + (0 if keep == letter else RENAME)
                    if cost < best:
                        best = cost
                row.append(best)
                left = best
            rows.append(row)
        self.rows = rows[::-1]

    def cost(self, i: int, j: int) -> int:
        at = j - self.low[i]
        row = self.rows[i]
        return row[at] if 0 <= at < len(row) else FAR

    def lengths(self) -> tuple[int, int]:
        """The lengths in the first band, the end exclusive."""
        return self.low[0], self.low[0] + len(self.rows[0])

    def audit(self, i: int, j: int) -> str:
        """The least path from a cell: of the edits that keep to its cost, the first by letter."""
        edits, n = [], len(self.turns)
        while i < n or j:
            cost = self.cost(i, j)
            if i < n and self.cost(i + 1, j) + DELETE == cost:
                edits.append("D")
                i += 1
            elif j and self.cost(i, j - 1) + INSERT == cost:
                edits.append("I")
                j -= 1
            else:
                kept = self.turns[i].initial == (self.end if j & 1 else self.other)
                edits.append("K" if kept else "R")
                i, j = i + 1, j - 1
        return "".join(edits)

    def with_system(self, j: int) -> tuple[int, str]:
        """Cost and least audit of all rows against s and the last j letters."""
        costs = [FAR]
        for i in range(len(self.turns) - 1, -1, -1):
            turn = self.turns[i]
            best = costs[-1] + DELETE
            if turn.initial == "s" and not turn.must_go:
                best = min(best, self.cost(i + 1, j) + turn.extra)
            costs.append(best)
        costs.reverse()
        if costs[0] >= FAR:
            return FAR, ""
        i = 0
        while costs[i + 1] + DELETE == costs[i]:
            i += 1
        return costs[0], "D" * i + "K" + self.audit(i + 1, j)


def _greedy(turns: list[Turn]) -> int:
    """Cost of one alignment that accepts: the incumbent to begin with."""
    cost, state = 0, START
    for turn in turns:
        if turn.must_go or (turn.initial == "s" and state != START):
            cost += DELETE
        elif turn.initial == "s":
            cost, state = cost + turn.extra, SYSTEM
        else:
            wanted = "a" if state == ODD else "u"
            step = turn.extra + (0 if turn.initial == wanted else RENAME)
            if step > DELETE:
                cost += DELETE
            else:
                cost, state = cost + step, EVEN if state == ODD else ODD
    return cost + {SYSTEM: 2 * INSERT, ODD: INSERT}.get(state, 0)


def align(turns: list[Turn], closing: bool, entries: str, exits: str) -> Outcomes:
    """Least cost and audit from each entry state to each exit state.

    Inserts stand before a row of the chunk, or at its end where the
    conversation closes with it. Equal costs take the least audit. Pairs that
    can't be are left out.
    """
    n = len(turns)
    out: Outcomes = {}
    for state in (START, SYSTEM):  # without any letter
        if state in entries and state in exits:
            out[state, state] = DELETE * n, "D" * n
    if START in entries and SYSTEM in exits:
        rows = [(t.extra, -i) for i, t in enumerate(turns) if t.initial == "s" and not t.must_go]
        if rows:
            extra, at = min(rows)
            out[START, SYSTEM] = DELETE * (n - 1) + extra, "D" * -at + "K" + "D" * (n - 1 + at)
    highest = (UNENDED + RENAME + INSERT) * n + 2 * INSERT
    limit = min(max(_greedy(turns), DELETE), highest)
    for end, state in (("a", EVEN), ("u", ODD)):
        if state not in exits:
            continue
        while True:
            table = _Table(turns, end, limit, closing)
            found = {e: _through(table, e, state) for e in entries}
            # The first incumbent is that of a whole conversation; other pairs of
            # states may cost more, and costs above the incumbent aren't exact.
            if entries == START or limit >= highest or all(c <= limit for c, _ in found.values()):
                break
            limit = min(2 * limit, highest)
        for entry, (cost, audit) in found.items():
            if cost < FAR:
                out[entry, state] = cost, audit
    return out


def _through(table: _Table, entry: str, state: str) -> tuple[int, str]:
    """The best of all target lengths from an entry state to where the table ends."""
    odd = (entry == ODD) != (state == ODD)  # parity of the letters between
    low, high = table.lengths()
    ways: list[tuple[int, int, bool]] = []
    systems: dict[int, tuple[int, str]] = {}
    for j in range(max(0, low - 1), high):  # with s before them, one letter less is enough
        if j % 2 != odd or (j == 0 and entry != state):
            continue
        ways.append((table.cost(0, j), j, False))
        if entry == START:
            systems[j] = table.with_system(j)
            ways.append((systems[j][0], j, True))
    if not ways:
        return FAR, ""
    least = min(ways)[0]
    if least >= FAR:
        return FAR, ""
    return least, min(systems[j][1] if s else table.audit(0, j) for cost, j, s in ways if cost == least)


def whole(turns: list[Turn]) -> tuple[int, str]:
    """Cost and audit of a conversation, chunk by chunk where it is long."""
    if len(turns) <= CHUNK:
        found = align(turns, True, START, START + EVEN)
        return min(found.values())
    chunks = [turns[i : i + CHUNK] for i in range(0, len(turns), CHUNK)]
    each = [outcomes(c, c is chunks[-1]) for c in chunks]
    cost, path = chain(each)
    return cost, "".join(found[pair][1] for found, pair in zip(each, path, strict=True))


def outcomes(chunk: list[Turn], closing: bool) -> Outcomes:
    """Of one chunk of several, between all states it may be met and left in."""
    every = START + SYSTEM + EVEN + ODD
    return align(chunk, closing, every, START + EVEN if closing else every)


def chain(each: list[Outcomes]) -> tuple[int, list[tuple[str, str]]]:
    """Least cost over chunks in order, and the states that each goes between.

    Audits of one chunk that differ are never one the other's beginning: each
    edits all rows of the chunk and ends with one. So the least audit of the
    conversation has in each chunk the least of those that keep to the cost.
    """
    ahead = [{START: 0, EVEN: 0}]
    for found in reversed(each):
        costs: dict[str, int] = {}
        for (entry, to), (cost, _) in found.items():
            if to in ahead[-1]:
                costs[entry] = min(costs.get(entry, FAR), cost + ahead[-1][to])
        ahead.append(costs)
    ahead.reverse()
    state, path = START, []
    for found, here, then in zip(each, ahead, ahead[1:], strict=False):
        ways = [
            (audit, to)
            for (entry, to), (cost, audit) in found.items()
            if entry == state and to in then and cost + then[to] == here[state]
        ]
        _, to = min(ways)
        path.append((state, to))
        state = to
    return ahead[0][START], path


def repaired(audit: str, rows: list[tuple[str, str]], state: str = START) -> list[tuple[str, str]]:
    """Role and text of the rows that the audit leaves, from a state of the grammar on."""
    out, at = [], 0
    for edit in audit:
        wanted = "a" if state == ODD else "u"
        if edit == "D":
            at += 1
            continue
        if edit == "I":
            out.append((ROLES[wanted], ""))
        else:
            role, text = rows[at]
            at += 1
            if edit == "K" and state == START and role[:1] == "s":
                out.append((role, text))
                state = SYSTEM
                continue
            out.append((role if edit == "K" else ROLES[wanted], text))
        state = EVEN if wanted == "a" else ODD
    return out
