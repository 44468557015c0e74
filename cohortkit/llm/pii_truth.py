"""Planted personal data: texts of known truth for the trees to learn from.

Nothing labels personal data in a corpus, and the base patterns can't: what
they find is kept anyway. So written-out and spaced forms, with made-up values,
and look-alikes are set into real contexts, cut from documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortkit.llm.text import whole

CONTEXTS = float("inf")  # documents that lend a context: no bound, each takes every form
AROUND = 40  # code points on either side

# Made-up values, by a hash of context and form.
Value = Callable[[Column], Column]


def _digits(h: Column, at: int, n: int) -> Column:
    """``n`` digits of a hash, of which there are 18; never all zero at the front."""
    text = F.lpad(F.pmod(h, F.lit(10**18)).cast("string"), 18, "7")
    return F.substring(text, at, n)


def _letters(h: Column, at: int, n: int) -> Column:
    return F.substring(F.translate(F.lower(F.hex(h)), "0123456789", "ghijklmnop"), at, n)


def _byte(h: Column, at: int) -> Column:
    return F.pmod(F.shiftright(h, 8 * at), F.lit(256)).cast("string")


def _hex(h: Column, at: int) -> Column:
    return F.lower(F.hex(F.pmod(F.shiftright(h, 8 * at), F.lit(60000)) + 4096))


def luhn_sum(digits: Column) -> Column:
    """Sum of Luhn's test over all digits."""
    turned = F.reverse(digits)

    def term(i: Column) -> Column:
        digit = F.substring(turned, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i))


def _card(h: Column) -> Column:
    """16 digits that pass Luhn's test."""
    front = F.concat(F.lit("4"), _digits(h, 1, 14))
    rest = F.pmod(luhn_sum(F.concat(front, F.lit("0"))), F.lit(10))
    return F.concat(front, F.pmod(F.lit(10) - rest, F.lit(10)).cast("string"))


def _fours(h: Column, between: str) -> Column:
    return F.regexp_replace(_card(h), "(.{4})(?=.)", f"$1{between}")


def _octets(h: Column, between: str) -> Column:
    return F.concat_ws(between, *(_byte(h, k) for k in range(4)))


def _phone(h: Column, form: str) -> Column:
    parts = {"a": _digits(h, 1, 3), "b": _digits(h, 5, 3), "c": _digits(h, 9, 4), "d": F.concat(F.lit("2"), _digits(h, 14, 1))}
    return F.concat(*(parts.get(x, F.lit(x)) for x in form))


def _mail(h: Column, at: str, dot: str, end: str | Column) -> Column:
    """Names of one part or two, every other one with digits."""
    second = F.when(F.pmod(F.shiftright(h, 13), F.lit(3)) == 0, F.concat(F.lit("."), _letters(h, 9, 4))).otherwise("")
    number = F.when(F.pmod(F.shiftright(h, 9), F.lit(2)) == 0, _digits(h, 3, 2)).otherwise("")
    last = F.lit(end) if isinstance(end, str) else end
    return F.concat(_letters(h, 1, 5), second, number, F.lit(at), _letters(h, 7, 6), F.lit(dot), last)


# Forms of personal data: kind, words that may stand before it, value.
GOOD: list[tuple[str, str, Value]] = [
    ("email", "mail", lambda h: _mail(h, "@", ".", "com")),
    ("email", "write to", lambda h: _mail(h, " [at] ", " [dot] ", "org")),
    ("email", "contact", lambda h: _mail(h, "(at)", ".", "net")),
    ("email", "mail", lambda h: _mail(h, " at ", " dot ", "com")),
    ("email", "e-mail:", lambda h: _mail(h, " @ ", " . ", "de")),
    ("ip", "host", lambda h: _octets(h, ".")),
    ("ip", "server", lambda h: _octets(h, "[.]")),
    ("ip", "address", lambda h: _octets(h, "(dot)")),
    ("ip", "host", lambda h: F.concat_ws(":", *(_hex(h, k % 5) for k in range(8)))),
    ("ip", "server", lambda h: F.concat(F.lit("fe80::"), _hex(h, 0), F.lit(":"), _hex(h, 2))),
    ("card", "card", _card),
    ("card", "pay with", lambda h: _fours(h, " ")),
    ("card", "card", lambda h: _fours(h, ".")),
    ("card", "credit", lambda h: _fours(h, "/")),
    ("card", "visa", lambda h: _fours(h, " - ")),
    ("card", "card", lambda h: F.translate(_card(h), "0123456789", "０１２３４５６７８９")),
    ("phone", "call", lambda h: _phone(h, "+1 (a) b-c")),
    ("phone", "tel", lambda h: _phone(h, "(a) b-c")),
    ("phone", "phone", lambda h: _phone(h, "a-b-c")),
    ("phone", "fax", lambda h: _phone(h, "a.b.c")),
    ("phone", "call", lambda h: _phone(h, "00d a b c")),
]
# Look-alikes that a generator may propose.
BAD: list[tuple[str, str, Value]] = [
    ("email", "look", lambda h: _mail(h, " at ", " dot ", "whatever")),
    ("email", "house", lambda h: _mail(h, " at ", " dot ", _letters(h, 2, 4))),
    ("email", "", lambda h: _mail(h, " @ ", " . ", _letters(h, 5, 2))),
    ("email", "mail", lambda h: _mail(h, " at ", " dot ", _letters(h, 4, 6))),
    ("email", "", lambda h: F.concat(_letters(h, 1, 4), F.lit("@"), _letters(h, 5, 4))),
    ("email", "price", lambda h: F.concat(_digits(h, 1, 2), F.lit(" @ "), _digits(h, 3, 2), F.lit(" . "), _digits(h, 5, 2))),
    ("ip", "at", lambda h: F.concat_ws(":", *(_digits(h, k, 2) for k in (1, 3, 5)))),
    ("ip", "ratio", lambda h: F.concat(_digits(h, 1, 1), F.lit("::"), _digits(h, 3, 1))),
    ("ip", "code", lambda h: F.concat(F.lit("std::"), _letters(h, 1, 2), F.lit("::"), _letters(h, 5, 3))),
    ("card", "part", lambda h: F.concat(F.lit("ID_"), _card(h))),
    ("card", "code", lambda h: F.concat(_card(h), F.lit("_"), _digits(h, 3, 2))),
    ("card", "total", lambda h: F.concat(F.lit("-"), _fours(h, "."), F.lit("="))),
    ("phone", "order", lambda h: F.concat(F.lit("#"), _phone(h, "a-b-c"), F.lit("-"), _digits(h, 2, 2))),
    ("phone", "ISBN", lambda h: F.concat(F.lit("978-"), _phone(h, "a-b-c"))),
    ("phone", "sum", lambda h: F.concat(F.lit("="), _phone(h, "a.b.c"), F.lit("%"))),
]


def planted(docs: DataFrame, text_column: str, kinds: tuple[str, ...]) -> DataFrame:
    """``truth`` (kind, start, end, good, by) and ``text``: one form in one context.

    Contexts come from all documents, equal texts once, from a place in the
    text by hash, with whole words on both sides. The words that a form may
    have before it stand there every other time; a number follows every fourth
    time. Documents without words at that place lend nothing.
    """
    text = whole(docs[text_column])
    by = F.xxhash64(text)
    at = F.pmod(by, F.greatest(F.length(text), F.lit(1)))
    near = F.substring(text, (at + 1).cast("int"), F.lit(2 * AROUND))
    lent = docs.select(by.alias("by"), near.alias("near")).filter(F.regexp_like("near", F.lit(r"\p{L}\s+\p{L}")))
    # Contexts are small and take long: as many tasks as the session's shuffles have.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lent = lent.repartition(tasks, "by").dropDuplicates(["by"])
    halves = lent.select(
        "by",
        F.regexp_extract("near", r"^\S*\s([\s\S]*?)\s\S*$", 1).alias("near"),
    ).select(
        "by",
        F.regexp_replace(F.substring("near", 1, AROUND), r"\S*$", "").alias("left"),
        F.substring("near", AROUND + 1, AROUND).alias("right"),
    )
    forms = []
    for good, some in ((True, GOOD), (False, BAD)):
        for k, (kind, before, value) in enumerate(some):
            h = F.xxhash64("by", F.lit(f"{good}{k}"))
            forms.append(
                F.struct(
                    F.lit(kinds.index(kind)).alias("kind"),
                    F.lit(good).alias("good"),
                    F.when(F.pmod(h, F.lit(2)) == 0, F.lit(before + " " if before else "")).otherwise("").alias("before"),
                    value(h).alias("value"),
                    F.when(F.pmod(h, F.lit(4)) < 3, "").otherwise(F.concat(F.lit("  "), _digits(h, 7, 6), F.lit(" "))).alias("after"),
                )
            )
    each = halves.select("*", F.explode(F.array(*forms)).alias("form"))
    start = F.length(F.concat("left", F.lit(" "), "form.before"))
    return each.select(
        F.struct(
            F.col("form.kind").alias("kind"),
            start.alias("start"),
            (start + F.length("form.value")).alias("end"),
            F.col("form.good").alias("good"),
            "by",
        ).alias("truth"),
        F.concat("left", F.lit(" "), "form.before", "form.value", F.lit(" "), "form.after", "right").alias("text"),
    )
