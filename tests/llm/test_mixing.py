import math
import re

import pytest

from cohortkit.llm import mixing
from tests.llm.conftest import odd_rows, ordered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights, share, limit):
    """Share, stop at the limit, share the excess on, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return full
        level = left / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > limit * sizes[s] + 1e-9]
        if not above:
            return full | {s: level * weight[s] for s in free}
        for s in above:
            full[s] = limit * sizes[s]
            left -= full[s]


def check(rows, found, weights, share, limit):
    size = lambda t: len(WORD.findall(t or ""))
    sizes, taken, got = {}, {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    expected = targets(sizes, weights, share, limit)
    for r in found:
        s = r["source"]
        assert r["source_size"] == sizes[s] and 0 <= r["taken"] <= limit * r["size"]
        assert r["target"] == pytest.approx(expected[s], abs=1e-6)
        taken[s] = taken.get(s, 0) + r["taken"]
        got[s] = got.get(s, 0) + 1
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= 0.5 + 1e-6
        assert got[s] == sum(r[3] == s for r in rows)
    partly = [r["source"] for r in found if r["size"] and r["taken"] % r["size"]]
    assert len(partly) == len(set(partly))


@pytest.mark.parametrize(("weights", "share", "limit"), [((5, 2, 1), 1.5, 2), ((1, 1), 0.5, 2), ((9, 1), 2.5, 3)])
def test_targets_to_the_word(odd, weights, share, limit):
    found = mixing.mix_sources(odd, weights, share, limit).collect()
    check(odd_rows(), found, weights, share, limit)


def test_class_of_a_third_of_all_rows(spark):
    rows = [(i, "w " * 30, "en", "a") for i in range(300)]
    rows += [(1000 + i, "w " * (i % 90), "en", "abcd"[i % 4]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = mixing.mix_sources(docs.repartition(4), (5, 2, 1), 1.5, 2)
    check(rows, found.collect(), (5, 2, 1), 1.5, 2)
    again = mixing.mix_sources(docs.repartition(7), (5, 2, 1), 1.5, 2)
    assert ordered(found) == ordered(again)


def test_rates_are_the_exponential_tilt(spark):
    sizes = [1, 2, 3, 5, 8, 13, 21, 34] * 200
    rows = [(i, "w " * n, "en", "ab"[i % 2]) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = mixing.mix_sources(docs, (1, 4), 0.8, 2).collect()
    for source in "ab":
        mine = [r for r in found if r["source"] == source]
        words = {n: (sum(r["taken"] for r in mine if r["size"] == n), sum(r["size"] for r in mine if r["size"] == n)) for n in {r["size"] for r in mine}}
        low, high = -5.0, 5.0
        for _ in range(100):
            at = (low + high) / 2
            total = sum(w * min(2, math.exp(min(at * n, 50))) for n, (_, w) in words.items())
            low, high = (at, high) if total < mine[0]["target"] else (low, at)
        for n, (took, all_words) in words.items():
            assert abs(took - all_words * min(2, math.exp(at * n))) <= 2 * n


def whole_copies(docs, mixed, taken):
    """Each row that came out is one of the given, and each source is near its target."""
    size = lambda t: len(WORD.findall(t or ""))
    given = {tuple(r) for r in docs.collect()}
    words, largest = {}, {}
    for r in taken.collect():
        assert tuple(r) in given
        words[r["source"]] = words.get(r["source"], 0) + size(r["text"])
    for r in docs.collect():
        largest[r["source"]] = max(largest.get(r["source"], 0), size(r["text"]))
    for r in mixed.select("source", "target").distinct().collect():
        assert abs(words.get(r["source"], 0) - r["target"]) <= largest[r["source"]] / 2 + 1


def test_taken_documents(spark, odd, nothing):
    docs = spark.createDataFrame(
        [(i, f"a{i} b{i}  c{i}\nd{i}", "s" if i % 3 else None, 9) for i in range(30)],
        "doc_id bigint, text string, source string, n_chars int",
    )
    for given in (docs, odd):
        mixed = mixing.mix_sources(given, (3, 1), 1.2, 2)
        out = mixing.take(given, mixed)
        assert out.dtypes == given.dtypes
        whole_copies(given, mixed, out)
    assert mixing.mix_sources(nothing).collect() == []
    assert mixing.take(nothing, mixing.mix_sources(nothing)).collect() == []


def test_rows_that_repeat_id_and_text_keep_their_own_columns(spark):
    rows = [(1, "one two", "s", k) for k in range(5)] + [(k, f"text {k} more", "s", k) for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, own int")
    out = mixing.take(docs, mixing.mix_sources(docs, (1,), 2, 2))
    assert sorted(map(tuple, out.collect())) == sorted(rows * 2)


def test_an_end_without_a_solution_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 1)
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    with pytest.raises(RuntimeError, match="multipliers"):
        mixing.mix_sources(docs, (1, 7), 0.9, 2)
