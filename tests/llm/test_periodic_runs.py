"""Periodic runs against a search of every period, on random, odd and empty texts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cohortkit.llm import words as words_module
from cohortkit.llm.periodic_runs import find_runs, periodic_runs
from cohortkit.llm.text_queries import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def every_run(words, shortest):
    """By start, then period: stretches on which words q apart are the same, least q of each."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, found):
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def some_words(rng):
    kinds, n = rng.choice([1, 2, 3, 5, 30]), rng.randint(0, rng.choice([5, 40, 150]))
    words = [rng.randrange(kinds) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(40):
        docs = [some_words(rng) for _ in range(rng.randint(1, 6))]
        shortest = rng.choice([2, 3, 5, 8, 12, 13])
        flat = np.array([x * 0x9E3779B97F4A7C15 % 2**64 for d in docs for x in d], np.uint64)
        first = np.cumsum([0, *map(len, docs)]).astype(np.int64)
        start, length, period = find_runs(flat, first, shortest)
        text = np.searchsorted(first, start, "right") - 1
        found = list(zip(text.tolist(), (start - first[text]).tolist(), length.tolist(), period.tolist()))
        assert found == [(i, *r) for i, d in enumerate(docs) for r in every_run(d, shortest)]


def test_far_repeats_with_equal_words_after_them_end():
    """Long repeated passages, after which words come again elsewhere."""
    rng = random.Random(9)
    passage = [rng.randrange(1000) for _ in range(40)]
    words = []
    for _ in range(30):
        words += passage + [rng.randrange(3) for _ in range(rng.randint(0, 60))]
    flat = np.array(words, np.uint64) + np.uint64(7)
    got = find_runs(flat, np.array([0, len(words)]), 12)
    assert list(zip(*(x.tolist() for x in got))) == every_run(words, 12)


def test_one_word_many_times():
    start, length, period = find_runs(np.full(50_000, 3, np.uint64), np.array([0, 50_000]), 12)
    assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [50_000], [1])


def test_parts_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(words_module, "PART", 20)
    rows = ["a b a b", "", "c " * 40, " \t", "d", "é é", "x y z"]
    found = [(row, to, len(w.hash)) for row, to, w in words_module.parts(pa.array(rows))]
    assert [f[:2] for f in found] == [(0, 2), (2, 3), (3, 7)]
    assert [f[2] for f in found] == [4, 40, 6]
    last = next(words_module.parts(pa.array(rows[3:])))[2]
    assert words_module.joined(last, last.starts >= 0).to_pylist() == ["", "d", "é é", "x y z"]
    assert words_module.joined(last, last.starts < 0).to_pylist() == ["", "", "", ""]


def test_whole_texts_with_nulls_and_odd_rows(spark, odd):
    found = periodic_runs(odd)
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]
    key = lambda r: tuple((x is not None, x) for x in r)
    rows = sorted(((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in found.collect()), key=key)
    expected = []
    for r in odd.collect():
        words = WORD.findall(r.text or "")
        # The texts of 30,000 equal words are one run by what they are.
        runs = [(0, 30_000, 1)] if len(words) >= 30_000 else every_run(words, 12)
        expected.append((r.doc_id, len(words), tuple(runs), collapsed(words, runs)))
    assert rows == sorted(expected, key=key)


def test_no_rows(nothing):
    assert periodic_runs(nothing).collect() == []


def test_texts_of_other_spaces_and_other_parameters(spark):
    text = "\t a b c\x0bd " * 3 + "é"
    df = spark.createDataFrame([("x", text), ("y", "one")], "key string, body string")
    found = {r.key: r for r in periodic_runs(df, "key", "body", shortest=6).collect()}
    assert [tuple(r) for r in found["x"].runs] == [(0, 9, 3)]
    assert found["x"].collapsed == "a b c d é" and found["y"].collapsed == "one"


def test_the_query_on_odd_texts(spark, tmp_path):
    """Ids that make a text periodic, with no words, few and many; null ids and texts."""
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "a b", "é è ê ë", " ".join(f"w{rng.randrange(9)}" for _ in range(90))]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:14] + list(range(1000, 1007)) + [None] * 7
    rows = [(i, texts[k % 7]) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for i, text in rows:
        words = WORD.findall(text or "")
        h = None if i is None else zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = every_run(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, runs))]
        milli = None if best[1] is None else 1000 * best[1] // best[2]
        expected.append((i, len(runs), *best, milli, *digests))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, op11_periodic_runs(spark, str(tmp_path)).collect()), key=key) == sorted(expected, key=key)
    assert any(r[1] for r in expected)
