import hashlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortkit.llm import fingerprints as fp
from cohortkit.llm.spans import texts
from tests.llm.conftest import odd_rows

PARAGRAPH = st.text("ab é🙂\t", max_size=20)


def of(*strings):
    return fp.vectors(*texts(pa.array(strings, pa.string())))


@settings(deadline=None)
@given(st.lists(PARAGRAPH, min_size=1, max_size=5), st.lists(PARAGRAPH, min_size=1, max_size=5), st.randoms())
def test_homomorphic(one, two, random):
    shuffled = [*one, *two]
    random.shuffle(shuffled)
    a, b, both, mixed = of("\n".join(one), "\n".join(two), "\n".join([*one, *two]), "\n".join(shuffled))
    assert (fp.add(a, b) == both).all() and (mixed == both).all()
    assert (fp.remove(both, b) == a).all()
    assert (fp.read(fp.written(a[None])[0]) == a).all()


def test_unlike_texts_differ_and_like_ones_are_near():
    words = [f"w{k}" for k in range(400)]
    first, half, other = " ".join(words), " ".join(words[:200] + [f"v{k}" for k in range(200)]), " ".join(f"u{k}" for k in range(400))
    rows = of(first, half, other, "", "\n", " ", "a", "a ", first)
    assert len({r.tobytes() for r in rows}) == 8
    near = fp.likeness(rows[[0, 0, 0, 0, 3]], rows[[8, 1, 2, 3, 3]])
    assert near[0] == near[4] == 1 and 0.3 < near[1] < 0.7 and near[2] < 0.25 and near[3] == 0


def brute(rows):
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0], r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = of(text, edited, following)
        near = fp.likeness(np.stack([a, a]), np.stack([b, c]))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *fp.written(np.stack([a, b])), *near))
    return out


def key(r):
    return [(x is not None, x) for x in r]


def test_edits_of_odd_documents(odd, nothing):
    found = [tuple(r) for r in fp.fingerprint_with_edits(odd).collect()]
    assert sorted(found, key=key) == sorted(brute(odd_rows()), key=key)
    assert fp.fingerprint_with_edits(nothing).collect() == []


def test_a_lone_document_and_many(spark):
    lone = spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")
    assert fp.fingerprint_with_edits(lone).first()["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    rows = [(i * 3, f"text {i} " * (i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    found = [tuple(r) for r in fp.fingerprint_with_edits(docs).collect()]
    assert sorted(found, key=key) == sorted(brute(rows), key=key)
