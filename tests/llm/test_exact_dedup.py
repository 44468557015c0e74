import hashlib

import pytest

from cohortkit.llm import exact_dedup
from tests.llm.conftest import odd_rows, ordered

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_brute_force(odd, keep):
    low = lambda i: (i is not None, i)
    groups = {}
    for r in odd_rows():
        groups.setdefault((r[1] or "").translate(LOWER), []).append(r[0])
    expected = []
    for text, ids in groups.items():
        kept = (min if keep == "smallest" else max)(ids, key=low)
        digest = hashlib.sha256(text.encode()).hexdigest()
        first = True
        for i in ids:
            stays = first and i == kept
            first = first and not stays
            expected.append((i, kept, len(ids), stays, digest))
    found = exact_dedup.exact_duplicates(odd, keep=keep)
    key = lambda r: [(x is not None, x) for x in r]
    assert ordered(found) == sorted(expected, key=key)


def test_group_of_most_rows(spark):
    rows = [(i, "same text") for i in range(400)] + [(1000 + i, f"text {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    found = exact_dedup.exact_duplicates(docs)
    assert found.filter("keep_id = 0 AND group_size = 400").count() == 400
    assert found.filter("kept").count() == 51


def test_kept_documents_have_all_columns(odd, nothing):
    kept = exact_dedup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    texts = {(r[1] or "").translate(LOWER) for r in odd_rows()}
    assert sorted((r["text"] or "").translate(LOWER) for r in kept.collect()) == sorted(texts)
    assert exact_dedup.drop_exact_duplicates(nothing).collect() == []
    assert exact_dedup.exact_duplicates(nothing).collect() == []
