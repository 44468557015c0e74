import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortkit.llm.jaccard_join import Likeness
from cohortkit.llm.mixing import mix_sources
from tests.llm.test_exact_dedup import LOWER
from tests.llm.test_jaccard_join import brute
from tests.llm.test_mixing import whole_copies

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SMALL).persist())
    yield out
    for df in out[1:]:
        df.unpersist()


def test_stages_keep_the_columns_of_documents(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for df in results[1:-1]:
        assert df.columns == results[0].columns and df.dtypes == results[0].dtypes


def test_decisions_take_effect(results):
    docs, clean, exact, near, mixed, packed = results
    assert clean.count() > 0.8 * docs.count()
    texts = [r["text"].translate(LOWER) for r in exact.collect()]
    assert len(texts) == len(set(texts)) == len({r["text"].translate(LOWER) for r in clean.collect()})
    assert near.exceptAll(exact).count() == 0 and near.count() <= exact.count()
    sizes = {}
    for r in near.collect():
        sizes.setdefault(r["source"], []).append(len(r["text"].split()))
    words = sum(len(r["text"].split()) for r in mixed.collect())
    assert abs(words - 1.5 * sum(map(sum, sizes.values()))) <= sum(max(s) / 2 + 1 for s in sizes.values())
    assert {r["text"] for r in mixed.collect()} <= {r["text"] for r in near.collect()}
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()


def test_run_is_the_stages(spark, results):
    whole = lambda df: sorted(
        tuple(r) for r in df.groupBy("doc_id").agg(F.sum("length"), F.max("doc_tokens")).collect()
    )
    assert whole(corpus_pipeline.run(spark, SMALL)) == whole(results[-1])


def test_odd_documents(spark, odd):
    """Rows keep all their columns; of equal and like texts the smallest id stays, null before all."""
    results = [odd]
    for _, stage in corpus_pipeline.STAGES:
        results.append(stage(spark, results[-1], SMALL).persist())
    _, clean, exact, near, mixed, packed = results
    for before, after in zip(results[:4], results[1:4], strict=False):
        assert after.dtypes == odd.dtypes
        assert after.exceptAll(before).count() == 0
    order = lambda i: (i is not None, i)
    least = {}
    for r in clean.collect():
        text = (r["text"] or "").translate(LOWER)
        least[text] = min(least.get(text, r["doc_id"]), r["doc_id"], key=order)
    found = {(r["text"] or "").translate(LOWER): r["doc_id"] for r in exact.collect()}
    assert found == least and exact.count() == len(least)
    kept = sorted((str(i), str(i)) for i, _, c in brute(sorted_rows(exact), Likeness(5, 80, 100)) if i == c)
    assert {i for i, _ in kept} >= {str(r["doc_id"]) for r in near.collect()}
    whole_copies(near, mix_sources(near, (5, 2, 1), 1.5, 2), mixed)
    pieces = {}
    for r in packed.collect():
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r["length"])
    texts = {}
    for r in mixed.collect():
        texts[r["doc_id"]] = texts.get(r["doc_id"], 0) + 1
    assert {i for i, _ in pieces} == set(texts)
    for (_, tokens), lengths in pieces.items():
        assert sum(lengths) % tokens == 0 and sum(lengths) > 0
    for df in results[1:]:
        df.unpersist()


def sorted_rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_no_documents(spark, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).collect() == []
