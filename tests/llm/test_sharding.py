import heapq
import zlib

from hypothesis import given
from hypothesis import strategies as st

from cohortkit.llm import sharding
from tests.llm.conftest import odd_rows


@given(st.lists(st.tuples(st.binary(max_size=4), st.integers(1, 9), st.integers(0, 99)), max_size=30))
def test_schedule_goes_to_the_least_loaded(items):
    load, rows = [0] * 4, [0] * 4
    expected = []
    for item, n, size in sorted(items, key=lambda x: (-x[2], x[0])):
        shard = load.index(min(load))
        expected.append((item, shard, rows[shard]))
        load[shard] += size
        rows[shard] += n
    assert sharding.schedule(items, 4) == expected
    assert heapq.nlargest(1, load)[0] <= sum(load) / 4 + max([x[2] for x in items], default=0)


def _check(found, rows, shards):
    assert len(found) == len(rows)
    together, slots = {}, {}
    texts = {}
    for i, text, *_ in rows:
        raw = (text or "").encode()
        texts.setdefault((i, len(raw) + 16, zlib.crc32(raw)), []).append(text or "")
    for r in found:
        assert 0 <= r["shard"] < shards
        key = (r["doc_id"], r["size"], r["text_crc32"])
        assert key in texts
        together.setdefault(texts[key][0], set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in together.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_documents(odd, nothing):
    _check(sharding.shard_by_size(odd, 3).collect(), odd_rows(), 3)
    assert sharding.shard_by_size(nothing, 3).collect() == []


def test_bundles_and_a_group_of_a_third(spark):
    rows = [(i, "copy " * 20) for i in range(300)] + [(1000 + i, f"text {i} " * (i % 7)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = sharding.shard_by_size(docs, 8, bundles=64)
    _check(found.collect(), rows, 8)
    loads = [r[1] for r in found.groupBy("shard").sum("size").collect()]
    rest = sorted(loads)[:-1]  # the largest shard has the copies
    assert max(rest) - min(rest) < 0.1 * max(rest)
    again = sharding.shard_by_size(docs.repartition(3), 8, bundles=64)
    assert found.exceptAll(again).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "doc_id bigint, text string")
    placed = sharding.shard_by_size(docs, 4)
    sharding.write_shards(docs, placed, str(tmp_path / "shards"))
    stored = spark.read.parquet(str(tmp_path / "shards"))
    assert stored.count() == 20 and {r[0] for r in stored.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_written_shards_keep_columns_of_the_same_names(spark, tmp_path):
    rows = [(i, f"t{i}", 100 + i, "own") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int, slot string")
    placed = sharding.shard_by_size(docs, 3)
    sharding.write_shards(docs, placed, str(tmp_path / "shards"))
    stored = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(tuple, stored.select(*docs.columns).collect())) == rows
    where = {r.doc_id: (r.shard_, r.slot_) for r in stored.collect()}
    assert where == {r.doc_id: (r.shard, r.slot) for r in placed.collect()}
