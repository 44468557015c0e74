import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from cohortkit.llm import warc
from cohortkit.llm.queries import op1_warc

PAGES = [
    (1, "http://a/é?x=1\r\n", "<p>same</p>"),
    (5, "http://b/", "<p>same</p>"),
    (3, "http://c/", "<p>same</p>"),
    (5, "http://b/", "<p>same</p>"),
    (7, None, None),
    (8, "u", ""),
    (9, "u", "ÄÖ🙂 " * 50_000),
    (10, "u", "<P>same</P>"),
    (None, "u", "null id"),
]


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pages(spark, rows=PAGES):
    # Extra columns with names that are used inside.
    rows = [(*r, "x", 1, "y") for r in rows]
    schema = "page_id bigint, url string, html string, payload string, salt int, first string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    path = str(tmp_path / "archive")
    warc.write_warc(warc.page_records(pages(spark), least=least), path, file_bytes=100)
    found = warc.read_warc(spark, path).filter("record_type <> 'warcinfo'").collect()
    expected = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "")]
        first = max(same, key=lambda p: (p is not None, p))
        revisit = len(raw) >= least and i != first
        name = lambda p: f"urn:page:{'' if p is None else p}"
        kind = "revisit" if revisit else "response"
        expected.append((name(i), kind, name(first) if revisit else "", sha(raw), len(raw), b"" if revisit else raw))
    got = [
        (r["record_id"], r["record_type"], r["refers_to"] or "", r["payload_digest"], r["payload_bytes"], bytes(r["payload"] or b""))
        for r in found
    ]
    assert sorted(got) == sorted(expected)


def test_filters_reach_the_files(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_warc(warc.page_records(pages(spark)), path)
    records = warc.read_warc(spark, path, ["record_id", "record_type"])
    some = records.filter(F.col("record_type").isin("revisit") & F.col("record_id").startswith("urn:page:3"))
    assert [tuple(r) for r in some.collect()] == [("urn:page:3", "revisit")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("PushedFilters", "")
    reader = warc._Reader(path, ["record_id"])
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "response"), warc.EqualTo(("payload_bytes",), 3)]))
    assert [f.attribute for f in left] == [("payload_bytes",)] and len(reader.tests) == 1


class Counting:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.data, self.at, self.got = data, 0, 0

    def size(self):
        return len(self.data)

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.got += len(out)
        self.at += len(out)
        return out


def _records(n, size):
    import random

    random.seed(1)
    for k in range(n):
        block = bytes(random.randrange(256) for _ in range(size))
        yield warc.record({"WARC-Type": "resource", "WARC-Record-ID": f"<r{k}>"}, block), block


@pytest.mark.parametrize("form", ["sl", "gzip", "plain"])
def test_headers_first_and_blocks_skipped(form, monkeypatch):
    monkeypatch.setattr(warc, "READ", 64)
    monkeypatch.setattr(warc, "HEAD", 64)
    made = list(_records(5, 4000))
    pack = {"sl": warc.member, "gzip": gzip.compress, "plain": lambda raw: raw}[form]
    file = Counting(b"".join(pack(raw) for raw, _ in made))
    wanted = lambda h: True if h["warc-record-id"] == "<r3>" else None
    found = list(warc.records(file, wanted))
    assert [(h["warc-record-id"], b) for h, b in found] == [("<r3>", made[3][1])]
    assert (file.got < len(file.data) / 2) == (form != "gzip")
    headers = [(h["warc-record-id"], b) for h, b in warc.records(file, lambda h: False)]
    assert headers == [(f"<r{k}>", None) for k in range(5)]


def test_damage_is_an_error(spark, tmp_path):
    raw = warc.member(next(_records(1, 500))[0])
    with pytest.raises(ValueError):
        list(warc.records(Counting(raw[:-50]), lambda h: True))
    bad = {"WARC-Type": "resource", "WARC-Record-ID": "<r>", "WARC-Payload-Digest": "sha1:" + "A" * 32}
    file = tmp_path / "bad.warc.gz"
    file.write_bytes(warc.member(warc.record(bad, b"text")))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, str(file)).collect()


def test_orphans_of_failed_tasks_are_not_read(spark, tmp_path):
    path = tmp_path / "archive"
    warc.write_warc(warc.page_records(pages(spark)), str(path))
    (path / "orphan.warc.gz").write_bytes(warc.member(next(_records(1, 10))[0]))
    assert warc.read_warc(spark, str(path)).filter("record_type = 'resource'").count() == 0


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_warc(warc.page_records(pages(spark, [])), path)
    assert warc.read_warc(spark, path).collect() == []


def test_the_query_on_negative_and_null_ids(spark, tmp_path):
    rows = [(-5, "u", "same"), (-7, "u", "same"), (3, "u", None), (None, "u", "alone")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in op1_warc(spark, str(tmp_path)).collect()}
    assert found == {-5: (4, "response", None), -7: (4, "revisit", -5), 3: (0, "response", None), None: (5, "response", None)}
