import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortkit.llm import token_files
from cohortkit.llm.queries import tokenizer_file
from tests.llm.conftest import odd_rows

TOKENIZER = tokenizer_file("byte_bpe_50k.json")


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, odd, tmp_path, encoding):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(odd, path, TOKENIZER, 0, encoding=encoding)
    library = Tokenizer.from_file(TOKENIZER)
    library.encode_special_tokens = True
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0], r[1] or ""))
    expected, start = [], 0
    for r in rows:
        ids = np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        expected.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    found = token_files.token_digests(token_files.read_token_files(spark, path)).collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected
    metadata = [pq.ParquetFile(f).metadata for f in (tmp_path / "tokens").glob("*.parquet")]
    groups = [m.row_group(k) for m in metadata for k in range(m.num_row_groups)]
    ids = [g.column(k) for g in groups for k in range(g.num_columns) if "tokens" in g.column(k).path_in_schema]
    assert any(c.has_dictionary_page for c in ids) == (encoding == "dictionary")
    assert encoding == "dictionary" or any("DELTA_BINARY_PACKED" in c.encodings for c in ids)
    assert all(c.has_offset_index for c in ids) and groups[0].column(0).has_column_index


def test_selective_reads(spark, odd, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(odd, path, TOKENIZER, 0)
    files = spark.read.parquet(path)
    counts = files.filter("id = 4").agg(F.sum("n_tokens"))
    plan = counts._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "tokens:array" not in scan and "EqualTo(id,4)" in scan


def test_no_documents(spark, nothing, tmp_path):
    path = str(tmp_path / "none")
    token_files.write_token_files(nothing, path, TOKENIZER, 0)
    assert token_files.read_token_files(spark, path).collect() == []
    with pytest.raises(ValueError):
        token_files.write_token_files(nothing, path, TOKENIZER, 0, encoding="plain")


def test_files_are_in_order_of_their_numbers(spark, tmp_path):
    """As text, part 100000 comes before part 99999."""
    for number, ids in ((99999, (1, 2)), (100000, (3, 4))):
        rows = [(i, k, 1, [i]) for k, i in enumerate(ids)]
        df = spark.createDataFrame(rows, "id bigint, file_start bigint, n_tokens int, tokens array<int>")
        df.coalesce(1).write.parquet(str(tmp_path / f"w{number}"))
        written = next((tmp_path / f"w{number}").glob("part-*.parquet"))
        (tmp_path / "all").mkdir(exist_ok=True)
        written.rename(tmp_path / "all" / f"part-{number}-x.snappy.parquet")
    found = token_files.read_token_files(spark, str(tmp_path / "all")).collect()
    assert {r.id: r.start for r in found} == {1: 0, 2: 1, 3: 2, 4: 3}
