"""Every registered query of the operators: its SQL, or its contract on whole small tables."""

import duckdb
import pytest

from cohortkit.llm import queries

TABLES = "/root/testdata/sf0.01"
COLUMNS = {
    "op2_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op3_mix_sources": "doc_id size source_size target taken",
    "op4_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op5_toxicity": "doc_id held_out score predicted",
    "op7_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_token_files": "doc_id start n_tokens ids_crc32",
}


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for name in ("documents", "pages", "conversations"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, engine, name):
    df = queries.QUERIES[name](spark, TABLES)
    expected = engine.execute(queries.SQL[name])
    names = [d[0] for d in expected.description]
    order = sorted(names)
    key = lambda r: [(x is not None, x) for x in r]
    rows = [tuple(r[names.index(c)] for c in order) for r in expected.fetchall()]
    assert sorted(map(tuple, df.select(*order).collect()), key=key) == sorted(rows, key=key)


def test_each_query_has_sql_or_columns_here():
    assert set(queries.QUERIES) == set(queries.SQL) | set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_every_document(spark, engine, name):
    df = queries.QUERIES[name](spark, TABLES)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    every = {r[0] for r in engine.execute("SELECT doc_id FROM documents").fetchall()}
    found = [r[0] for r in df.select("doc_id").collect()]
    assert set(found) == every and (len(found) == len(every) or name == "op2_packing")
