"""Every registered query against its SQL in DuckDB, values and types."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from cohortkit.plans.catalog import QUERIES
from oracles import SQL

TABLES = "/root/testdata/sf0.01"
SCORED = {"lr_interests", "lr_demo", "lr_all"}

# The same type under the names of the two engines.
TYPE_NAMES = {
    "string": "VARCHAR",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for file in Path(TABLES).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, engine, name):
    df = contract.queries()[name](spark, TABLES)
    expected = engine.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    types = {d[0]: str(d[1]) for d in expected.description}
    rows = expected.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert {c: TYPE_NAMES[t] for c, t in df.dtypes} == types
    assert rows
    assert _bag(df.columns, df.collect()) == _bag(columns, rows)


@pytest.mark.parametrize("name", sorted(SCORED))
def test_models_score_every_test_row(spark, name):
    scored = contract.queries()[name](spark, TABLES)
    assert scored.columns == ["person_id", "Voters_Turnout", "probability", "prediction"]
    features = {"lr_interests": "model_features_interests", "lr_demo": "model_features_demo"}
    rows = contract.queries()[features.get(name, "model_features_all")](spark, TABLES)
    test = contract.queries()["hash_split"](spark, TABLES).filter("part = 'test'")
    expected = rows.join(test, "person_id", "left_semi").select("person_id")
    found = scored.select("person_id")
    assert expected.exceptAll(found).isEmpty() and found.exceptAll(expected).isEmpty()
    assert scored.filter("probability between 0 and 1").count() == scored.count() > 0


def test_model_reports_cover_the_test_rows(spark):
    rows = contract.queries()["model_features_all"](spark, TABLES)
    test = contract.queries()["hash_split"](spark, TABLES).filter("part = 'test'")
    expected = rows.join(test, "person_id", "left_semi").count()
    wide = contract.queries()["lr_all_confusion"](spark, TABLES).collect()
    assert sum(r["0.0"] + r["1.0"] + r["other"] for r in wide) == expected
    curve = contract.queries()["lr_all_roc"](spark, TABLES).toPandas().sort_values(["fpr", "tpr"])
    assert curve.iloc[0][["fpr", "tpr"]].tolist() == [0, 0]
    assert curve.iloc[-1][["fpr", "tpr"]].tolist() == [1, 1]
    assert curve["tpr"].is_monotonic_increasing


def test_entry_returns_rows(spark):
    assert contract.entry(spark).count() > 0
