"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from tools.compare import rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("set timezone='UTC'")
    for table in os.listdir(FOLDER):
        connection.execute(f"create view {table.removesuffix('.parquet')} as select * from '{FOLDER}/{table}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    frame = QUERIES[name](spark, FOLDER)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert ours == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()


def test_descriptions_join_suggestions(spark):
    texts = [r["description"] for r in QUERIES["cx_13_description"](spark, FOLDER).collect()]
    titles = ("Extract Method", "Simplify Control Flow", "Reduce Nesting Depth", "Introduce Parameter Object", "Split Large Function", "Reduce Cognitive Complexity")
    assert max(t.count("\n- [") for t in texts) > 1
    assert sum(any(f"] {title}: " in t for t in texts) for title in titles) > 1


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "valid_from_us", "valid_to_us", "status", "resolved_at_us", "analysis_run_id"]


def test_names_of_both_sides():
    assert set(SQL) <= set(QUERIES)
