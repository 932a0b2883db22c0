"""Every query of the engine against its SQL, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from gridseek import catalogue

NAMES = list(catalogue.QUERIES)


@pytest.fixture(scope="module")
def sql(sf_dir):
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, sql, name):
    frame = entry.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    if name not in entry.oracle_sql():
        assert got
        return
    result = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(row[names.index(c)] for c in columns)) for row in result.fetchall())


def test_entry(spark):
    if os.path.isdir(entry.SMOKE_DIR):
        assert entry.entry(spark).columns == ["dataset_id", "overlap"]


def test_plans_push_down(spark, sf_dir):
    """Scans read the columns that are needed, and cells are counted before their shuffle."""
    plan = catalogue.cells(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_quantity" not in plan and "partial_count" in plan and "CartesianProduct" not in plan
