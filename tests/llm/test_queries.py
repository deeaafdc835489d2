"""Registered queries against their SQL, and what the check of the repository expects of them."""

import sys
from pathlib import Path

import pytest

from llm_cases import folder  # noqa: F401

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as registry
from tools.compare import TABLES, normal
from tracewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.all_oracles()))
def test_query(spark, folder, name):
    import duckdb

    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    ours = registry.queries()[name](spark, folder).toPandas()
    theirs = database.execute(registry.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns) and normal(ours) == normal(theirs)


def test_all_are_registered():
    known = registry.queries()
    assert set(queries.registered()) <= set(known) and "pipeline" in known
