"""Registered queries against their SQL on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as registry  # noqa: E402
from oracles import all_oracles  # noqa: E402
from tools.compare import TABLES, normal  # noqa: E402
from tracewright.plans.queries import registered  # noqa: E402

ORACLES = all_oracles()


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, database, name):
    ours = registry.queries()[name](spark, FOLDER).toPandas()
    theirs = database.execute(ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


def test_all_but_learners_have_sql():
    assert set(registered()) - set(ORACLES) == {"cv_forest"}
    assert set(registered()) <= set(registry.queries()) and set(ORACLES) <= set(registry.oracle_sql())
