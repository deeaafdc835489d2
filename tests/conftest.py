from __future__ import annotations

import sys
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tracewright.operators.skew import Skew
from tracewright.session import prepare

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = ("log string, case_id string, src_order long, activity string, ts timestamp, elem string, "
          "participant string, from_participant string, to_participant string, "
          "residual map<string,string>")


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "4g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return prepare(session)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def event(case, order, seconds, elem="task", who="A", sender=None, receiver=None, activity=None,
          log="log", residual=None):
    """One source event; times are seconds after the start."""
    return (log, case, order, activity or f"act{order % 4}", at(seconds), elem, who, sender, receiver,
            residual or {})


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def forced(src, limit=3):
    """Skew settings that cut every group of more than `limit` rows."""
    return Skew(rows=10**6, limit=limit, most_segments=10**9)


def same_rows(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    a = sorted(map(repr, left.select(columns).collect()))
    b = sorted(map(repr, right.select(columns).collect()))
    assert a == b
