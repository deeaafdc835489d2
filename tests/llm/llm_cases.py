"""Documents for the tests of this folder."""

from __future__ import annotations

from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def folder():
    if not Path(FOLDER).exists():
        pytest.skip("no test tables")
    return FOLDER


def documents(spark, rows):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns that clash on purpose."""
    rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return (spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS size", "2 AS score", "3 AS part", "4 AS key",
                                                         "5 AS bin", "6 AS length", "7 AS copies", "8 AS z"))


ODD = [(1, None), (2, ""), (None, "lonely words here"), (3, "same text"), (3, "same text"), (4, "x " * 30_000),
       (None, None), (5, " \t\n\x0b "), (6, "Zoë İÉ 🤦🏼‍♂️ 中文\n\nÀ"), (7, "same text")]
