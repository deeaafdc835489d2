"""Writing result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns are written as JSON."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("array", "map", "struct")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option(
        "header", True).csv(path)
