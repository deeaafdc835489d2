"""Positions of rows in the files they come from, whatever the files' sizes and splits.

A row's place is its file, the start of the part of the file that was read in one go, and its number there.
Formats that know a row's number in its file (Parquet) have one part per file. Only the sizes of parts are
needed to turn places into positions: one row per file or split, joined back to the rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import materialize, small

PLACE = ["_position_file", "_position_part", "_position_row"]


def file_fields(df: DataFrame) -> list[str]:
    """What Spark tells of the files under a frame, nothing if the frame is more than a scan of files."""
    try:
        return [f.name for f in df.select("_metadata").schema[0].dataType.fields]
    except (AnalysisException, AttributeError):
        return []


def place_columns(df: DataFrame) -> list[Column]:
    """File, part and row of every row; without files one part and Spark's row ids."""
    known = file_fields(df)
    if "row_index" in known:
        place = F.col("_metadata.file_path"), F.lit(0).cast("long"), F.col("_metadata.row_index")
    elif "file_block_start" in known:
        place = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    else:
        place = F.lit(""), F.lit(0).cast("long"), F.monotonically_increasing_id()
    return [c.alias(name) for c, name in zip(place, PLACE)]


def place(df: DataFrame) -> Column:
    """The same as one value to order by, for rows of one file format."""
    return F.struct(*place_columns(df))


def positions(placed: DataFrame, name: str, scope: list[str] | None = None) -> DataFrame:
    """Rows with the columns `PLACE` replaced by their position `name` from 0, files in order of their paths.

    placed: read twice, so row ids in it must be written down. Files are numbered inside each value of `scope`.
    """
    scope = list(scope or [])
    part = [*scope, *PLACE[:2]]
    first, last = F.min(PLACE[2]), F.max(PLACE[2])
    parts = placed.groupBy(*part).agg(first.alias("_position_first"), (last - first + 1).alias("_position_rows"))
    # One row per file or split.
    order = Window.partitionBy(*scope or [F.lit(0)]).orderBy(*PLACE[:2])
    starts = materialize(parts.select(*part, (F.sum("_position_rows").over(order) - F.col("_position_rows")
                                              - F.col("_position_first")).alias("_position_shift")), "positions")
    return placed.join(small(starts), part).withColumn(name, F.col(PLACE[2]) + F.col("_position_shift")).drop(
        *PLACE, "_position_shift")


def with_position(df: DataFrame, name: str) -> DataFrame:
    """A frame with the position of its rows as `name`.

    A scan of files gives equal positions however its rows are dealt to files whose paths are in order, and
    however these are split. Any other frame gives Spark's row ids, which rise along its partitions.
    """
    known = file_fields(df)
    if "file_block_start" not in known:
        return df.withColumn(name, F.monotonically_increasing_id())
    placed = df.select("*", *place_columns(df))
    if "row_index" not in known:
        placed = materialize(placed, "placed")
    return positions(placed, name)
