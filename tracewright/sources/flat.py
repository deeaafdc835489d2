"""Flat event frames: column check, cleaning, residual attributes, and the log registry."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.config import VOCABULARY, LogSpec, SourceColumns, Vocabulary
from tracewright.functions.columns import clean, columns_to_map, parse_time
from tracewright.session import materialize
from tracewright.sources.position import with_position


def require_columns(df: DataFrame, names: SourceColumns = SourceColumns()) -> None:
    """Raise if a mandatory column is missing; warn about missing optional ones."""
    missing = [c for c in names.mandatory if c not in df.columns]
    if missing:
        raise ValueError(f"event log lacks mandatory columns: {', '.join(missing)}")
    absent = [c for c in names.optional if c not in df.columns]
    if absent:
        warnings.warn(f"event log lacks optional columns: {', '.join(absent)}", stacklevel=2)


def source_events(df: DataFrame, log: str, names: SourceColumns = SourceColumns(),
                  order_column: str | None = None,
                  vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """Source-event schema from a flat frame with one row per event.

    `order_column` holds the position in the source; without it rows of a scan of files are numbered along
    the files, in order of their paths, and rows of any other frame by Spark's row ids. Columns that are not configured become residual
    attributes, except internal ones that start with two underscores. Timestamp text that cannot be
    read is kept in `unread_ts`.
    """
    require_columns(df, names)

    def text(name: str):
        return clean(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("string")

    raw_ts = F.col(f"`{names.timestamp}`")
    is_text = dict(df.dtypes)[names.timestamp] == "string"
    rest = [c for c in df.columns
            if c not in names.consumed and c not in (order_column, vocabulary.elem_type_attr)
            and not c.startswith("__")]
    ts = parse_time(raw_ts) if is_text else raw_ts.cast("timestamp")
    if not order_column:
        df, order_column = with_position(df, "__position"), "__position"
    return df.select(
        F.lit(log).alias("log"),
        F.col(f"`{names.case}`").cast("string").alias("case_id"),
        F.col(f"`{order_column}`").cast("long").alias("src_order"),
        F.col(f"`{names.activity}`").cast("string").alias("activity"),
        ts.alias("ts"), F.when(ts.isNull(), raw_ts.cast("string")).alias("unread_ts"),
        F.coalesce(text(names.elem_type), F.lit(vocabulary.task_elem)).alias("elem"),
        text(names.participant).alias("participant"),
        text(names.from_participant).alias("from_participant"),
        text(names.to_participant).alias("to_participant"),
        columns_to_map(rest).alias("residual"))


def unreadable_times(df: DataFrame, names: SourceColumns = SourceColumns()) -> DataFrame:
    """Number of events whose timestamp text is present but cannot be read."""
    raw = F.col(f"`{names.timestamp}`")
    return df.agg(F.count_if(raw.isNotNull() & parse_time(raw.cast("string")).isNull())
                  .cast("long").alias("unreadable"))


def read_logs(specs: Iterable[LogSpec], reader: Callable[[LogSpec], DataFrame]
              ) -> tuple[DataFrame | None, list[dict[str, str]]]:
    """All readable logs as one frame, and one error row for each log that cannot be read.

    Every log is read and written once, so that a file which breaks half-way is found here and stops no
    other log. Every operator carries the `log` column, so one job handles all logs from then on.
    """
    frames, errors = [], []
    for spec in specs:
        try:
            frames.append(materialize(reader(spec), "log"))
        except Exception as problem:  # a log that cannot be read must not stop the others
            errors.append({"log": spec.name, "error": str(problem)})
    union = reduce(lambda a, b: a.unionByName(b), frames) if frames else None
    return union, errors
