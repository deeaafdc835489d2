"""Event-log XML files, read with Spark's XML source: one row per trace element."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.config import VOCABULARY, SourceColumns, Vocabulary
from tracewright.functions.columns import clean, last_wins, parse_time
from tracewright.session import materialize, small
from tracewright.sources.position import PLACE, place_columns, positions

_PAIRS = "ARRAY<STRUCT<_key: STRING, _value: STRING>>"
# Element names of typed attributes in the event-log standard.
ATTRIBUTE_ELEMENTS = ("string", "date", "int", "float", "boolean", "id")
_ATTRIBUTES = ", ".join(f"`{name}`: {_PAIRS}" for name in ATTRIBUTE_ELEMENTS)
TRACE_SCHEMA = (", ".join(f"`{name}` {_PAIRS}" for name in ATTRIBUTE_ELEMENTS)
                + f", event ARRAY<STRUCT<{_ATTRIBUTES}>>")


def _attributes(parent: str | None = None) -> Column:
    """All typed attributes of an element, as (key, value) texts."""
    lists = [F.coalesce(F.col(f"{parent}.{name}" if parent else f"`{name}`"),
                        F.expr("cast(array() as array<struct<_key:string,_value:string>>)"))
             for name in ATTRIBUTE_ELEMENTS]
    return F.filter(F.concat(*lists), lambda a: a["_key"].isNotNull())


def _traces(spark: SparkSession, paths: str | list[str], encoding: str) -> DataFrame:
    return (spark.read.format("xml").option("rowTag", "trace").option("encoding", encoding)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
            .schema(f"{TRACE_SCHEMA}, _broken string").load(paths))


def _events(traces: DataFrame) -> DataFrame:
    """Placed events as attribute pairs, and trace elements that cannot be read, as they are."""
    case_attrs = F.transform(_attributes(), lambda a: F.named_struct(
        F.lit("_key"), F.concat(F.lit("case:"), a["_key"]), F.lit("_value"), a["_value"]))
    whole = traces.select(*place_columns(traces), case_attrs.alias("_case"),
                          F.substring("_broken", 1, 200).alias("_broken"),
                          F.when(F.col("_broken").isNull(), F.col("event")).alias("event"))
    events = whole.select(*PLACE[:2], "_case", "_broken", F.explode_outer("event").alias("_event"))
    return events.filter("_event IS NOT NULL OR _broken IS NOT NULL").select(
        *PLACE[:2], F.monotonically_increasing_id().alias(PLACE[2]), "_broken",
        F.concat("_case", _attributes("_event")).alias("_pairs"))


def _source_events(rows: DataFrame, names: SourceColumns, vocabulary: Vocabulary) -> DataFrame:
    rows = rows.select("log", "src_order", F.map_from_entries(last_wins(F.col("_pairs"), "_key")).alias("_all"))
    value = F.col("_all")
    ts = parse_time(value[names.timestamp])
    consumed = F.array(*[F.lit(c) for c in sorted(names.consumed | {vocabulary.elem_type_attr})])
    residual = F.map_filter(value, lambda k, v: ~F.array_contains(consumed, k) & v.isNotNull())
    return rows.select(
        "log", value[names.case].alias("case_id"), "src_order",
        value[names.activity].alias("activity"), ts.alias("ts"),
        F.when(ts.isNull(), value[names.timestamp]).alias("unread_ts"),
        F.coalesce(clean(value[names.elem_type]), F.lit(vocabulary.task_elem)).alias("elem"),
        clean(value[names.participant]).alias("participant"),
        clean(value[names.from_participant]).alias("from_participant"),
        clean(value[names.to_participant]).alias("to_participant"), residual.alias("residual"))


def read_event_log(spark: SparkSession, path: str, log: str, names: SourceColumns = SourceColumns(),
                   encoding: str = "utf-8", vocabulary: Vocabulary = VOCABULARY) -> DataFrame:
    """Source events of one file or folder.

    Attributes of the trace take part as `case:<key>`; what the configuration does not name becomes
    residual. Of attributes that repeat a key the last one counts. The source position counts events from 0
    along the file, and along the files of a folder in order of their paths. The log is parsed once, here; a
    file that is not well-formed raises.
    """
    found, errors = read_event_logs(spark, {log: path}, names, encoding, vocabulary)
    if errors:
        raise ValueError(f"event log {log}: {errors[0]['error']}")
    return found


def read_event_logs(spark: SparkSession, paths: Mapping[str, str], names: SourceColumns = SourceColumns(),
                    encoding: str = "utf-8", vocabulary: Vocabulary = VOCABULARY
                    ) -> tuple[DataFrame | None, list[dict[str, str]]]:
    """Source events of all readable logs, and one error row for each other log, by name.

    paths: a file or folder per log. One scan reads all of them; a trace element that is not well-formed makes
    its whole log an error and touches no other. The driver only lists files, as any read does.
    """
    errors, files = {}, {}
    for log, path in paths.items():
        try:
            files[log] = _traces(spark, path, encoding).inputFiles()
        except AnalysisException as problem:
            errors[log] = str(problem)
    owner = [(re.sub("^file:/+", "file:/", name), log) for log, found in files.items() for name in found]
    if not owner:
        return None, [{"log": log, "error": errors[log]} for log in errors]
    logs = spark.createDataFrame(owner, f"{PLACE[0]} string, log string")
    events = _events(_traces(spark, list(dict.fromkeys(paths[log] for log in files)), encoding))
    rows = materialize(events.join(small(logs), PLACE[0]), "event-logs")
    broken = rows.filter(F.col("_broken").isNotNull()).groupBy("log").agg(
        F.min("_broken").alias("text"))
    for row in broken.collect():        # at most one row per log
        errors[row["log"]] = f"trace element that is not well-formed: {row['text']}"
    told = [{"log": log, "error": errors[log]} for log in paths if log in errors]
    good = rows.filter(~F.col("log").isin([log for log in files if log in errors])).drop("_broken")
    if all(log in errors for log in paths):
        return None, told
    return _source_events(positions(good, "src_order", ["log"]), names, vocabulary), told
