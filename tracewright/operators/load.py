"""Participant load: in how many other cases a participant is active at a moment.

A participant is active in an execution from its first to its last event there, ends included. The
number of active spans changes only at event times, so spans are first counted per participant and
time, a running sum over those times gives the active spans, and events look their time up by an
equi-join. No span is ever joined with the moments inside it. Few participants hold all times, which
is why the running sum uses `OrderedGroups`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ordered import OrderedGroups, sum_before
from tracewright.operators.skew import Skew
from tracewright.session import materialize


def participant_spans(trace: DataFrame) -> DataFrame:
    """First and last time of each participant in each execution."""
    return (trace.filter(F.col("actor") != "")
            .groupBy("log", "actor", "ci_oid", "case_id")
            .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


def active_spans(trace: DataFrame, keys: list[str], skew: Skew | None = None) -> DataFrame:
    """Spans open at each event time of a group: (*keys, ts, active)."""
    none = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    changes = F.explode(F.array(
        F.struct(F.col("first_ts").alias("ts"), one.alias("begun"), none.alias("ended")),
        F.struct(F.col("last_ts").alias("ts"), none.alias("begun"), one.alias("ended"))))
    bounds = participant_spans(trace).select(*keys, changes.alias("c")).select(*keys, "c.*")
    moments = trace.filter((F.col("actor") != "") & F.col("ts").isNotNull()).select(
        *keys, "ts", none.alias("begun"), none.alias("ended"))
    times = moments.unionByName(bounds).groupBy(*keys, "ts").agg(
        F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    # A group has no more times than its participant has events.
    groups = OrderedGroups(times, keys, ["ts"], skew, by=["log", "actor"], sizes=trace)
    groups = groups.scan(_open=sum_before(F.col("begun") - F.col("ended")))
    # A span that ends at this time is still open.
    return groups.df().select(*keys, "ts", (F.coalesce("_open", none) + F.col("begun")).alias("active"))


def with_load(trace: DataFrame, skew: Skew | None = None) -> DataFrame:
    """Add `load`: spans of the event's actor in other cases at the time of the event.

    Spans, times and events all need the trace, so it is computed once and written.
    """
    trace = materialize(trace, "trace")
    everywhere = active_spans(trace, ["log", "actor"], skew)
    rows = trace.join(everywhere, ["log", "actor", "ts"], "left")
    # An event lies in the span of its own execution. Executions that share a case id do not count
    # for each other either.
    own = F.lit(1)
    if not shared_cases(trace).isEmpty():
        same_case = active_spans(trace, ["log", "actor", "case_id"], skew)
        rows = rows.join(same_case.withColumnRenamed("active", "_own"),
                         ["log", "actor", "case_id", "ts"], "left")
        own = F.col("_own")
    return rows.withColumn("load", F.col("active") - own).select(*trace.columns, "load")


def shared_cases(trace: DataFrame) -> DataFrame:
    """Case ids of more than one execution."""
    executions = trace.select("log", "case_id", "ci_oid").distinct()
    return executions.groupBy("log", "case_id").count().filter(F.col("count") > 1).select(
        "log", "case_id")
