"""Bindings of general tables to the source-event schema.

Every source yields the same columns: log, case_id, src_order, activity, ts, elem, participant,
from_participant, to_participant and a map of residual attributes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.config import VOCABULARY as V
from tracewright.operators.ordered import OrderedGroups, sum_before
from tracewright.operators.skew import Skew

SOURCE_COLUMNS = ("log", "case_id", "src_order", "activity", "ts", "elem", "participant",
                  "from_participant", "to_participant", "residual")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events_log(spark: SparkSession, folder: str) -> DataFrame:
    """Click-stream events: one case per user and week, purchases sent, sign-ups received."""
    raw = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("int")

    def party(shift: int):
        return F.concat(F.lit("P"), ((k + shift) % 4).cast("string"))

    monday = F.date_format(F.trunc(F.col("ts").cast("date"), "week"), "yyyyMMdd")
    return raw.select(
        F.lit("events").alias("log"),
        F.concat_ws("-", F.col("user_id").cast("string"), monday).alias("case_id"),
        F.col("event_id").alias("src_order"),
        F.col("event_type").alias("activity"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "purchase", V.send_elem)
        .when(F.col("event_type") == "signup", V.receive_elem)
        .otherwise(V.task_elem).alias("elem"),
        party(0).alias("participant"),
        F.when(F.col("event_type") == "signup", party(3)).alias("from_participant"),
        F.when(F.col("event_type") == "purchase", party(1)).alias("to_participant"),
        F.map_filter(F.create_map(F.lit("value"), F.col("value").cast("string"),
                                  F.lit("props"), F.col("props")),
                     lambda _, v: v.isNotNull()).alias("residual"))


def orders_log(spark: SparkSession, folder: str, skew: Skew | None = None) -> DataFrame:
    """Order lines: one case per order, open lines sent, finished lines received; has time ties."""
    lines = table(spark, folder, "lineitem").select(
        F.lit("orders").alias("log"), F.col("l_orderkey").cast("string").alias("case_id"),
        "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_linestatus")

    def party(shift: int):
        return F.concat(F.lit("S"), ((F.col("l_suppkey") + shift) % 5).cast("string"))

    ranked = OrderedGroups(lines, ["log", "case_id"],
                           ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], skew)
    ranked = ranked.scan(src_order=sum_before(F.lit(1)))
    return ranked.df().select(
        "log", "case_id",
        F.coalesce(F.col("src_order"), F.lit(0)).cast("long").alias("src_order"),
        F.col("l_returnflag").alias("activity"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when(F.col("l_linestatus") == "O", V.send_elem)
        .when(F.col("l_linestatus") == "F", V.receive_elem)
        .otherwise(V.task_elem).alias("elem"),
        party(0).alias("participant"),
        F.when(F.col("l_linestatus") == "F", party(4)).alias("from_participant"),
        F.when(F.col("l_linestatus") == "O", party(1)).alias("to_participant"),
        F.expr("cast(map() as map<string,string>)").alias("residual"))
