"""Versioned object attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_attributes(versions: DataFrame, order: str = "row_order") -> DataFrame:
    """Latest non-null value per object and attribute, as (log, oid, attrs).

    `versions` has (log, oid, ocel_time, attrs, row_order): one row per change. Times are compared
    as text, as they are stored; of equal times the later row wins.
    """
    changes = versions.select("log", "oid", F.coalesce("ocel_time", F.lit("")).alias("at"), order,
                              F.explode("attrs").alias("attribute", "value"))
    latest = (changes.filter(F.col("value").isNotNull()).groupBy("log", "oid", "attribute")
              .agg(F.max_by("value", F.struct("at", order)).alias("value")))
    # One entry per attribute name of the object's type, not per version.
    return latest.groupBy("log", "oid").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("attribute", "value"))))
        .alias("attrs"))
