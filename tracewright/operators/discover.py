"""What happens to which objects: types, activities, directly-follows relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.mapping import Relations
from tracewright.operators.ordered import OrderedGroups, next_row
from tracewright.operators.skew import Skew


def object_types(relations: Relations) -> DataFrame:
    return relations.objects.select("log", "otype").distinct()


def event_types(relations: Relations) -> DataFrame:
    return relations.events.select("log", "activity").distinct()


def activities_per_type(relations: Relations) -> DataFrame:
    """(log, otype, activity) of every activity that touches objects of the type."""
    events = relations.events.select("log", "eid", "activity")
    return (relations.e2o.select("log", "eid", "otype").distinct()
            .join(events, ["log", "eid"]).select("log", "otype", "activity").distinct())


def object_paths(relations: Relations) -> DataFrame:
    """One row per event and related object."""
    events = relations.events.select("log", "eid", "activity", "ts")
    joined = events.join(relations.e2o.select("log", "eid", "oid", "otype"), ["log", "eid"])
    # After the join the rows of an event are in one place, so this takes no further exchange.
    return joined.dropDuplicates(["log", "eid", "oid", "otype"])


def directly_follows(relations: Relations, skew: Skew | None = None) -> DataFrame:
    """Object-centric directly-follows graph.

    Per object type and pair of activities: distinct pairs of events, distinct objects, and pairs
    counted once for each object.
    """
    paths = OrderedGroups(object_paths(relations), ["log", "otype", "oid"], ["ts", "eid"], skew,
                          sizes=relations.e2o, of="edges")
    steps = paths.scan(_next=next_row("activity", "eid")).df().filter(F.col("_next").isNotNull())
    pair = ["log", "otype", "source", "target"]
    steps = steps.select("log", "otype", F.col("activity").alias("source"),
                         F.col("_next.activity").alias("target"), "eid", F.col("_next.eid").alias("to"), "oid")
    # Couples and objects are made distinct one after the other; two distinct counts in one
    # aggregation would hold every step three times.
    couples = (steps.groupBy(*pair, "eid", "to").agg(F.count(F.lit(1)).alias("n")).groupBy(*pair)
               .agg(F.count(F.lit(1)).alias("event_couples"), F.sum("n").alias("total_objects")))
    objects = (steps.groupBy(*pair, "oid").agg(F.lit(1).alias("one")).groupBy(*pair)
               .agg(F.count(F.lit(1)).alias("unique_objects")))
    same = [couples[c].eqNullSafe(objects[c]) for c in pair]
    return couples.join(objects, same).select(*[couples[c] for c in pair], "event_couples", "unique_objects",
                                              "total_objects")
