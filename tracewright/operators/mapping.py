"""From a collaborative event log to the object-centric relations.

Events, objects, event-to-object and object-to-object relations all come from the matched event
frame by one pass each: a row yields its relations through `explode`, and repeated objects or
edges are removed by an aggregation that combines on the map side.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.config import VOCABULARY, Vocabulary
from tracewright.functions.columns import (instance_id, local_case_id, message_id, no_nulls,
                                           participant_id)
from tracewright.operators.match import match_messages
from tracewright.operators.skew import Skew
from tracewright.session import materialize

EVENT_COLUMNS = ["log", "eid", "activity", "ts", "elem_type", "src_order", "residual"]
OBJECT_COLUMNS = ["log", "oid", "otype", "attrs"]
E2O_COLUMNS = ["log", "eid", "oid", "otype", "qualifier"]
O2O_COLUMNS = ["log", "src_oid", "tgt_oid", "qualifier"]


@dataclass(frozen=True)
class Relations:
    """The four relations of an object-centric log, all lazy."""

    events: DataFrame
    objects: DataFrame
    e2o: DataFrame
    o2o: DataFrame


def transform(src: DataFrame, skew: Skew | None = None, vocabulary: Vocabulary = VOCABULARY,
              keep: bool = False) -> Relations:
    """Object-centric relations of source events.

    With `keep` the matched events are written once and the four relations read that table;
    otherwise each relation derives them anew, which is cheaper if only one is used.
    """
    matched = match_messages(src, skew)
    return relations_of(materialize(matched, "matched") if keep else matched, vocabulary)


def relations_of(matched: DataFrame, vocabulary: Vocabulary = VOCABULARY) -> Relations:
    return Relations(event_rows(matched), object_rows(matched, vocabulary),
                     event_object_rows(matched, vocabulary),
                     object_object_rows(matched, vocabulary))


def event_rows(matched: DataFrame) -> DataFrame:
    return matched.select("log", F.col("event_id").alias("eid"), "activity", "ts",
                          F.col("elem").alias("elem_type"), "src_order",
                          no_nulls(F.col("residual")).alias("residual"))


def _instance() -> Column:
    return instance_id(F.col("case_id"))


def _local_case() -> Column:
    return local_case_id(F.col("case_id"), F.col("participant"))


def _message() -> Column:
    return message_id(F.col("sent.event_id"))


def _one_each(rows: DataFrame, items: list[Column]) -> DataFrame:
    """One output row per struct in `items` whose condition held (others are NULL)."""
    # Spark has no generated code for filters of arrays, but for those of rows.
    return (rows.select("log", F.explode(F.array(*items)).alias("item"))
            .filter(F.col("item").isNotNull()).select("log", "item.*"))


def object_rows(matched: DataFrame, v: Vocabulary = VOCABULARY) -> DataFrame:
    """One row per object; attributes as a map without missing values."""
    # Attributes stay plain columns until duplicates are gone, because maps cannot be compared.
    def item(oid: Column, otype: str, first: Column, second: Column = F.lit(None)) -> Column:
        return F.when(oid.isNotNull(), F.struct(
            oid.alias("oid"), F.lit(otype).alias("otype"), first.cast("string").alias("first"),
            second.cast("string").alias("second")))

    case, participant = F.col("case_id"), F.col("participant")
    people = [item(participant_id(p), v.participant, p)
              for p in (participant, F.col("from_participant"), F.col("to_participant"))]
    message = F.when(F.col("elem") == v.send_elem, _message())
    rows = _one_each(matched, [
        item(_instance(), v.instance, case), *people,
        item(_local_case(), v.local_case, case, participant),
        item(message, v.message, participant, F.col("to_participant"))]).distinct()

    names = {v.instance: (v.case_id_attr,), v.participant: (v.name_attr,),
             v.local_case: (v.case_id_attr, v.participant_attr),
             v.message: (v.sender_attr, v.receiver_attr)}
    attrs = F.lit(None)
    for otype, keys in names.items():
        pairs = [x for key, value in zip(keys, ("first", "second")) for x in (F.lit(key), F.col(value))]
        attrs = F.when(F.col("otype") == otype, F.create_map(*pairs)).otherwise(attrs)
    return rows.select("log", "oid", "otype", no_nulls(attrs).alias("attrs"))


def event_object_rows(matched: DataFrame, v: Vocabulary = VOCABULARY) -> DataFrame:
    """within, local and actor edges of every event; send and receive edges to messages."""
    def item(oid: Column, otype: str, qualifier: str) -> Column:
        return F.when(oid.isNotNull(), F.struct(
            F.col("event_id").alias("eid"), oid.alias("oid"), F.lit(otype).alias("otype"),
            F.lit(qualifier).alias("qualifier")))

    elem = F.col("elem")
    return _one_each(matched, [
        item(_instance(), v.instance, v.within),
        item(_local_case(), v.local_case, v.local),
        item(participant_id(F.col("participant")), v.participant, v.actor),
        item(F.when(elem == v.send_elem, _message()), v.message, v.send),
        item(F.when(elem == v.receive_elem, _message()), v.message, v.receive)])


def object_object_rows(matched: DataFrame, v: Vocabulary = VOCABULARY) -> DataFrame:
    """from, to and exchanged_in edges of messages; part_of and executed_by of local cases.

    A message without a known party has no edge for it.
    """
    def item(source: Column, target: Column, qualifier: str) -> Column:
        return F.when(source.isNotNull() & target.isNotNull(), F.struct(
            source.alias("src_oid"), target.alias("tgt_oid"), F.lit(qualifier).alias("qualifier")))

    participant = participant_id(F.col("participant"))
    message = F.when(F.col("elem") == v.send_elem, _message())
    return _one_each(matched, [
        item(message, participant, v.from_),
        item(message, participant_id(F.col("to_participant")), v.to),
        item(message, _instance(), v.exchanged_in),
        item(_local_case(), _instance(), v.part_of),
        item(_local_case(), participant, v.executed_by)]).distinct()


def without_actor_edges(relations: Relations, v: Vocabulary = VOCABULARY) -> Relations:
    """Drop the redundant direct event-to-participant edges."""
    return replace(relations, e2o=relations.e2o.filter(F.col("qualifier") != v.actor))


def static_attributes(objects: DataFrame) -> DataFrame:
    """Object attributes as versioned rows; static values carry the epoch as their time."""
    return objects.select("log", "oid", "otype", F.explode("attrs").alias("attribute", "value"),
                          F.lit("1970-01-01 00:00:00").cast("timestamp").alias("ts"))


def transformation_stats(relations: Relations, matched: DataFrame,
                         v: Vocabulary = VOCABULARY) -> DataFrame:
    """Counts of the transformation in long form: (log, measure, value)."""
    def counts(df: DataFrame, measure: Column) -> DataFrame:
        return df.groupBy("log", measure.alias("measure")).agg(
            F.count(F.lit(1)).cast("long").alias("value"))

    receive = F.col("elem") == v.receive_elem
    events = matched.groupBy("log").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("elem") == v.send_elem).alias("messages"),
        F.count_if(receive & F.col("sent").isNull()).alias("unmatched_receives"))
    pairs = F.explode(F.create_map(*[x for c in ("events", "messages", "unmatched_receives")
                                     for x in (F.lit(c), F.col(c).cast("long"))]))
    by_type = counts(relations.objects, F.concat(F.lit("objects."), F.col("otype")))
    cases = relations.objects.filter(F.col("otype") == v.instance)
    return (events.select("log", pairs.alias("measure", "value"))
            .unionByName(by_type)
            .unionByName(counts(relations.objects, F.lit("objects")))
            .unionByName(counts(relations.e2o, F.lit("e2o")))
            .unionByName(counts(relations.o2o, F.lit("o2o")))
            .unionByName(counts(cases, F.lit("cases"))))
