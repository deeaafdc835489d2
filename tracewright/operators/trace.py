"""The trace: one row per event with its case, its actor and its message.

It can be built from the relations of any object-centric log, or straight from matched source
events, which gives the same rows without joins. A third form keeps to the source columns only and
is the reference side of the label comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.config import VOCABULARY, Vocabulary
from tracewright.functions.columns import event_id, instance_id, message_id, or_else
from tracewright.operators.mapping import Relations
from tracewright.operators.match import order_events
from tracewright.operators.ordered import OrderedGroups
from tracewright.operators.skew import Skew

# The case follows from the instance. Naming it lets windows use an exchange by case as it is.
EXECUTION = ["log", "case_id", "ci_oid"]
TRACE_ORDER = ["ts", "event_id"]
TRACE_COLUMNS = ["log", "ci_oid", "case_id", "event_id", "activity", "ts", "actor", "is_send",
                 "is_receive", "msg_id", "msg_type", "msg_from", "msg_to", "src_order"]


def trace_groups(trace: DataFrame, skew: Skew | None = None, order: list[str] = TRACE_ORDER,
                 fanout: int = 1, also: list[str] | None = None, of: str = "events") -> OrderedGroups:
    """Executions in trace order: by time, then by event id as text (`e::c::10` before `e::c::2`).

    Pass `["ts", "src_order"]` to break ties by source position instead, and `also` to group inside
    executions by further columns.
    """
    return OrderedGroups(trace, EXECUTION + (also or []), order, skew, by=["log", "ci_oid"],
                          fanout=fanout, of=of)


def trace_of_matched(matched: DataFrame, v: Vocabulary = VOCABULARY) -> DataFrame:
    """Trace of matched source events."""
    send, receive = F.col("elem") == v.send_elem, F.col("elem") == v.receive_elem
    return matched.select(
        "log", instance_id(F.col("case_id")).alias("ci_oid"), "case_id", "event_id", "activity",
        "ts", F.coalesce("participant", F.lit("")).alias("actor"), send.alias("is_send"),
        receive.alias("is_receive"), message_id(F.col("sent.event_id")).alias("msg_id"),
        F.when(send | receive, F.col("activity")).alias("msg_type"),
        F.col("sent.participant").alias("msg_from"),
        F.col("sent.to_participant").alias("msg_to"), "src_order")


def trace_without_receives(src: DataFrame, skew: Skew | None = None,
                           v: Vocabulary = VOCABULARY) -> DataFrame:
    """Trace of source events without pairing messages: receives carry no message."""
    events = order_events(src, skew).df()
    sent = F.struct("event_id", "participant", "to_participant")
    return trace_of_matched(events.withColumn("sent", F.when(F.col("elem") == v.send_elem, sent)), v)


def source_trace(src: DataFrame, v: Vocabulary = VOCABULARY) -> DataFrame:
    """Trace made of source columns only, to be ordered by (ts, src_order).

    The participant is both actor and message sender and no relation is involved.
    """
    send, receive = F.col("elem") == v.send_elem, F.col("elem") == v.receive_elem
    actor = F.coalesce("participant", F.lit(""))
    none = F.lit(None).cast("string")
    return src.filter(F.col("case_id").isNotNull()).select(
        "log", instance_id(F.col("case_id")).alias("ci_oid"), "case_id",
        event_id(F.col("case_id"), F.col("src_order")).alias("event_id"), "activity", "ts",
        actor.alias("actor"), send.alias("is_send"), receive.alias("is_receive"),
        none.alias("msg_id"), F.when(send | receive, F.col("activity")).alias("msg_type"),
        F.when(send, actor).alias("msg_from"), F.col("to_participant").alias("msg_to"), "src_order")


def object_facts(relations: Relations, v: Vocabulary = VOCABULARY) -> DataFrame:
    """What events learn from an object: (log, oid, otype, name, msg_from, msg_to).

    The name is the case id of an instance, the name of a participant, or the actor of a local case:
    its executing participant, else its participant attribute. Messages have a sender and receiver.
    """
    attrs, otype = F.col("attrs"), F.col("otype")
    people = relations.objects.filter(otype == v.participant).select(
        "log", F.col("oid").alias("tgt_oid"),
        or_else(attrs[v.name_attr], F.col("oid")).alias("person"))

    def party(qualifier: str) -> Column:
        return F.min_by("person", F.when(F.col("qualifier") == qualifier, F.col("tgt_oid")))

    parties = (relations.o2o.filter(F.col("qualifier").isin(v.executed_by, v.from_, v.to))
               .join(people, ["log", "tgt_oid"]).groupBy("log", F.col("src_oid").alias("oid"))
               .agg(party(v.executed_by).alias("executor"), party(v.from_).alias("sender"),
                    party(v.to).alias("receiver")))
    own_name = (F.when(otype == v.instance, or_else(attrs[v.case_id_attr], F.col("oid")))
                .when(otype == v.participant, or_else(attrs[v.name_attr], F.col("oid")))
                .when(otype == v.local_case, F.coalesce("executor", attrs[v.participant_attr])))
    message = otype == v.message
    return relations.objects.join(parties, ["log", "oid"], "left").select(
        "log", "oid", "otype", own_name.alias("name"),
        F.when(message, F.col("sender")).alias("msg_from"),
        F.when(message, F.col("receiver")).alias("msg_to"))


def event_roles(relations: Relations, v: Vocabulary = VOCABULARY) -> DataFrame:
    """Per event: its instance, local case, direct participant and message, with their facts.

    If an event has several edges of one role the greatest object id stands for all of them.
    Edges to objects that are not in the log do not count.
    """
    # Objects are unique per id, so an object with very many events only skews the edge side, which
    # AQE splits.
    edges = relations.e2o.select("log", "eid", "oid", "qualifier").join(
        object_facts(relations, v), ["log", "oid"])
    kind, qualifier = F.col("otype"), F.col("qualifier")

    def role(condition: Column) -> Column:
        return F.max(F.when(condition, F.struct("oid", "name", "msg_from", "msg_to")))

    send = (qualifier == v.send) & (kind == v.message)
    receive = (qualifier == v.receive) & (kind == v.message)
    return edges.groupBy("log", "eid").agg(
        role((qualifier == v.within) & (kind == v.instance)).alias("instance"),
        role((qualifier == v.local) & (kind == v.local_case)).alias("local_case"),
        role(kind == v.participant).alias("person"), role(send | receive).alias("message"),
        F.bool_or(send).alias("sends"), F.bool_or(receive).alias("receives"))


def trace_of_relations(relations: Relations, v: Vocabulary = VOCABULARY) -> DataFrame:
    """Trace of an object-centric log. Events without an instance are left out."""
    roles = event_roles(relations, v).filter(F.col("instance").isNotNull())
    # The element type decides only where no message edge does.
    no_edge = ~(F.col("sends") | F.col("receives"))
    is_send = F.col("sends") | (no_edge & F.col("elem_type").eqNullSafe(v.send_elem))
    is_receive = F.col("receives") | (no_edge & F.col("elem_type").eqNullSafe(v.receive_elem))

    def of_message(value: str) -> Column:
        return F.when(is_send | is_receive, F.col(value))

    return relations.events.join(roles, ["log", "eid"]).select(
        "log", F.col("instance.oid").alias("ci_oid"), F.col("instance.name").alias("case_id"),
        F.col("eid").alias("event_id"), "activity", "ts",
        F.coalesce("person.name", "local_case.name", F.lit("")).alias("actor"),
        is_send.alias("is_send"), is_receive.alias("is_receive"),
        of_message("message.oid").alias("msg_id"), of_message("activity").alias("msg_type"),
        of_message("message.msg_from").alias("msg_from"),
        of_message("message.msg_to").alias("msg_to"), "src_order")
