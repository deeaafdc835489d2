"""Consistency checks on the object-centric model.

Each check is a DataFrame of measures (log, check, measure, value); a check passes if all measures
that count violations are zero. Everything is aggregated before it is joined, so an object related
to a large part of all events never meets them in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.config import VOCABULARY, Vocabulary
from tracewright.functions.columns import instance_id, participant_id
from tracewright.operators.mapping import Relations

TOTALITY = "every event is mapped"
PARTITION = "one instance per case"
MESSAGES = "messages have both ends"
LOCAL_CASES = "local cases fit together"
ORPHANS = "objects are related"

# Measures that are informative; all others count violations.
INFORMATIVE = ("source_events", "ocel_events", "source_timestamps", "ocel_timestamps",
               "instances", "messages", "local_cases", "objects")


def _long(check: str, counts: DataFrame, names: list[str]) -> DataFrame:
    pairs = [x for n in names for x in (F.lit(n), F.coalesce(F.col(n), F.lit(0)).cast("long"))]
    return counts.select("log", F.lit(check).alias("check"),
                         F.explode(F.create_map(*pairs)).alias("measure", "value"))


def _combine(*counts: DataFrame) -> DataFrame:
    """Join small per-log aggregates."""
    return reduce(lambda a, b: a.join(b, "log", "full_outer"), counts)


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def check_totality(src: DataFrame, relations: Relations) -> DataFrame:
    """As many events as source rows, with as many timestamps (unreadable ones were given too)."""
    def counts(df: DataFrame, prefix: str) -> DataFrame:
        given = F.coalesce(F.col("ts").cast("string"), F.col("unread_ts")) \
            if "unread_ts" in df.columns else F.col("ts")
        return df.groupBy("log").agg(F.count(F.lit(1)).alias(f"{prefix}_events"),
                                     F.count(given).alias(f"{prefix}_timestamps"))

    both = _combine(counts(src, "source"), counts(relations.events, "ocel"))
    both = both.withColumns({
        "event_difference": F.abs(_number("source_events") - _number("ocel_events")),
        "timestamp_difference": F.abs(_number("source_timestamps") - _number("ocel_timestamps"))})
    return _long(TOTALITY, both, ["source_events", "ocel_events", "source_timestamps",
                                  "ocel_timestamps", "event_difference", "timestamp_difference"])


def case_mismatches(src: DataFrame, relations: Relations, v: Vocabulary = VOCABULARY) -> DataFrame:
    """Cases whose instance has not exactly as many events as the source case."""
    expected = (src.filter(F.col("case_id").isNotNull()).groupBy("log", "case_id")
                .agg(F.count(F.lit(1)).alias("expected"))
                .select("log", instance_id(F.col("case_id")).alias("oid"), "expected"))
    found = _within(relations, v)
    return expected.join(found, ["log", "oid"], "left").select(
        "log", "oid", "expected", _number("events").alias("found")).filter(
        F.col("expected") != F.col("found"))


def _within(relations: Relations, v: Vocabulary) -> DataFrame:
    # Relations read back take an edge's type from its object, so an edge to no object has none.
    edges = relations.e2o.filter((F.col("qualifier") == v.within)
                                 & (F.coalesce("otype", F.lit(v.instance)) == v.instance))
    return (edges.select("log", "oid", "eid").distinct()
            .groupBy("log", "oid").agg(F.count(F.lit(1)).alias("events")))


def dangling_instances(relations: Relations, v: Vocabulary = VOCABULARY) -> DataFrame:
    """Targets of within edges that are no instances of the log."""
    instances = relations.objects.filter(F.col("otype") == v.instance).select("log", "oid")
    return _within(relations, v).join(instances, ["log", "oid"], "left_anti")


def check_partition(src: DataFrame, relations: Relations, v: Vocabulary = VOCABULARY) -> DataFrame:
    """Every case has one instance with exactly its events."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("log").agg(F.count(F.lit(1)).alias(name))

    instances = relations.objects.filter(F.col("otype") == v.instance)
    counts = _combine(count(instances, "instances"),
                      count(case_mismatches(src, relations, v), "count_mismatches"),
                      count(dangling_instances(relations, v), "dangling_within"))
    return _long(PARTITION, counts, ["instances", "count_mismatches", "dangling_within"])


def message_facts(relations: Relations, v: Vocabulary = VOCABULARY) -> DataFrame:
    """One row per message: its edges, its parties and its times."""
    times = relations.events.select("log", "eid", "ts")
    edges = relations.e2o.filter((F.col("otype") == v.message)
                                 & F.col("qualifier").isin(v.send, v.receive))
    send, receive = F.col("qualifier") == v.send, F.col("qualifier") == v.receive
    per_message = edges.join(times, ["log", "eid"], "left").groupBy("log", "oid").agg(
        F.count_if(send).alias("sends"), F.count_if(receive).alias("receives"),
        F.max(F.when(send, F.col("ts"))).alias("sent_ts"),
        F.min(F.when(receive, F.col("ts"))).alias("first_receive_ts"))
    parties = relations.o2o.filter(F.col("qualifier").isin(v.from_, v.to)).groupBy(
        "log", F.col("src_oid").alias("oid")).agg(
        F.min(F.when(F.col("qualifier") == v.from_, F.col("tgt_oid"))).alias("from_oid"),
        F.min(F.when(F.col("qualifier") == v.to, F.col("tgt_oid"))).alias("to_oid"))
    messages = relations.objects.filter(F.col("otype") == v.message).select(
        "log", "oid", F.col("attrs")[v.sender_attr].alias("sender"),
        F.col("attrs")[v.receiver_attr].alias("receiver"))
    return messages.join(per_message, ["log", "oid"], "left").join(parties, ["log", "oid"], "left")


def late_sends(relations: Relations, v: Vocabulary = VOCABULARY) -> DataFrame:
    """Receive edges whose event is earlier than the send of their message."""
    times = relations.events.select("log", "eid", "ts")
    edges = relations.e2o.filter(F.col("otype") == v.message).join(times, ["log", "eid"])
    sends = edges.filter(F.col("qualifier") == v.send).groupBy("log", "oid").agg(
        F.max_by("ts", "eid").alias("sent_ts"))
    receives = edges.filter(F.col("qualifier") == v.receive)
    return receives.join(sends, ["log", "oid"]).filter(F.col("ts") < F.col("sent_ts")).select(
        "log", "oid", "eid")


def check_messages(relations: Relations, v: Vocabulary = VOCABULARY) -> DataFrame:
    """One send and at most one receive per message, parties as stated, no receive before the send."""
    def disagrees(party: str, edge: str) -> Column:
        return F.coalesce(participant_id(F.col(party)) != F.col(edge), F.lit(False)).cast("int")

    counts = message_facts(relations, v).groupBy("log").agg(
        F.count(F.lit(1)).alias("messages"),
        F.count_if(_number("sends") != 1).alias("not_one_send"),
        F.count_if(_number("receives") > 1).alias("several_receives"),
        F.sum(disagrees("sender", "from_oid") + disagrees("receiver", "to_oid"))
        .alias("party_disagreements"))
    late = late_sends(relations, v).groupBy("log").agg(F.count(F.lit(1)).alias("receive_before_send"))
    return _long(MESSAGES, _combine(counts, late), [
        "messages", "not_one_send", "several_receives", "party_disagreements",
        "receive_before_send"])


def check_local_cases(relations: Relations, v: Vocabulary = VOCABULARY) -> DataFrame:
    """Local cases belong to the instance of their events and to one participant, by its name."""
    def edges(qualifier: str, name: str) -> DataFrame:
        return relations.e2o.filter(F.col("qualifier") == qualifier).select(
            "log", "eid", F.col("oid").alias(name))

    # Counted per (local case, instance) before the join: a local case may have very many events.
    pairs = edges(v.local, "lc_oid").join(edges(v.within, "ci_oid"), ["log", "eid"], "left").groupBy(
        "log", "lc_oid", "ci_oid").agg(F.count(F.lit(1)).alias("events"))
    part_of = relations.o2o.filter(F.col("qualifier") == v.part_of).groupBy(
        "log", F.col("src_oid").alias("lc_oid")).agg(F.max("tgt_oid").alias("whole"))
    incoherent = (pairs.join(part_of, ["log", "lc_oid"], "left")
                  .filter(~F.col("whole").eqNullSafe(F.col("ci_oid")))
                  .groupBy("log").agg(F.sum("events").alias("local_within_mismatches")))

    executed = relations.o2o.filter(F.col("qualifier") == v.executed_by).groupBy(
        "log", F.col("src_oid").alias("oid")).agg(F.count(F.lit(1)).alias("executors"),
                                                  F.max("tgt_oid").alias("tgt_oid"))
    names = relations.objects.select("log", F.col("oid").alias("tgt_oid"),
                                     F.col("attrs")[v.name_attr].alias("name"))
    cases = (relations.objects.filter(F.col("otype") == v.local_case)
             .join(executed, ["log", "oid"], "left").join(names, ["log", "tgt_oid"], "left"))
    one = _number("executors") == 1
    differs = F.col("name") != F.col("attrs")[v.participant_attr]
    counts = cases.groupBy("log").agg(
        F.count(F.lit(1)).alias("local_cases"), F.count_if(~one).alias("not_one_executor"),
        F.count_if(one & differs).alias("name_disagreements"))
    return _long(LOCAL_CASES, _combine(counts, incoherent), [
        "local_cases", "local_within_mismatches", "not_one_executor", "name_disagreements"])


def orphan_objects(relations: Relations) -> DataFrame:
    """Objects in no relation."""
    related = (relations.e2o.select("log", "oid").distinct()
               .unionByName(relations.o2o.select("log", F.col("src_oid").alias("oid")).distinct())
               .unionByName(relations.o2o.select("log", F.col("tgt_oid").alias("oid")).distinct()))
    return relations.objects.select("log", "oid", "otype").join(related, ["log", "oid"], "left_anti")


def check_orphans(relations: Relations) -> DataFrame:
    objects = relations.objects.groupBy("log").agg(F.count(F.lit(1)).alias("objects"))
    orphans = orphan_objects(relations).groupBy("log").agg(F.count(F.lit(1)).alias("orphans"))
    return _long(ORPHANS, _combine(objects, orphans), ["objects", "orphans"])


def check_measures(src: DataFrame, relations: Relations, v: Vocabulary = VOCABULARY) -> DataFrame:
    """Measures of all five checks."""
    return reduce(lambda a, b: a.unionByName(b), [
        check_totality(src, relations), check_partition(src, relations, v),
        check_messages(relations, v), check_local_cases(relations, v), check_orphans(relations)])


def check_report(measures: DataFrame) -> DataFrame:
    """(log, check, passed, violations), and an `overall` row per log."""
    violations = F.when(~F.col("measure").isin(*INFORMATIVE), F.col("value")).otherwise(0)
    counted = measures.select("log", F.explode(F.array("check", F.lit("overall"))).alias("check"),
                              violations.alias("violations"))
    return (counted.groupBy("log", "check").agg(F.sum("violations").cast("long").alias("violations"))
            .withColumn("passed", F.col("violations") == 0))


def require_passed(report: DataFrame) -> None:
    """Strict mode: raise if a check failed."""
    failed = report.filter(~F.col("passed") & (F.col("check") != "overall"))
    names = sorted(r["check"] for r in failed.select("check").distinct().collect())
    if names:
        raise RuntimeError(f"consistency checks failed: {', '.join(names)}")
