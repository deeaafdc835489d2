"""Relations, trace edge cases and consistency checks."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import at, event, forced, frame, same_rows
from data import random_rows
from tracewright.operators import checks, discover
from tracewright.operators import trace as T
from tracewright.operators.attributes import latest_attributes
from tracewright.operators.mapping import (Relations, static_attributes, transform,
                                           without_actor_edges)

EVENTS = "log string, eid string, activity string, ts timestamp, elem_type string, src_order long, " \
         "residual map<string,string>"
OBJECTS = "log string, oid string, otype string, attrs map<string,string>"
E2O = "log string, eid string, oid string, otype string, qualifier string"
O2O = "log string, src_oid string, tgt_oid string, qualifier string"


def relations(spark, events=(), objects=(), e2o=(), o2o=()):
    make = lambda rows, schema: spark.createDataFrame([("log", *r) for r in rows], schema)
    return Relations(make(events, EVENTS), make(objects, OBJECTS), make(e2o, E2O), make(o2o, O2O))


def ev(eid, seconds=0, elem="task"):
    return eid, "act", at(seconds), elem, None, {}


CI = ("ci", "CollaborationInstance", {"caseId": "c"})


def measures(df):
    return {(r["check"], r["measure"]): r["value"] for r in df.collect()}


def test_transform_counts(spark):
    rows = [event("c", 0, 0, "SendTask", "A", receiver="B"), event("c", 1, 1, "ReceiveTask", "B", "A"),
            event("c", 2, 2, who=None)]
    r = transform(frame(spark, rows))
    ids = {x["oid"]: x["attrs"] for x in r.objects.collect()}
    assert ids == {"ci::c": {"caseId": "c"}, "part::A": {"name": "A"}, "part::B": {"name": "B"},
                   "lc::c::A": {"caseId": "c", "participant": "A"},
                   "lc::c::B": {"caseId": "c", "participant": "B"},
                   "msg::e::c::0": {"sender": "A", "receiver": "B"}}
    edges = {(x["eid"], x["oid"], x["qualifier"]) for x in r.e2o.collect()}
    assert ("e::c::1", "msg::e::c::0", "receive") in edges and ("e::c::2", "ci::c", "within") in edges
    assert len(edges) == 3 + 2 + 2 + 1 + 1
    assert without_actor_edges(r).e2o.count() == len(edges) - 2
    o2o = {(x["src_oid"], x["tgt_oid"], x["qualifier"]) for x in r.o2o.collect()}
    assert o2o == {("msg::e::c::0", "part::A", "from"), ("msg::e::c::0", "part::B", "to"),
                   ("msg::e::c::0", "ci::c", "exchanged_in"), ("lc::c::A", "ci::c", "part_of"),
                   ("lc::c::B", "ci::c", "part_of"), ("lc::c::A", "part::A", "executed_by"),
                   ("lc::c::B", "part::B", "executed_by")}
    assert static_attributes(r.objects).filter(F.unix_micros("ts") != 0).count() == 0


def test_send_without_participant(spark):
    r = transform(frame(spark, [event("c", 0, 0, "SendTask", None)]))
    assert [x["qualifier"] for x in r.o2o.collect()] == ["exchanged_in"]
    assert r.objects.filter("otype = 'Message'").first()["attrs"] == {}


def test_kept_relations_equal_lazy_ones(spark):
    src = frame(spark, random_rows(5, known=0.8))
    lazy, kept = transform(src), transform(src, forced(src), keep=True)
    for name in ("e2o", "o2o"):
        same_rows(getattr(lazy, name), getattr(kept, name))


def test_latest_attribute(spark):
    rows = [("log", "o", "2024-01-01", {"a": "1", "b": "x"}, 0), ("log", "o", "2024-01-03", {"a": None}, 1),
            ("log", "o", "2024-01-02", {"a": "2"}, 2), ("log", "o", "2024-01-02", {"a": "3"}, 3)]
    df = spark.createDataFrame(rows, "log string, oid string, ocel_time string, "
                                     "attrs map<string,string>, row_order long")
    assert latest_attributes(df).first()["attrs"] == {"a": "3", "b": "x"}


def test_actor_falls_back(spark):
    r = relations(
        spark, [ev("1"), ev("2"), ev("3"), ev("4"), ev("5")],
        [CI, ("p", "Participant", {"name": ""}), ("q", "Participant", {"name": "Q"}),
         ("l1", "LocalCase", {"participant": "L"}), ("l2", "LocalCase", {})],
        [(e, "ci", "CollaborationInstance", "within") for e in "12345"]
        + [("1", "p", "Participant", "actor"), ("2", "l1", "LocalCase", "local"),
           ("3", "l2", "LocalCase", "local"), ("4", "gone", "Participant", "actor")],
        [("l2", "q", "executed_by")])
    actors = {x["event_id"]: x["actor"] for x in T.trace_of_relations(r).collect()}
    assert actors == {"1": "p", "2": "L", "3": "Q", "4": "", "5": ""}


def test_events_without_instance_are_dropped(spark):
    r = relations(spark, [ev("1"), ev("2"), ev("3")], [CI],
                  [("1", "ci", "CollaborationInstance", "within"),
                   ("2", "gone", "CollaborationInstance", "within")])
    assert [x["event_id"] for x in T.trace_of_relations(r).collect()] == ["1"]


def test_element_type_decides_without_message_edge(spark):
    r = relations(spark, [ev("1", elem="SendTask"), ev("2", elem="SendTask"), ev("3", elem=None)],
                  [CI, ("m", "Message", {})],
                  [(e, "ci", "CollaborationInstance", "within") for e in "123"]
                  + [("2", "m", "Message", "receive")])
    rows = {x["event_id"]: (x["is_send"], x["is_receive"], x["msg_id"])
            for x in T.trace_of_relations(r).collect()}
    assert rows == {"1": (True, False, None), "2": (False, True, "m"), "3": (False, False, None)}


def test_checks_pass_on_own_transformation(spark):
    src = frame(spark, random_rows(2, known=0.8))
    report = checks.check_report(checks.check_measures(src, transform(src, keep=True)))
    assert {r["check"]: r["passed"] for r in report.collect()} == {
        checks.TOTALITY: True, checks.PARTITION: True, checks.MESSAGES: True,
        checks.LOCAL_CASES: True, checks.ORPHANS: True, "overall": True}
    checks.require_passed(report)


def test_missing_case_fails_totality(spark):
    src = frame(spark, [event(None, 0, 0), event("c", 1, 1)])
    report = checks.check_report(checks.check_measures(src, transform(src)))
    assert not report.filter(F.col("check") == checks.TOTALITY).first()["passed"]
    with pytest.raises(RuntimeError, match="every event is mapped"):
        checks.require_passed(report)


def test_unread_time_fails_totality(spark):
    src = frame(spark, [event("c", 0, None), event("c", 1, 1)]).withColumn(
        "unread_ts", F.when(F.col("ts").isNull(), "soon"))
    found = measures(checks.check_totality(src, transform(src)))
    assert found[checks.TOTALITY, "timestamp_difference"] == 1


def test_broken_relations_are_counted(spark):
    src = frame(spark, [event("c", 0, 0, "SendTask", "A", receiver="B"),
                        event("c", 1, 5, "ReceiveTask", "B", "A"), event("d", 2, 0)])
    good = transform(src, keep=True)
    add = lambda df, *row: df.unionByName(spark.createDataFrame([row], df.schema))
    bad = replace(
        good,
        events=good.events.withColumn("ts", F.when(F.col("eid") == "e::c::1", F.lit(at(-9)))
                                      .otherwise(F.col("ts"))),
        objects=add(add(good.objects, "log", "alone", "Message", {}), "log", "lc::x", "LocalCase", {})
        .filter("oid != 'ci::d'"),
        e2o=add(add(good.e2o, "log", "e::c::0", "msg::e::c::0", "Message", "receive"),
                "log", "e::d::0", "lc::x", "LocalCase", "local"),
        o2o=good.o2o.withColumn("tgt_oid", F.when(F.col("qualifier") == "to", "part::A")
                                .otherwise(F.col("tgt_oid"))))
    found = measures(checks.check_measures(src, bad))
    assert found[checks.PARTITION, "dangling_within"] == 1
    assert found[checks.MESSAGES, "not_one_send"] == 1
    assert found[checks.MESSAGES, "several_receives"] == 1
    assert found[checks.MESSAGES, "party_disagreements"] == 1
    assert found[checks.MESSAGES, "receive_before_send"] == 1
    assert found[checks.LOCAL_CASES, "local_within_mismatches"] == 1
    assert found[checks.LOCAL_CASES, "not_one_executor"] == 1
    assert found[checks.ORPHANS, "orphans"] == 1


def test_directly_follows(spark):
    rows = [event("c", i, i, who="A", activity=a) for i, a in enumerate("xyxy")]
    rows += [event("d", 9 + i, i, who="A", activity=a) for i, a in enumerate("xy")]
    r = transform(frame(spark, rows), keep=True)
    graph = {(x["otype"], x["source"], x["target"]): (x["event_couples"], x["unique_objects"], x["total_objects"])
             for x in discover.directly_follows(r).collect()}
    assert graph["CollaborationInstance", "x", "y"] == (3, 2, 3)
    assert graph["CollaborationInstance", "y", "x"] == (1, 1, 1)
    same_rows(discover.directly_follows(r), discover.directly_follows(r, forced(r.events)))


def test_dangling_edges_without_a_type_are_counted(spark):
    """As read back, where an edge has the type of the object it points to."""
    good = transform(src := frame(spark, [event("c", 0, 0), event("d", 1, 0)]), keep=True)
    bad = replace(good, objects=good.objects.filter("oid != 'ci::d'"),
                  e2o=good.e2o.withColumn("otype", F.when(F.col("oid") != "ci::d", F.col("otype"))))
    assert measures(checks.check_measures(src, bad))[checks.PARTITION, "dangling_within"] == 1
