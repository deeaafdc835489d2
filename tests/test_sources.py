"""Reading and writing logs."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import event, forced, frame, same_rows
from data import random_rows
from tracewright.config import LogSpec, SourceColumns
from tracewright.functions.columns import clean
from tracewright.operators import trace as T
from tracewright.operators.mapping import transform
from tracewright.plans import queries
from tracewright.plans.convert import convert, read_event_logs
from tracewright.session import materialize, shared_root
from tracewright.sources import documents, flat, relational, xes
from tracewright.sources.results import write_csv

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xmlns="http://www.xes-standard.org/">
  <string key="concept:name" value="whole log"/>
  <trace>
    <string key="concept:name" value="one"/><string key="kind" value="big"/>
    <event><string key="concept:name" value="ask"/><string key="collab:elemType" value="SendTask"/>
      <string key="collab:participant" value=" A "/><string key="collab:toParticipant" value="B"/>
      <date key="time:timestamp" value="2021-06-23T06:00:05.205-03:00"/><int key="size" value="3"/></event>
    <event><string key="concept:name" value="hear"/><string key="collab:elemType" value="ReceiveTask"/>
      <string key="collab:participant" value="B"/><string key="collab:fromParticipant" value="A"/>
      <date key="time:timestamp" value="2021-06-23T09:00:06Z"/></event>
  </trace>
  <trace>
    <string key="concept:name" value="two"/>
    <event><string key="concept:name" value="ask"/><string key="collab:participant" value=""/>
      <date key="time:timestamp" value="someday"/></event>
  </trace>
</log>"""


def test_event_log_xml(spark, tmp_path):
    (tmp_path / "log.xes").write_text(XES)
    src = xes.read_event_log(spark, str(tmp_path / "log.xes"), "l")
    rows = src.orderBy("src_order").collect()
    assert [(r["case_id"], r["activity"], r["elem"], r["participant"]) for r in rows] == [
        ("one", "ask", "SendTask", "A"), ("one", "hear", "ReceiveTask", "B"), ("two", "ask", "task", None)]
    assert [r["m"] for r in src.orderBy("src_order").select(F.unix_millis("ts").alias("m")).collect()] == [
        1624438805205, 1624438806000, None]
    assert rows[0]["residual"] == {"case:kind": "big", "size": "3"} and rows[2]["unread_ts"] == "someday"
    trace = T.trace_of_relations(transform(src))
    assert trace.filter("is_receive").first()["msg_from"] == "A"


def test_unreadable_logs_become_error_rows(spark, tmp_path):
    (tmp_path / "log.xes").write_text(XES)
    specs = [LogSpec("good", events=str(tmp_path / "log.xes")), LogSpec("bad", events=str(tmp_path / "no"))]
    src, errors = read_event_logs(spark, specs)
    assert src.select("log").distinct().collect()[0][0] == "good" and src.count() == 3
    assert [e["log"] for e in errors] == ["bad"]


def test_required_columns(spark):
    names = SourceColumns()
    df = spark.createDataFrame([("c", "a", "2024-01-01T00:00:00Z", "task", "P")], list(names.mandatory))
    with pytest.warns(UserWarning, match="fromParticipant"):
        flat.require_columns(df)
    with pytest.raises(ValueError, match="collab:participant"):
        flat.require_columns(df.drop(names.participant))


@pytest.mark.parametrize("text,cleaned", [(" a ", "a"), ("\t", None), (" ", None), ("", None),
                                          (None, None), (" x y\n", "x y")])
def test_clean(spark, text, cleaned):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(clean(F.col("t"))).first()[0] == cleaned


def test_configured_columns_are_no_residuals(spark):
    names = SourceColumns(case="trace", activity="what")
    df = spark.createDataFrame(
        [("c", "a", "2024-01-01T00:00:00Z", None, "P", "x", "y", "extra", "hidden")],
        "trace string, what string, `time:timestamp` string, `collab:elemType` string, "
        "`collab:participant` string, `collab:fromParticipant` string, `collab:toParticipant` string, "
        "more string, __internal string")
    r = flat.source_events(df, "l", names).first()
    assert r["residual"] == {"more": "extra"} and r["elem"] == "task"


def shown(trace):
    return trace.drop("src_order")


@pytest.fixture(scope="module")
def kept(spark):
    rows = random_rows(41, cases=5, known=0.8)
    rows.append(event("r", 999, 3, residual={"note": "n", "other": "o"}))
    relations = transform(frame(spark, rows), keep=True)
    return relations, materialize(T.trace_of_relations(relations), "expected")


def test_relational_round_trip(spark, kept, tmp_path):
    relations, trace = kept
    relational.write_relational(relations, str(tmp_path))
    back = relational.read_relational(spark, str(tmp_path))
    same_rows(trace, T.trace_of_relations(back))
    note = back.events.filter("eid = 'e::r::0'").first()
    assert note["residual"] == {"note": "n", "other": "o"}
    same_rows(relations.o2o, back.o2o)


def test_tables_per_type(spark):
    table = lambda rows, names: spark.createDataFrame(rows, names)
    tables = {
        "event": table([("e1", "pay"), ("e2", "ship")], "ocel_id string, ocel_type string"),
        "object": table([("i", "CollaborationInstance"), ("p", "Participant")],
                        "ocel_id string, ocel_type string"),
        "event_object": table([("e1", "i", "within"), ("e2", "i", "within"), ("e2", "p", "actor")],
                              "ocel_event_id string, ocel_object_id string, ocel_qualifier string"),
        "object_object": table([], "ocel_source_id string, ocel_target_id string, ocel_qualifier string"),
        "event_map_type": table([("pay", "Pay"), ("ship", "Ship")], "ocel_type string, ocel_type_map string"),
        "object_map_type": table([("CollaborationInstance", "CI"), ("Participant", "P")],
                                 "ocel_type string, ocel_type_map string"),
        "event_Pay": table([("e1", "2024-01-01T00:00:00Z", "9")],
                           "ocel_id string, ocel_time string, amount string"),
        "event_Ship": table([("e2", "2024-01-01 00:00:05", "SendTask")],
                            "ocel_id string, ocel_time string, elemType string"),
        "object_CI": table([("i", "1970-01-01", None, "c7")],
                           "ocel_id string, ocel_time string, ocel_changed_field string, caseId string"),
        "object_P": table([("p", "1970-01-01", None, "old"), ("p", "2024-01-01", "name", "new")],
                          "ocel_id string, ocel_time string, ocel_changed_field string, name string")}
    built = relational.relations_of_tables(tables, "l")
    rows = {r["event_id"]: (r["case_id"], r["actor"], r["is_send"])
            for r in T.trace_of_relations(built).collect()}
    assert rows == {"e1": ("c7", "", False), "e2": ("c7", "new", True)}
    assert built.events.filter("eid = 'e1'").first()["residual"] == {"amount": "9"}


def test_renaming(spark):
    df = spark.createDataFrame([(1, 2)], ["ocel:eid", "event_x"])
    assert relational.normal_names(df).columns == ["ocel_eid", "event_x"]
    assert relational.strip_prefix(df, "event_").columns == ["ocel:eid", "x"]


def test_documents_round_trip(spark, kept, tmp_path):
    relations, trace = kept
    documents.write_documents(relations, str(tmp_path))
    same_rows(shown(trace), shown(T.trace_of_relations(documents.read_documents(spark, str(tmp_path)))))
    assert documents.document_violations(spark, str(tmp_path)).isEmpty()


def test_long_entries_go_on_in_further_ones(spark, kept, tmp_path, monkeypatch):
    relations, trace = kept
    monkeypatch.setattr(documents, "EDGES_PER_ENTRY", 2)
    documents.write_documents(relations, str(tmp_path), skew=forced(relations.events))
    lines = spark.read.json(f"{tmp_path}/events")
    assert lines.agg(F.max(F.size("relationships"))).first()[0] == 2 and lines.filter("part > 0").count() > 0
    back = documents.read_documents(spark, str(tmp_path))
    same_rows(shown(trace), shown(T.trace_of_relations(back)))
    same_rows(relations.o2o, back.o2o)


DOCUMENT = {
    "eventTypes": [{"name": "a", "attributes": [{"name": "x"}]}],
    "objectTypes": [{"attributes": []}],
    "events": [{"id": "e1", "type": "a", "time": "2024-01-01T00:00:00Z",
                "attributes": [{"name": "elemType", "value": "SendTask"}, {"name": "n", "value": 3}],
                "relationships": [{"objectId": "i", "qualifier": "within"}, {"objectId": "o"}]}],
    "objects": [{"id": "i", "type": "CollaborationInstance",
                 "attributes": [{"name": "caseId", "value": "c", "time": "1970-01-01T00:00:00Z"},
                                {"name": "caseId", "value": "d", "time": "2024-01-01T00:00:00Z"},
                                {"name": "y", "value": 1.5}]}, {"type": "T"}]}


def test_single_document(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text(json.dumps(DOCUMENT, indent=1))
    found = {(r["path"], r["message"]) for r in documents.single_document_violations(spark, str(path)).collect()}
    assert found == {
        ("eventTypes[0].attributes[0]", "absent: type"), ("objectTypes[0]", "absent: name"),
        ("events[0].attributes[1]", "not text: value"),
        ("events[0].relationships[1]", "absent: qualifier"),
        ("objects[0].attributes[2]", "absent: time"),
        ("objects[0].attributes[2]", "not text: value"), ("objects[1]", "absent: id")}
    with pytest.raises(RuntimeError):
        documents.require_valid(documents.single_document_violations(spark, str(path)))
    r = T.trace_of_relations(documents.read_single_document(spark, str(path), "l")).first()
    assert (r["case_id"], r["is_send"]) == ("d", True)


def test_single_document_sections(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text(json.dumps({"eventTypes": [], "objectTypes": {}, "events": []}))
    found = {(r["path"], r["message"]) for r in documents.single_document_violations(spark, str(path)).collect()}
    assert found == {("$", "not a list: objectTypes"),
                     ("$", "absent: objects")}


def test_convert(spark, tmp_path):
    src = frame(spark, random_rows(43, cases=4))
    told = {}
    convert(src, str(tmp_path / "out"), strict=True, report=lambda name, df: told.update({name: df.collect()}))
    assert set(told) == {"stats", "checks", "violations"} and told["violations"] == []
    bad = frame(spark, [event(None, 0, 0)])
    with pytest.raises(RuntimeError):
        convert(bad, str(tmp_path / "bad"), strict=True)
    assert not (tmp_path / "bad").exists()


def test_result_csv(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2])], "x string, y array<int>")
    write_csv(df, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first()["y"] == "[1,2]"


class Settings:
    """A session that knows only what `shared_root` asks for."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app {master}"})


def test_shared_folder_setting(spark):
    assert shared_root(Settings("hdfs://shared/x/", "yarn")) == "hdfs://shared/x"
    local = shared_root(Settings(None, "local[4]"))
    assert local == shared_root(Settings(None, "local[4]"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_root(Settings(None, "yarn"))
    assert shared_root(spark) in materialize(spark.range(3), "numbers").inputFiles()[0]


def counting(spark):
    """A function on texts that leaves them as they are, and how often it was called."""
    calls = spark.sparkContext.accumulator(0)

    def same(text):
        calls.add(1)
        return text

    return F.udf(same, "string").asNondeterministic(), calls


def test_objects_are_derived_once_for_all_tables(spark, tmp_path):
    relations = transform(frame(spark, random_rows(2)), keep=True)
    relations = replace(relations, objects=materialize(relations.objects, "objects"))
    counted, calls = counting(spark)
    once = replace(relations, objects=relations.objects.withColumn("oid", counted("oid")))
    relational.write_relational(once, str(tmp_path))
    assert calls.value == relations.objects.count()
    back = relational.read_relational(spark, str(tmp_path))
    same_rows(back.objects.select("oid", "otype"), relations.objects.select("oid", "otype"))


def test_events_are_joined_once_for_the_form_check(spark, tmp_path, monkeypatch):
    days = [f"2024-01-01 00:00:{i:02d}" for i in range(30)]
    rows = [(i, day, i % 3, ("purchase", "signup", "view")[i % 3], 1.0, '{"k": %d}' % i) for i, day in enumerate(days)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    sections, (counted, calls) = documents.document_sections, counting(spark)

    def watched(*args):
        found = sections(*args)
        return found | {"events": found["events"].withColumn("id", counted("id"))}

    monkeypatch.setattr(documents, "document_sections", watched)
    found = queries.registered()["json_violations"](spark, str(tmp_path)).groupBy("message").count().collect()
    assert calls.value == len(rows)
    # Ids that end in 7: one of the ten events of each of three cases, in lines that break more than one rule.
    assert {r["message"]: r["count"] for r in found if "list" in r["message"] or "id" in r["message"]} == {
        "not a list: relationships": 3, "not text: id": 3}


def test_entries_are_parsed_whole_only_without_lists(spark, tmp_path):
    lines = {"eventTypes": ['{"name": "a", "attributes": null}', '{"name": "b"}', '{"name": "c", "attributes": "x"}',
                            '{"name": "d", "attributes": []}', '{"name": "e", "attributes": {}}'],
             "objectTypes": [], "objects": [],
             "events": ['{"id": "f", "type": "a", "time": "2024-01-01T00:00:00Z", "relationships": 1}',
                        '{"id": "g", "type": "a", "time": "2024-01-01T00:00:00Z", "attributes": [1]}']}
    for section, texts in lines.items():
        (tmp_path / section).mkdir()
        (tmp_path / section / "part.json").write_text("\n".join(texts))
    violations = documents.document_violations(spark, str(tmp_path))
    assert {(r["path"], r["message"]) for r in violations.collect() if "list" in r["message"] or ": attr" in r["message"]} >= {
        ("eventTypes[b]", "absent: attributes"), ("eventTypes[c]", "not a list: attributes"),
        ("eventTypes[e]", "not a list: attributes"), ("events[f]", "not a list: relationships")}
    plan = violations._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" in plan.lower() or "jsontostructs" in plan.lower()
    assert "_whole" not in plan         # no column of whole entries: they are parsed where a list is missing
