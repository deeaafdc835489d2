"""Files that break, repeat keys or use reserved names."""

import pytest

from tracewright.config import LogSpec
from tracewright.operators import mapping, match
from tracewright.operators.skew import Skew
from tracewright.sources import documents, flat, relational, xes

EVENT = """<event><string key="concept:name" value="a"/><string key="concept:name" value="{name}"/>
<date key="time:timestamp" value="2024-01-01T00:00:00Z"/><string key="collab:participant" value="A"/>
<string key="elemType" value="odd"/><string key="src_order" value="77"/></event>"""
TRACE = """<trace><string key="concept:name" value="{case}"/><string key="concept:name" value="{case}{case}"/>
{event}</trace>"""


def write(path, cases, broken=False):
    traces = [TRACE.format(case=c, event=EVENT.format(name=f"b{c}")) for c in cases]
    if broken:
        traces[1] = traces[1].replace("</trace>", "</event></trace>", 1)
    path.write_text("<log>" + "".join(traces) + "</log>")
    return str(path)


def test_the_last_of_repeated_keys_counts(spark, tmp_path):
    rows = xes.read_event_log(spark, write(tmp_path / "a.xes", "xy"), "l").collect()
    assert sorted((r["case_id"], r["activity"]) for r in rows) == [("xx", "bx"), ("yy", "by")]
    assert all("elemType" not in r["residual"] for r in rows)


def test_a_broken_log_is_an_error_and_stops_no_other(spark, tmp_path):
    specs = [LogSpec("good", write(tmp_path / "a.xes", "xy")), LogSpec("bad", write(tmp_path / "b.xes", "xyz", True)),
             LogSpec("gone", str(tmp_path / "none.xes"))]
    rows, errors = flat.read_logs(specs, lambda s: xes.read_event_log(spark, s.events, s.name))
    assert {r["log"] for r in rows.collect()} == {"good"} and rows.count() == 2
    assert [e["log"] for e in errors] == ["bad", "gone"] and all(e["error"] for e in errors)


def test_reserved_names_in_residuals_do_not_stop_an_export(spark, tmp_path):
    src = xes.read_event_log(spark, write(tmp_path / "a.xes", "xy"), "l")
    r = mapping.relations_of(match.match_messages(src, Skew.of(src)))
    relational.write_relational(r, str(tmp_path / "tables"))
    back = relational.read_relational(spark, str(tmp_path / "tables"))
    assert sorted((e["activity"], e["elem_type"]) for e in back.events.collect()) == [("bx", "task"), ("by", "task")]
    documents.write_documents(r, str(tmp_path / "json"))
    assert documents.document_violations(spark, str(tmp_path / "json")).count() == 0
    assert documents.read_documents(spark, str(tmp_path / "json")).events.count() == 2


def test_a_cut_off_line_fails(spark, tmp_path):
    for section in ("events", "objects"):
        (tmp_path / section).mkdir()
        (tmp_path / section / "part.json").write_text('{"log": "l", "id": "e1", "type": "a", "attributes": [{"na')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        documents.read_documents(spark, str(tmp_path)).events.collect()


def test_rules_on_types_names_times_and_lists(spark, tmp_path):
    entries = {"eventTypes": '{"name": "t"}', "objectTypes": '{"name": 3, "attributes": {}}',
               "events": '{"id": 7, "type": "a", "time": "soon", "attributes": [{"value": "v"}], "relationships": 1}',
               "objects": '{"id": "o", "type": "a", "attributes": [{"name": "n", "value": "v", "time": "2024-01-01"}]}'}
    for section, line in entries.items():
        (tmp_path / section).mkdir()
        (tmp_path / section / "part.json").write_text(line)
    found = {(r["section"], r["message"]) for r in documents.document_violations(spark, str(tmp_path)).collect()}
    assert found == {("eventTypes", "absent: attributes"), ("objectTypes", "not text: name"),
                     ("objectTypes", "not a list: attributes"), ("events", "not text: id"),
                     ("events", "no date and time: time"), ("events", "absent: name"),
                     ("events", "not a list: relationships"), ("objects", "no date and time: time")}
