"""All sixteen targets against plain Python."""

import pytest
from pyspark.sql import functions as F

import brute
from conftest import at, event, forced, frame, same_rows
from data import random_rows
from tracewright.catalog import EXTENDED_TASKS, COMPARED_TASKS, REPRESENTATIVE_TASKS, TASKS
from tracewright.operators import labels as L
from tracewright.operators import match as J
from tracewright.operators import trace as T
from tracewright.operators.mapping import transform


def trace_of(spark, rows, skew=None):
    return T.trace_of_matched(J.match_messages(frame(spark, rows), skew))


def given(key):
    return {"participant": "B", "activity": "x", None: None}[TASKS[key].param]


def as_rows(df):
    return sorted((r["case_id"], r["event_id"], r["k"], r["y"]) for r in df.collect())


@pytest.fixture(scope="module")
def sample(spark):
    rows = random_rows(11, cases=12, longest=15, known=0.9)
    trace = trace_of(spark, rows).cache()
    return rows, trace, brute.trace(rows)


@pytest.mark.parametrize("key", TASKS)
def test_task(sample, key):
    _, trace, executions = sample
    found = L.label_rows(trace, key, given(key), drop_undefined=False)
    expected = sorted(brute.labels(key, executions, given(key)), key=lambda r: r[:3])
    assert sorted(as_rows(found), key=lambda r: r[:3]) == expected


def test_all_tasks_with_cut_cases(spark, sample):
    _, trace, _ = sample
    plain = L.label_columns(trace, TASKS, "B", "x")
    same_rows(plain, L.label_columns(trace, TASKS, "B", "x", forced(trace)))


def test_every_parameter(sample):
    _, trace, executions = sample
    domain = L.parameter_domain(trace)
    found = L.all_label_rows(trace, ["NV-PaT", "OB-M", "X-PaL", "NE-NEPr"], domain)
    for task, param in (("NV-PaT", "C"), ("X-PaL", "A"), ("OB-M", "y"), ("NE-NEPr", None)):
        rows = found.filter((F.col("task") == task) & F.col("param").eqNullSafe(param))
        y = F.coalesce("y_str", F.col("y_num").cast("string"), F.col("y_bool").cast("string"))
        got = sorted(tuple(r) for r in rows.select("event_id", y).collect())
        text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        assert got == sorted((e, text(v)) for _, e, _, v in brute.labels(task, executions, param))


def test_undefined_rows_are_dropped_by_default(sample):
    _, trace, executions = sample
    kept = [y for *_, y in brute.labels("NV-TNM", executions) if y is not None]
    assert L.label_rows(trace, "NV-TNM").count() == len(kept)


def test_ties_use_the_event_id_as_text(spark):
    trace = trace_of(spark, [event("c", i, 0, activity=f"a{i}") for i in range(12)])
    rows = L.label_rows(trace, "NE-NEPr").orderBy("k").collect()
    assert [r["event_id"] for r in rows][:4] == ["e::c::0", "e::c::1", "e::c::10", "e::c::11"]
    by_source = L.label_rows(trace, "NE-NEPr", order=["ts", "src_order"]).orderBy("k").collect()
    assert [r["y"] for r in by_source] == [f"a{i}" for i in range(1, 12)]


def test_single_event_case_has_no_prefix(spark):
    assert L.label_rows(trace_of(spark, [event("c", 0, 0)]), "NE-NEPr").count() == 0


@pytest.mark.parametrize("key", [k for k, t in TASKS.items() if t.param])
def test_missing_parameter(spark, key):
    with pytest.raises(ValueError):
        L.label_rows(trace_of(spark, [event("c", 0, 0)]), key)


def test_unknown_task(spark):
    with pytest.raises(ValueError):
        L.label_rows(trace_of(spark, [event("c", 0, 0)]), "no task")


def test_own_rule(spark):
    @L.register("XX-Last")
    def last_activity():
        return L.Rule({"_next": L.next_row("activity", "actor", "ts")}, F.upper("_next.activity"))
    wide = L.label_columns(trace_of(spark, [event("c", 0, 0), event("c", 1, 1, activity="b")]), ["XX-Last"])
    assert wide.first()["XX-Last"] == "B"


TRACE = ("log string, ci_oid string, case_id string, event_id string, activity string, ts timestamp, "
         "actor string, is_send boolean, is_receive boolean, msg_id string, msg_type string, "
         "msg_from string, msg_to string, src_order long")


def made(spark, *rows):
    """Trace rows (ci, case, id, seconds, actor, send, receive, message)."""
    return spark.createDataFrame(
        [("log", ci, case, e, "act", at(s), who, send, receive, msg, None, None, None, None)
         for ci, case, e, s, who, send, receive, msg in rows], TRACE)


def test_send_without_message_hides_later_sends(spark):
    trace = made(spark, ("i", "c", "1", 0, "A", False, False, None), ("i", "c", "2", 1, "A", True, False, None),
                 ("i", "c", "3", 2, "A", True, False, "m"), ("i", "c", "4", 5, "B", False, True, "m"))
    rows = {r["k"]: r["y"] for r in L.label_rows(trace, "X-MSt", drop_undefined=False).collect()}
    assert rows == {1: None, 2: 3.0, 3: None}


def test_receive_may_come_before_its_send(spark):
    trace = made(spark, ("i", "c", "1", 0, "B", False, True, "m"), ("i", "c", "2", 4, "A", True, False, "m"))
    assert L.label_rows(trace, "X-MSt").first()["y"] == -4.0


def test_load_counts_closed_spans_of_other_cases_only(spark):
    rows = [("i1", "c1", "1", 0, "A", False, False, None), ("i1", "c1", "2", 10, "A", False, False, None),
            ("i2", "c2", "3", 5, "A", False, False, None), ("i2", "c2", "4", 10, "A", False, False, None),
            ("i3", "c1", "5", 9, "A", False, False, None), ("i3", "c1", "6", 12, "A", False, False, None)]
    trace = made(spark, *rows)
    found = {(r["event_id"]): r["y"] for r in L.label_rows(trace, "X-PaL", "A").collect()}
    # i1 and i3 share the case id c1, so neither counts for the other.
    assert found == {"1": 1.0, "3": 2.0, "5": 0.0}
    same_rows(L.label_rows(trace, "X-PaL", "A"), L.label_rows(trace, "X-PaL", "A", forced(trace, 2)))


def test_catalog_subsets():
    assert len(TASKS) == 16 and len(COMPARED_TASKS) == 14
    assert EXTENDED_TASKS == ["X-PaL", "X-MSt"] and len(REPRESENTATIVE_TASKS) == 6


def test_relations_give_the_same_trace(spark, sample):
    rows, trace, _ = sample
    same_rows(trace, T.trace_of_relations(transform(frame(spark, rows))))


def test_one_exchange_from_source_to_labels(spark, tmp_path):
    frame(spark, random_rows(1)).write.parquet(str(tmp_path / "src"))
    trace = T.trace_of_matched(J.match_messages(spark.read.parquet(str(tmp_path / "src"))))
    wide = L.label_columns(trace, [k for k in TASKS if k != "X-PaL"], "B", "x")
    plan = wide._jdf.queryExecution().toString()
    assert plan[plan.index("== Physical Plan =="):].count("Exchange hashpartitioning") == 1
