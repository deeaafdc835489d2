"""Pairing of sends and receives against the plain rule."""

import pandas as pd
import pytest

import brute
from conftest import event, forced, frame
from data import random_rows
from tracewright.operators import match as J


def expected(rows):
    return sorted((case, f"e::{case}::{i}", f"e::{case}::{j}")
                  for (_, case), events in brute.cases_of(rows).items()
                  for i, j in brute.pairs(events).items())


def found(spark, rows, **options):
    pairs = J.message_pairs(J.match_messages(frame(spark, rows), **options)).drop("log")
    return sorted(tuple(r) for r in pairs.collect())


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("known", [1.0, 0.6])
def test_random_cases(spark, seed, known):
    rows = random_rows(seed, cases=25, known=known, missing_times=seed % 2 == 1)
    assert found(spark, rows) == expected(rows)


@pytest.mark.parametrize("known", [1.0, 0.6])
def test_random_cases_cut_into_pieces(spark, known):
    rows = random_rows(7, cases=5, longest=40, known=known)
    assert found(spark, rows, skew=forced(None, 6), slice_rows=5) == expected(rows)


def test_rows_are_kept(spark):
    rows = random_rows(3, known=0.5)
    matched = J.match_messages(frame(spark, rows))
    assert matched.count() == len(rows)
    assert matched.filter("elem = 'SendTask' and sent.event_id != event_id").count() == 0


def pair(spark, *events):
    return [(s.rsplit("::")[-1], r.rsplit("::")[-1]) for _, s, r in found(spark, list(events))]


def test_receive_before_send_stays_alone(spark):
    rows = [event("c", 0, 1, "ReceiveTask", "B", "A"), event("c", 1, 2, "SendTask", "A", receiver="B")]
    assert pair(spark, *rows) == []
    alone = J.unmatched_receives(J.match_messages(frame(spark, rows)))
    assert [r["event_id"] for r in alone.collect()] == ["e::c::0"]


def test_equal_times_match_in_any_file_order(spark):
    assert pair(spark, event("c", 0, 1, "ReceiveTask", "B", "A"),
                event("c", 1, 1, "SendTask", "A", receiver="B")) == [("1", "0")]


def test_first_send_wins(spark):
    assert pair(spark, event("c", 0, 1, "SendTask", "A"), event("c", 1, 2, "SendTask", "A"),
                event("c", 2, 3, "ReceiveTask", "B", "A")) == [("0", "2")]


def test_unknown_party_agrees_with_any(spark):
    rows = [event("c", 0, 1, "SendTask", "A", receiver="B"), event("c", 1, 2, "SendTask", "C", receiver="B"),
            event("c", 2, 3, "ReceiveTask", "B"), event("c", 3, 4, "ReceiveTask", "B", "A", "B")]
    assert J.has_mixed_cases(frame(spark, rows))
    assert found(spark, rows) == expected(rows)


def test_unknown_element_types_are_no_messages(spark):
    assert pair(spark, event("c", 0, 1, "Call"), event("c", 1, 2, "ReceiveTask")) == []


def test_missing_case_is_left_out_and_missing_time_comes_last(spark):
    rows = [event(None, 0, 1), event("c", 1, None), event("c", 2, 5)]
    ordered = J.order_events(frame(spark, rows)).df().orderBy("idx").collect()
    assert [(r["src_order"], r["event_id"]) for r in ordered] == [(2, "e::c::0"), (1, "e::c::1")]


def test_one_call_walks_several_cases():
    columns = ["log", "case_id", "idx", "place", "is_send", "sender", "receiver"]
    rows = pd.DataFrame([("l", "a", 0, 0, True, "A", None), ("l", "b", 1, 1, False, "A", "B"),
                         ("l", "b", 0, 0, True, None, "B"), ("l", "c", 0, 0, False, None, None),
                         ("l", "a", 1, 1, False, "A", "C")], columns=columns)
    served = J._walk(rows)
    assert sorted(map(tuple, served.to_numpy().tolist())) == [("l", "a", 1, 0), ("l", "b", 1, 0)]


def test_many_cases_take_few_calls(spark, monkeypatch):
    rows = random_rows(5, cases=40, known=0.6)
    wanted, calls = expected(rows), spark.sparkContext.accumulator(0)
    walk = J._walk

    def counted(messages):
        calls.add(1)
        return walk(messages)

    monkeypatch.setattr(J, "_walk", counted)
    assert found(spark, rows) == wanted
    assert calls.value < 5
