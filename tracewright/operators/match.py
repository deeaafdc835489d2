"""Pairing message sends with receives inside a case.

In case order, each send takes the earliest unused receive that is not earlier than the send and
whose parties agree: `from` of the receive with the sender, `to` of the receive with the receiver
named by the send. A missing party agrees with any.

Sends and receives both prefer the earliest partner, so walking over the receives and giving each
the earliest waiting send yields the same pairs as walking over the sends: the first send and its
earliest receive want each other above all, and so on by induction.

* If inside a case each party is either known on both sides or missing on a whole side, parties
  split the case into independent first-in-first-out queues. A queue is two running sums and a
  running minimum, and the r-th served receive belongs to the r-th send. This is all windows.
* Cases that mix known and missing parties on one side need the actual waiting lists. They are
  walked in slices of bounded size; sends still waiting move on to the next slice.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.config import VOCABULARY as V
from tracewright.functions.columns import event_id
from tracewright.operators.ordered import OrderedGroups, max_all, min_before, sum_before
from tracewright.operators.skew import Skew
from tracewright.session import materialize

CASE = ["log", "case_id"]
SLICE_ROWS = 200_000  # messages of one case walked by one task
WALK_ROWS = 20_000    # messages of all cases that are walked by one call


def order_events(src: DataFrame, skew: Skew | None = None) -> OrderedGroups:
    """Events with their position in the case (time, then source order) and a minted id.

    Events without a case cannot be placed and are left out; the check of totality reports them.
    """
    placed = src.filter(F.col("case_id").isNotNull())
    groups = OrderedGroups(placed, CASE, ["ts", "src_order"], skew)
    groups = groups.scan(idx=sum_before(F.lit(1)))
    index = F.coalesce(F.col("idx"), F.lit(0)).cast("long")
    return groups.with_columns({"idx": index, "event_id": event_id(F.col("case_id"), index)})


def _is_send() -> Column:
    return F.col("elem") == V.send_elem


def _is_receive() -> Column:
    return F.col("elem") == V.receive_elem


def _party_flags() -> dict[str, Column]:
    """Is some (s)end or (r)eceive with a (k)nown or (m)issing `from`/`to` party in the case?"""
    flags = {}
    from_party = F.when(_is_send(), F.col("participant")).otherwise(F.col("from_participant"))
    for name, party in (("from", from_party), ("to", F.col("to_participant"))):
        for side, rows in (("s", _is_send()), ("r", _is_receive())):
            flags[f"_{name}_{side}k"] = rows & party.isNotNull()
            flags[f"_{name}_{side}m"] = rows & party.isNull()
    return flags


def _always_known(name: str) -> Column:
    return ~(F.col(f"_{name}_sm") | F.col(f"_{name}_rm"))


def _mixed() -> Column:
    def mixed(name: str) -> Column:
        return ~_always_known(name) & F.col(f"_{name}_sk") & F.col(f"_{name}_rk")
    return mixed("from") | mixed("to")


def mixed_cases(src: DataFrame) -> DataFrame:
    """Cases where some message names a party and another on the same side does not."""
    return _messages(src).groupBy(*CASE).agg(*_any_flags()).filter(_mixed()).select(*CASE)


def has_mixed_cases(src: DataFrame) -> bool:
    # Parties that do not mix in the whole source do not mix in any case, and that takes no shuffle.
    if _messages(src).agg(*_any_flags()).filter(_mixed()).isEmpty():
        return False
    return not mixed_cases(src).isEmpty()


def _messages(src: DataFrame) -> DataFrame:
    return src.filter(F.col("case_id").isNotNull() & (_is_send() | _is_receive()))


def _any_flags() -> list[Column]:
    return [F.bool_or(c).alias(n) for n, c in _party_flags().items()]


def match_messages(src: DataFrame, skew: Skew | None = None,
                   slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Ordered events with `sent`: the send event, its sender and its receiver.

    `sent` is set on every send and on every receive that was paired with one.
    """
    ordered = order_events(src, skew)
    flagged = ordered.scan(**{n: max_all(c) for n, c in _party_flags().items()})
    if not has_mixed_cases(src):
        return _serve_queues(flagged)
    flagged = flagged.with_columns({"_mixed": _mixed()})
    regular = _serve_queues(flagged.apply(lambda df: df.filter(~F.col("_mixed"))))
    walked = _walk_waiting_lists(flagged.df().filter("_mixed"), skew, slice_rows)
    return regular.unionByName(walked.select(*regular.columns))


def _sent() -> Column:
    return F.struct(F.col("event_id"), F.col("participant"), F.col("to_participant"))


def _serve_queues(events: OrderedGroups) -> DataFrame:
    from_party = F.when(_is_send(), F.col("participant")).otherwise(F.col("from_participant"))
    step = F.when(_is_send(), 1).when(_is_receive(), -1).otherwise(0).cast("long")
    # At equal times sends come first, so that a receive listed before its send is still served.
    events = events.with_columns({
        "_from": F.when(_always_known("from") & (_is_send() | _is_receive()), from_party),
        "_to": F.when(_always_known("to"), F.col("to_participant")),
        "_kind": F.when(F.col("ts").isNotNull() & _is_receive(), 1).otherwise(0),
        "_step": step})

    queues = events.regroup(CASE + ["_from", "_to"], ["ts", "_kind", "idx"]).scan(
        _waiting=sum_before(F.col("_step")), _sends=sum_before(_is_send().cast("long")))
    # `_waiting` falls below every earlier value exactly when a receive finds the queue empty.
    queues = queues.with_columns(
        {"_waiting": F.coalesce(F.col("_waiting"), F.lit(0)) + F.col("_step")})
    queues = queues.scan(_lowest=min_before(F.col("_waiting")))
    lowest = F.least(F.lit(0), F.coalesce(F.col("_lowest"), F.lit(0)))
    queues = queues.with_columns({"_served": _is_receive() & (F.col("_waiting") >= lowest)})
    queues = queues.scan(_receives=sum_before(F.col("_served").cast("long")))
    rank = (F.when(_is_send(), F.coalesce(F.col("_sends"), F.lit(0)))
            .when(F.col("_served"), F.coalesce(F.col("_receives"), F.lit(0)))
            .otherwise(-1 - F.col("idx")))
    ranked = queues.with_columns({"_rank": rank}).df()

    # One send and at most one receive share a rank.
    pair = Window.partitionBy(*CASE, "_from", "_to", "_rank")
    return (ranked.withColumn("sent", F.max(F.when(_is_send(), _sent())).over(pair))
            .select(*[c for c in ranked.columns if not c.startswith("_")], "sent"))


def _walk_waiting_lists(events: DataFrame, skew: Skew | None, slice_rows: int) -> DataFrame:
    columns = [c for c in events.columns if not c.startswith("_")]
    messages = OrderedGroups(events.filter(_is_send() | _is_receive())
                             .withColumn("_kind", F.when(F.col("ts").isNotNull() & _is_receive(), 1)
                                         .otherwise(0)),
                             CASE, ["ts", "_kind", "idx"], skew)
    messages = messages.scan(_place=sum_before(F.lit(1)))
    place = F.coalesce(F.col("_place"), F.lit(0)).cast("long")
    messages = materialize(messages.df().select(
        *CASE, "idx", place.alias("place"), F.floor(place / slice_rows).alias("slice"),
        _is_send().alias("is_send"),
        F.when(_is_send(), F.col("participant")).otherwise(F.col("from_participant")).alias("sender"),
        F.col("to_participant").alias("receiver")), "messages")

    last = messages.agg(F.max("slice")).first()[0]
    pairs, waiting = [], None
    for number in range(last + 1):
        rows = messages.filter(F.col("slice") == number)
        if waiting is not None:
            # A slice has at most slice_rows receives, so no more sends of equal parties are needed.
            parties = OrderedGroups(waiting, CASE + ["sender", "receiver"], ["place"], skew, by=CASE)
            ranked = parties.scan(_ahead=sum_before(F.lit(1))).df()
            front = ranked.filter(F.coalesce(F.col("_ahead"), F.lit(0)) < slice_rows)
            rows = rows.unionByName(front.drop("_ahead"))
        # Cases are walked many at a time, since a call costs far more than the few messages of most cases.
        calls = messages.filter(F.col("slice") == number).count() // WALK_ROWS + 1
        found = rows.withColumn("call", F.pmod(F.xxhash64(*CASE), F.lit(calls))).groupBy("call").applyInPandas(
            _walk, "log string, case_id string, idx long, partner long")
        found = materialize(found, "pairs") if number < last else found
        pairs.append(found)
        if number < last:
            sends = messages.filter((F.col("slice") == number) & F.col("is_send"))
            sends = sends if waiting is None else sends.unionByName(waiting)
            waiting = materialize(
                sends.join(found.select(*CASE, F.col("partner").alias("idx")),
                           CASE + ["idx"], "left_anti"), "waiting")
    matched = reduce(lambda a, b: a.unionByName(b), pairs)

    sends = events.filter(_is_send()).select(*CASE, F.col("idx").alias("partner"),
                                             _sent().alias("_send"))
    paired = matched.join(sends, CASE + ["partner"]).drop("partner")
    return (events.join(paired, CASE + ["idx"], "left")
            .withColumn("sent", F.when(_is_send(), _sent()).otherwise(F.col("_send")))
            .select(*columns, "sent"))


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Give each receive of one or more cases the earliest waiting send of its case whose parties agree."""
    rows = rows.sort_values("place")
    cases: dict[tuple, dict[tuple, deque]] = {}
    served = []
    names = [*CASE, "sender", "receiver"]
    texts = rows[names].astype(object).where(rows[names].notna(), None)
    for log, case, sender, receiver, idx, is_send, place in zip(
            *[texts[n] for n in names], rows["idx"], rows["is_send"], rows["place"]):
        waiting = cases.setdefault((log, case), {})
        if is_send:
            waiting.setdefault((sender, receiver), deque()).append((place, idx))
            continue
        fitting = [key for key, queue in waiting.items() if queue
                   and (sender is None or key[0] is None or key[0] == sender)
                   and (receiver is None or key[1] is None or key[1] == receiver)]
        if fitting:
            first = min(fitting, key=lambda key: waiting[key][0])
            served.append((log, case, idx, waiting[first].popleft()[1]))
    return pd.DataFrame(served, columns=[*CASE, "idx", "partner"]).astype({"idx": "int64", "partner": "int64"})


def message_pairs(matched: DataFrame) -> DataFrame:
    """(log, case_id, send_event, receive_event) of the matched receives."""
    return matched.filter(_is_receive() & F.col("sent").isNotNull()).select(
        *CASE, F.col("sent.event_id").alias("send_event"), F.col("event_id").alias("receive_event"))


def unmatched_receives(matched: DataFrame) -> DataFrame:
    return matched.filter(_is_receive() & F.col("sent").isNull()).select(*CASE, "event_id")
