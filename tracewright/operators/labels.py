"""Prediction targets at every prefix of every execution.

A rule names the scans it needs and the value it makes of them. All tasks of a call share one
window exchange; scans wanted by several rules are computed once. An undefined label is NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.catalog import TASKS, Task, task as task_of
from tracewright.functions.columns import or_else, seconds_between
from tracewright.operators.load import with_load
from tracewright.operators.ordered import (OrderedGroups, Scan, following, max_after, max_all,
                                           min_all, next_row, sum_after, sum_all, sum_before)
from tracewright.operators.skew import Skew
from tracewright.operators.trace import EXECUTION, TRACE_ORDER, trace_groups
from tracewright.session import size_shuffles, small

PARTICIPANT, ACTIVITY = "_participant", "_activity"  # parameter columns


@dataclass(frozen=True)
class Rule:
    scans: dict[str, Scan]
    value: Column


Rules = Callable[[], Rule]
_registry: dict[str, Rules] = {}


def register(key: str) -> Callable[[Rules], Rules]:
    """Register the rule of a task; users may add rules for tasks of their own."""
    def add(rule: Rules) -> Rules:
        _registry[key] = rule
        return rule
    return add


def _is_message() -> Column:
    return F.col("is_send") | F.col("is_receive")


def _sender() -> Column:
    return or_else(F.col("msg_from"), F.col("actor"))


def _by_participant() -> Column:
    return F.col("actor") == F.col(PARTICIPANT)


def _next() -> dict[str, Scan]:
    return {"_next": next_row("activity", "actor", "ts")}


def _next_send() -> dict[str, Scan]:
    sent = F.struct(_sender().alias("sender"), "ts")
    return {"_next_send": following(F.when(F.col("is_send"), sent))}


def _seconds_to(end: str) -> Column:
    return seconds_between(F.col("ts"), F.col(end))


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("double")


@register("NE-NEPr")
def _next_activity() -> Rule:
    return Rule(_next(), F.col("_next.activity"))


@register("NE-NPaA")
def _next_actor() -> Rule:
    return Rule(_next(), F.col("_next.actor"))


@register("NE-NEPa")
def _next_activity_and_actor() -> Rule:
    return Rule(_next(), F.concat("_next.activity", F.lit("||"), "_next.actor"))


@register("NE-NPaM")
def _next_sender() -> Rule:
    return Rule(_next_send(), F.col("_next_send.sender"))


@register("NE-NMPa")
def _next_message_of_participant() -> Rule:
    found = F.when(_is_message() & _by_participant(), F.col("activity"))
    return Rule({"_next_own_message": following(found)}, F.col("_next_own_message"))


@register("NE-NMPr")
def _next_message() -> Rule:
    found = F.when(_is_message(), F.col("activity"))
    return Rule({"_next_message": following(found)}, F.col("_next_message"))


@register("NV-PrT")
def _remaining_time() -> Rule:
    return Rule({"_end": max_all(F.col("ts"))}, _seconds_to("_end"))


@register("NV-PaT")
def _remaining_time_of_participant() -> Rule:
    last = max_after(F.when(_by_participant(), F.col("ts")))
    return Rule({"_own_end": last}, F.coalesce(_seconds_to("_own_end"), F.lit(0.0)))


@register("NV-TNE")
def _time_to_next() -> Rule:
    return Rule(_next(), _seconds_to("_next.ts"))


@register("NV-TNM")
def _time_to_next_send() -> Rule:
    return Rule(_next_send(), _seconds_to("_next_send.ts"))


@register("NV-NMPr")
def _sends_left() -> Rule:
    return Rule({"_sends_left": sum_after(F.col("is_send").cast("int"))}, _count("_sends_left"))


@register("NV-NMPa")
def _sends_left_of_participant() -> Rule:
    own = F.when(F.col("is_send") & (_sender() == F.col(PARTICIPANT)), 1)
    return Rule({"_own_sends_left": sum_after(own)}, _count("_own_sends_left"))


@register("OB-P")
def _participant_returns() -> Rule:
    own = F.when(_by_participant(), True)
    return Rule({"_own_left": max_after(own)}, F.coalesce("_own_left", F.lit(False)))


@register("OB-M")
def _message_will_be_sent() -> Rule:
    sent = F.when(F.col("is_send") & (F.col("activity") == F.col(ACTIVITY)), True)
    return Rule({"_activity_left": max_after(sent)}, F.coalesce("_activity_left", F.lit(False)))


@register("X-MSt")
def _synchronisation_time() -> Rule:
    # The struct keeps a send without a receive in view; a later send must not replace it.
    sent = F.struct("ts", "received_ts")
    return Rule({"_next_sync": following(F.when(F.col("is_send"), sent))},
                seconds_between(F.col("_next_sync.ts"), F.col("_next_sync.received_ts")))


@register("X-PaL")
def _participant_load() -> Rule:
    own = F.when(_by_participant(), F.struct("load"))
    return Rule({"_next_own": following(own)},
                F.coalesce("_next_own.load", F.lit(0)).cast("double"))


def with_receive_time(groups: OrderedGroups) -> OrderedGroups:
    """Add `received_ts`: when the event's message is first received in the execution."""
    # Events without a message form groups of their own.
    key = F.coalesce("msg_id", F.concat(F.lit("-"), "event_id"))
    messages = groups.with_columns({"_msg": key}).regroup(groups.keys + ["_msg"], groups.order)
    received = F.when(F.col("is_receive") & F.col("msg_id").isNotNull(), F.col("ts"))
    return messages.scan(received_ts=min_all(received)).regroup(groups.keys, groups.order)


def _loaded(trace: DataFrame, tasks: list[Task], skew: Skew | None) -> DataFrame:
    return with_load(trace, skew) if any(t.key == "X-PaL" for t in tasks) else trace


def _require_parameters(tasks: Iterable[Task], **given: object) -> None:
    for t in tasks:
        if t.param and given.get(t.param) is None:
            raise ValueError(f"{t.key} needs a {t.param}")


def label_columns(trace: DataFrame, keys: Iterable[str], participant: str | Column | None = None,
                  activity: str | Column | None = None, skew: Skew | None = None,
                  order: list[str] = TRACE_ORDER) -> DataFrame:
    """One row per prefix and one column per task, for one parameter value each.

    Parameters are literals or columns of `trace` (a parameter per log, say).
    """
    tasks = [task_of(k) if k in TASKS else Task(k, "", "", "") for k in keys]
    _require_parameters(tasks, participant=participant, activity=activity)
    rows = _loaded(trace, tasks, skew)
    for name, value in ((PARTICIPANT, participant), (ACTIVITY, activity)):
        if value is not None:
            rows = rows.withColumn(name, value if isinstance(value, Column) else F.lit(value))
    groups = trace_groups(rows, skew, order)
    return _labelled(groups, tasks, ["case_id", "event_id"])


def _places() -> dict[str, Scan]:
    return {"_k": sum_before(F.lit(1)), "_n": sum_all(F.lit(1))}


def _labelled(groups: OrderedGroups, tasks: list[Task], kept: list[str], placed: bool = False) -> DataFrame:
    missing = [t.key for t in tasks if t.key not in _registry]
    if missing:
        raise ValueError(f"no label rule for: {', '.join(missing)}")
    rules = {t.key: _registry[t.key]() for t in tasks}
    scans: dict[str, Scan] = {} if placed else _places()
    for rule in rules.values():
        scans.update(rule.scans)
    if "X-MSt" in rules:
        groups = with_receive_time(groups)
    # Prefix k stands before the event that follows it, so the last event is no prefix end.
    k = (F.coalesce(F.col("_k"), F.lit(0)) + 1).cast("int")
    scanned = groups.scan(**scans).with_columns({"k": k}).df().filter(F.col("k") < F.col("_n"))
    labels = [rule.value.alias(key) for key, rule in rules.items()]
    return scanned.select("log", *kept, "k", *labels)


def label_rows(trace: DataFrame, key: str, param: str | None = None, skew: Skew | None = None,
               order: list[str] = TRACE_ORDER, drop_undefined: bool = True) -> DataFrame:
    """(log, case_id, event_id, k, y) of one task; undefined rows are dropped by default."""
    t = task_of(key)
    given = {t.param: param} if t.param else {}
    wide = label_columns(trace, [key], given.get("participant"), given.get("activity"), skew, order)
    rows = wide.withColumnRenamed(key, "y")
    return rows.filter(F.col("y").isNotNull()) if drop_undefined and t.kind != "binary" else rows


def long_labels(wide: DataFrame, keys: Iterable[str], params: dict[str, Column] | None = None
                ) -> DataFrame:
    """Unpivot label columns: one row per task and prefix, with one value column per type."""
    def item(key: str) -> Column:
        kind = task_of(key).kind
        typed = {"categorical": "string", "numeric": "double", "binary": "boolean"}
        param = (params or {}).get(key, F.lit(None))

        def value(of: str) -> Column:
            return (F.col(f"`{key}`") if kind == of else F.lit(None)).cast(typed[of])

        return F.struct(F.lit(key).alias("task"), param.cast("string").alias("param"),
                        value("categorical").alias("y_str"), value("numeric").alias("y_num"),
                        value("binary").alias("y_bool"))

    items = F.explode(F.array(*[item(k) for k in keys])).alias("item")
    return wide.select("log", "case_id", "event_id", "k", items).select(
        "log", "item.task", "item.param", "case_id", "event_id", "k",
        "item.y_str", "item.y_num", "item.y_bool")


# --- parameter domains -----------------------------------------------------------------------

def parameter_domain(trace: DataFrame) -> DataFrame:
    """Distinct actors and send activities per log: (log, kind, param)."""
    actors = trace.filter(F.col("actor") != "").select(
        "log", F.lit("participant").alias("kind"), F.col("actor").alias("param"))
    activities = trace.filter("is_send").select(
        "log", F.lit("activity").alias("kind"), F.col("activity").alias("param"))
    return actors.unionByName(activities).distinct()


def all_label_rows(trace: DataFrame, keys: Iterable[str], domain: DataFrame,
                   skew: Skew | None = None, order: list[str] = TRACE_ORDER) -> DataFrame:
    """Long labels of all tasks for every parameter value in `domain`; undefined rows are kept.

    `domain` lists parameters per log, or per case if it has a case_id column. The n-th participant
    and the n-th activity share one pass over the trace, so it is repeated max(participants,
    activities) times, not their product.
    """
    tasks = [task_of(k) for k in keys]
    plain = [t for t in tasks if not t.param]
    asked = [t for t in tasks if t.param]
    parts = []
    if plain:
        names = [t.key for t in plain]
        wide = _labelled(trace_groups(_loaded(trace, plain, skew), skew, order), plain,
                         ["case_id", "event_id"])
        parts.append(long_labels(wide, names))
    if asked:
        parts.append(_labels_per_parameter(trace, [t.key for t in asked], domain, skew, order))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def parameter_slots(domain: DataFrame, skew: Skew | None = None) -> DataFrame:
    """One row per slot of a scope (log, or log and case_id): its participant and activity, if any.

    The n-th participant and the n-th activity of the scope in text order share slot n.
    """
    scope = [c for c in ("log", "case_id") if c in domain.columns]
    numbered = OrderedGroups(domain, scope + ["kind"], ["param"], skew, of="parameters")
    numbered = numbered.scan(_at=sum_before(F.lit(1)))
    slot = F.coalesce(F.col("_at"), F.lit(0)).cast("long").alias("_slot")
    return numbered.df().select(*scope, "kind", "param", slot).groupBy(*scope, "_slot").agg(
        F.max(F.when(F.col("kind") == "participant", F.col("param"))).alias(PARTICIPANT),
        F.max(F.when(F.col("kind") == "activity", F.col("param"))).alias(ACTIVITY))


def wide_per_parameter(trace: DataFrame, keys: Iterable[str], domain: DataFrame,
                       skew: Skew | None = None, order: list[str] = TRACE_ORDER) -> DataFrame:
    """One row per prefix and parameter slot, one column per task.

    Two traces with the same `domain` have the same slots; `parameter_slots` of a domain may be given instead.
    """
    tasks = [task_of(k) for k in keys]
    scope = [c for c in ("log", "case_id") if c in domain.columns]
    pairs = domain if "_slot" in domain.columns else parameter_slots(domain, skew)
    # Parameters of a log are few and are broadcast if they are; parameters of cases are joined
    # with a shuffle, whose skewed partitions AQE splits.
    if scope == ["log"]:
        pairs = small(pairs)
    # An event has one place for all parameters, so places are found before rows are repeated, and rows that are
    # repeated are sorted only once, the other way round.
    rows = trace_groups(_loaded(trace, tasks, skew), skew, order).scan(**_places()).df()
    rows = rows.withColumn("_k", F.coalesce(F.col("_k"), F.lit(0))).join(pairs, scope)
    if scope == ["log"]:
        rows = rows.repartition(*EXECUTION, "_slot")
    # Rows are counted with their repeats: a window may hold all parameters of an execution.
    most = pairs.groupBy(*scope).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] if skew else 1
    sized = replace(skew, rows=skew.rows * (most or 1)) if skew else None
    if sized:
        size_shuffles(trace.sparkSession, sized.rows)
    groups = trace_groups(rows, sized, order, also=["_slot"], of="events by parameter")
    return _labelled(groups, tasks, ["case_id", "event_id", "_slot", PARTICIPANT, ACTIVITY], placed=True)


def parameter_of(key: str) -> Column:
    """Column of `wide_per_parameter` that holds the parameter of a task."""
    return F.col(PARTICIPANT if task_of(key).param == "participant" else ACTIVITY)


def _labels_per_parameter(trace: DataFrame, keys: list[str], domain: DataFrame,
                          skew: Skew | None, order: list[str]) -> DataFrame:
    wide = wide_per_parameter(trace, keys, domain, skew, order)
    params = {key: parameter_of(key) for key in keys}
    return long_labels(wide, keys, params).filter(F.col("param").isNotNull())
