"""SQL for the prediction targets: plain look-ahead over the suffix of the case."""

from oracles.base import EV, EVENTS, ORDERS, PAIRS, TRACE, with_ctes

SUFFIX = ("OVER (PARTITION BY log, case_id ORDER BY ts, event_id "
          "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)")
SECONDS = "(epoch_us({b}) - epoch_us({a})) / 1e6"


def _seconds(a: str, b: str) -> str:
    return SECONDS.format(a=a, b=b)


def _next(value: str, condition: str | None = None) -> str:
    if condition is None:
        return f"first_value({value}) {SUFFIX}"
    return f"first_value(CASE WHEN {condition} THEN {value} END IGNORE NULLS) {SUFFIX}"


def expressions(p: str, a: str) -> dict[str, str]:
    message = "(is_send OR is_receive)"
    return {
        "NE-NEPr": _next("activity"),
        "NE-NPaA": _next("actor"),
        "NE-NEPa": _next("activity || '||' || actor"),
        "NE-NPaM": _next("actor", "is_send"),
        "NE-NMPa": _next("activity", f"{message} AND actor = '{p}'"),
        "NE-NMPr": _next("activity", message),
        "NV-PrT": _seconds("ts", "max(ts) OVER (PARTITION BY log, case_id)"),
        "NV-PaT": "coalesce(" + _seconds(
            "ts", f"max(CASE WHEN actor = '{p}' THEN ts END) {SUFFIX}") + ", 0.0)",
        "NV-TNE": _seconds("ts", _next("ts")),
        "NV-TNM": _seconds("ts", _next("ts", "is_send")),
        "NV-NMPr": f"CAST(count(CASE WHEN is_send THEN 1 END) {SUFFIX} AS DOUBLE)",
        "NV-NMPa": f"CAST(count(CASE WHEN is_send AND actor = '{p}' THEN 1 END) {SUFFIX} AS DOUBLE)",
        "OB-P": f"count(CASE WHEN actor = '{p}' THEN 1 END) {SUFFIX} > 0",
        "OB-M": f"count(CASE WHEN is_send AND activity = '{a}' THEN 1 END) {SUFFIX} > 0",
    }


def x_pal(p: str) -> str:
    return f"""
spans AS (SELECT log, case_id, min(ts) AS first_ts, max(ts) AS last_ts FROM t
          WHERE actor = '{p}' GROUP BY log, case_id),
moments AS (SELECT log, case_id, event_id, k, n, {_next('ts', f"actor = '{p}'")} AS at FROM t),
pal AS (SELECT m.log, m.case_id, m.event_id, m.k, m.n,
               CAST(count(s.case_id) AS DOUBLE) AS y
        FROM moments m LEFT JOIN spans s ON s.log = m.log AND s.case_id <> m.case_id
             AND s.first_ts <= m.at AND m.at <= s.last_ts
        GROUP BY ALL)"""


X_MST = f"""
received AS (SELECT p.log, p.send_event, {_seconds('s.ts', 'r.ts')} AS wait FROM pairs p
             JOIN ev s ON s.log = p.log AND s.event_id = p.send_event
             JOIN ev r ON r.log = p.log AND r.event_id = p.receive_event),
next_send AS (SELECT log, case_id, event_id, k, n, {_next('event_id', 'is_send')} AS send_event FROM t),
mst AS (SELECT x.log, x.case_id, x.event_id, x.k, x.n, r.wait AS y FROM next_send x
        LEFT JOIN received r ON r.log = x.log AND r.send_event = x.send_event)"""


def single(key: str, p: str, a: str, source: str = EVENTS) -> str:
    columns = "case_id, event_id, k, y"
    if key == "X-PaL":
        return with_ctes(source, EV, TRACE, x_pal(p), query=f"SELECT {columns} FROM pal WHERE k < n")
    if key == "X-MSt":
        return with_ctes(source, EV, TRACE, PAIRS, X_MST,
                         query=f"SELECT {columns} FROM mst WHERE k < n AND y IS NOT NULL")
    y = expressions(p, a)[key]
    return with_ctes(source, EV, TRACE,
                     query=f"SELECT {columns} FROM (SELECT *, {y} AS y FROM t) "
                           "WHERE k < n AND y IS NOT NULL")


def wide(p: str, a: str, source: str = ORDERS) -> str:
    labels = ", ".join(f'{sql} AS "{key}"' for key, sql in expressions(p, a).items())
    return with_ctes(source, EV, TRACE, x_pal(p), PAIRS, X_MST, query=f"""
      SELECT l.* EXCLUDE (n), pal.y AS "X-PaL", mst.y AS "X-MSt"
      FROM (SELECT case_id, event_id, k, n, {labels} FROM t) l
      JOIN pal USING (case_id, event_id, k, n) JOIN mst USING (case_id, event_id, k, n)
      WHERE k < n""")


SOURCE_TRACE = """
t AS (
  SELECT *, row_number() OVER (PARTITION BY log, case_id ORDER BY ts, src_order) AS k,
         count(*) OVER (PARTITION BY log, case_id) AS n
  FROM ev
)"""


def in_source_order(sql: str) -> str:
    return sql.replace("ORDER BY ts, event_id", "ORDER BY ts, src_order")


def source_wide(p: str, a: str) -> str:
    labels = ", ".join(f'{in_source_order(sql)} AS "{key}"' for key, sql in expressions(p, a).items())
    return with_ctes(ORDERS, EV, SOURCE_TRACE, query=f"""
      SELECT * EXCLUDE (n) FROM (SELECT case_id, k, n, {labels} FROM t) WHERE k < n""")


PARTICIPANT_TASKS = ("NE-NMPa", "NV-PaT", "NV-NMPa", "OB-P")


def typed(key: str) -> str:
    at = {"NE": 0, "NV": 1, "X-": 1, "OB": 2}[key[:2]]
    columns = [f"CAST(NULL AS {t})" for t in ("VARCHAR", "DOUBLE", "BOOLEAN")]
    columns[at] = "y"
    return ", ".join(columns)


def long_selects(table: str, participants: list[str], activities: list[str],
                 source_order: bool = False) -> str:
    """Typed long labels of the fourteen tasks for all parameters, as (task, param, ...) rows."""
    parts = []

    def add(key: str, param: str, sql: str) -> None:
        sql = in_source_order(sql) if source_order else sql
        given = f"'{param}'" if param else "NULL"
        parts.append(f"SELECT '{key}', {given}, case_id, event_id, k, {typed(key)} "
                     f"FROM (SELECT *, {sql} AS y FROM {table}) WHERE k < n")

    for key, sql in expressions("", "").items():
        if key not in PARTICIPANT_TASKS and key != "OB-M":
            add(key, "", sql)
    for p in participants:
        for key in PARTICIPANT_TASKS:
            add(key, p, expressions(p, "")[key])
    for a in activities:
        add("OB-M", a, expressions("", a)["OB-M"])
    return " UNION ALL ".join(parts)


LONG_COLUMNS = "(task, param, case_id, event_id, k, y_str, y_num, y_bool)"


def every_parameter(participants: list[str], activities: list[str]) -> str:
    load = [f"SELECT 'X-PaL', '{p}', case_id, event_id, k, {typed('X-PaL')} FROM pal_{p} WHERE k < n"
            for p in participants]
    loads = [x_pal(p).replace("spans AS", f"spans_{p} AS").replace("moments AS", f"moments_{p} AS")
             .replace("pal AS", f"pal_{p} AS").replace("FROM moments m", f"FROM moments_{p} m")
             .replace("JOIN spans s", f"JOIN spans_{p} s") for p in participants]
    sync = f"SELECT 'X-MSt', NULL, case_id, event_id, k, {typed('X-MSt')} FROM mst WHERE k < n"
    rows = " UNION ALL ".join([long_selects("t", participants, activities), *load, sync])
    return with_ctes(EVENTS, EV, TRACE, *loads, PAIRS, X_MST, f"long{LONG_COLUMNS} AS ({rows})",
                     query="SELECT * REPLACE (CAST(y_bool AS VARCHAR) AS y_bool) FROM long")
