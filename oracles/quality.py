"""SQL for consistency checks and label comparison."""

from oracles.base import EV, EVENTS, PAIRS, RELATIONS, TRACE, with_ctes
from oracles.labels import LONG_COLUMNS, SOURCE_TRACE, X_MST, long_selects, x_pal

EVENT_TIMES = "times AS (SELECT log, event_id AS eid, ts FROM ev)"

DAMAGE = """
times AS (SELECT log, event_id AS eid,
                 CASE WHEN activity = 'signup' THEN ts - INTERVAL 30 DAY ELSE ts END AS ts FROM ev),
objects_d AS (SELECT * FROM objects WHERE oid <> 'part::P2'),
e2o_d AS (SELECT * FROM e2o WHERE NOT (qualifier = 'send' AND eid LIKE '%7')),
o2o_d AS (SELECT * FROM o2o WHERE NOT (qualifier = 'executed_by' AND tgt_oid = 'part::P1'))"""


def measures(objects: str, e2o: str, o2o: str) -> str:
    """Measures of the five checks as rows (log, check, measure, value)."""
    related = (f"(SELECT oid FROM {e2o} UNION SELECT src_oid FROM {o2o} UNION SELECT tgt_oid FROM {o2o})")

    def one(check: str, measure: str, value: str) -> str:
        return f"SELECT 'events' AS log, '{check}' AS \"check\", '{measure}' AS measure, " \
               f"CAST(({value}) AS BIGINT) AS value"

    p11, p12, p13 = "every event is mapped", "one instance per case", "messages have both ends"
    p14, p15 = "local cases fit together", "objects are related"
    within = f"(SELECT oid, count(DISTINCT eid) AS c FROM {e2o} WHERE qualifier = 'within' GROUP BY oid)"
    messages = f"(SELECT * FROM {objects} WHERE otype = 'Message')"

    def edges(qualifier: str) -> str:
        return f"(SELECT oid, count(*) AS c FROM {e2o} WHERE qualifier = '{qualifier}' " \
               "AND otype = 'Message' GROUP BY oid)"

    def party(qualifier: str, attr: str) -> str:
        return (f"SELECT count(*) FROM {messages} m JOIN {o2o} o ON o.src_oid = m.oid "
                f"AND o.qualifier = '{qualifier}' WHERE 'part::' || m.{attr} <> o.tgt_oid")

    executors = (f"(SELECT l.oid, l.participant_attr, count(x.tgt_oid) AS c, max(x.tgt_oid) AS t "
                 f"FROM {objects} l LEFT JOIN {o2o} x ON x.src_oid = l.oid "
                 f"AND x.qualifier = 'executed_by' WHERE l.otype = 'LocalCase' GROUP BY ALL)")
    rows = [
        one(p11, "source_events", "SELECT count(*) FROM src"),
        one(p11, "ocel_events", "SELECT count(*) FROM times"),
        one(p11, "source_timestamps", "SELECT count(ts) FROM src"),
        one(p11, "ocel_timestamps", "SELECT count(ts) FROM times"),
        one(p11, "event_difference", "SELECT abs((SELECT count(*) FROM src) - count(*)) FROM times"),
        one(p11, "timestamp_difference",
            "SELECT abs((SELECT count(ts) FROM src) - count(ts)) FROM times"),
        one(p12, "instances", f"SELECT count(*) FROM {objects} WHERE otype = 'CollaborationInstance'"),
        one(p12, "count_mismatches",
            f"SELECT count(*) FROM (SELECT 'ci::' || case_id AS oid, count(*) AS n FROM src GROUP BY 1) s "
            f"LEFT JOIN {within} w USING (oid) WHERE coalesce(w.c, 0) <> s.n"),
        one(p12, "dangling_within", f"SELECT count(*) FROM {within} WHERE oid NOT IN "
                                    f"(SELECT oid FROM {objects} WHERE otype = 'CollaborationInstance')"),
        one(p13, "messages", f"SELECT count(*) FROM {messages}"),
        one(p13, "not_one_send", f"SELECT count(*) FROM {messages} m LEFT JOIN {edges('send')} e "
                                 "USING (oid) WHERE coalesce(e.c, 0) <> 1"),
        one(p13, "several_receives", f"SELECT count(*) FROM {messages} m JOIN {edges('receive')} e "
                                     "USING (oid) WHERE e.c > 1"),
        one(p13, "party_disagreements", f"({party('from', 'sender')}) + ({party('to', 'receiver')})"),
        one(p13, "receive_before_send",
            f"SELECT count(*) FROM {e2o} r JOIN {e2o} s ON s.oid = r.oid AND s.qualifier = 'send' "
            "JOIN times tr ON tr.eid = r.eid JOIN times ts ON ts.eid = s.eid "
            "WHERE r.qualifier = 'receive' AND tr.ts < ts.ts"),
        one(p14, "local_cases", f"SELECT count(*) FROM {objects} WHERE otype = 'LocalCase'"),
        one(p14, "local_within_mismatches",
            f"SELECT count(*) FROM {e2o} l LEFT JOIN {e2o} w ON w.eid = l.eid AND w.qualifier = 'within' "
            f"LEFT JOIN {o2o} p ON p.src_oid = l.oid AND p.qualifier = 'part_of' "
            "WHERE l.qualifier = 'local' AND p.tgt_oid IS DISTINCT FROM w.oid"),
        one(p14, "not_one_executor", f"SELECT count(*) FROM {executors} WHERE c <> 1"),
        one(p14, "name_disagreements",
            f"SELECT count(*) FROM {executors} x JOIN {objects} o ON o.oid = x.t "
            "WHERE x.c = 1 AND o.name_attr <> x.participant_attr"),
        one(p15, "objects", f"SELECT count(*) FROM {objects}"),
        one(p15, "orphans", f"SELECT count(*) FROM {objects} WHERE oid NOT IN {related}"),
    ]
    return " UNION ALL ".join(rows)


BASE = (EVENTS, EV, PAIRS, RELATIONS)
DAMAGED = measures("objects_d", "e2o_d", "o2o_d")

REPORT = f"""
m AS ({DAMAGED}),
checks AS (SELECT log, "check", CAST(sum(CASE WHEN measure IN ('source_events', 'ocel_events',
             'source_timestamps', 'ocel_timestamps', 'instances', 'messages', 'local_cases', 'objects')
             THEN 0 ELSE value END) AS BIGINT) AS violations FROM m GROUP BY log, "check"),
every AS (SELECT * FROM checks
          UNION ALL SELECT log, 'overall', CAST(sum(violations) AS BIGINT) FROM checks GROUP BY log)"""

DISTURBED = EVENTS.replace("src AS (", "calm AS (") + """,
src AS (SELECT * REPLACE (
  CASE WHEN src_order % 7 = 0 THEN ts + INTERVAL 2 SECOND ELSE ts END AS ts,
  CASE WHEN src_order % 11 = 0 THEN 'other' ELSE activity END AS activity,
  CASE WHEN src_order % 13 <> 0 THEN participant END AS participant)
  FROM calm WHERE src_order % 97 <> 0)"""


def two_sides(other: str) -> tuple[str, ...]:
    """Traces t_ref (the source) and t_obj (`other`)."""
    ref = [EVENTS.strip().replace("src AS (", "src_ref AS (", 1),
           EV.strip().replace("ev AS (", "ev_ref AS (", 1).replace("FROM src ", "FROM src_ref "),
           SOURCE_TRACE.strip().replace("t AS (", "t_ref AS (", 1).replace("FROM ev", "FROM ev_ref")]
    obj = [other, EV, TRACE.strip().replace("t AS (", "t_obj AS (", 1)]
    return (*ref, *obj)


def equivalence(other: str, activities: list[str], digits: int | None = None) -> str:
    people = ["P0", "P1", "P2", "P3"]
    agreement = "CASE WHEN n > 0 THEN CAST(matches AS DOUBLE) / n END"
    agreement = agreement if digits is None else f"round({agreement}, {digits})"
    return with_ctes(
        *two_sides(other),
        f"ref{LONG_COLUMNS} AS ({long_selects('t_ref', people, activities, True)})",
        f"obj{LONG_COLUMNS} AS ({long_selects('t_obj', people, activities)})",
        """both_ AS (
          SELECT task, param, a.k IS NOT NULL AS in_a, b.k IS NOT NULL AS in_b,
                 CASE WHEN left(task, 2) = 'NV' THEN coalesce(abs(a.y_num - b.y_num) <= 1.0,
                           a.y_num IS NULL AND b.y_num IS NULL)
                      WHEN left(task, 2) = 'OB' THEN a.y_bool IS NOT DISTINCT FROM b.y_bool
                      ELSE a.y_str IS NOT DISTINCT FROM b.y_str END AS same
          FROM (SELECT * REPLACE (coalesce(param, '') AS param) FROM ref) a
          FULL JOIN (SELECT * REPLACE (coalesce(param, '') AS param) FROM obj) b
               USING (task, param, case_id, k))""",
        """counted AS (
          SELECT task, param, count(CASE WHEN in_a AND in_b THEN 1 END) AS n,
                 count(CASE WHEN in_a AND in_b AND same THEN 1 END) AS matches,
                 count(CASE WHEN NOT in_b THEN 1 END) AS a_only,
                 count(CASE WHEN NOT in_a THEN 1 END) AS b_only FROM both_ GROUP BY task, param)""",
        query=f"""SELECT 'events' AS log, task, param, n AS eval_labels, matches, n - matches AS mismatches,
                  a_only AS only_in_reference, b_only AS only_in_object_centric,
                  {agreement} AS agreement FROM counted""")


def examples() -> str:
    sides = [f"{side}{LONG_COLUMNS} AS ({long_selects('t_' + side, ['P1'], ['purchase'], side == 'ref')})"
             for side in ("ref", "obj")]
    return with_ctes(
        *two_sides(DISTURBED), *sides,
        """differing AS (
          SELECT task, coalesce(a.param, '') AS param, case_id, a.k, a.y_str AS ref_str, a.y_num AS ref_num,
                 b.y_str AS obj_str, b.y_num AS obj_num, CAST(a.y_bool AS VARCHAR) AS ref_bool,
                 CAST(b.y_bool AS VARCHAR) AS obj_bool
          FROM ref a JOIN obj b USING (task, case_id, k) WHERE a.param IS NOT DISTINCT FROM b.param
          AND NOT CASE WHEN left(task, 2) = 'NV' THEN coalesce(abs(a.y_num - b.y_num) <= 1.0,
                            a.y_num IS NULL AND b.y_num IS NULL)
                       WHEN left(task, 2) = 'OB' THEN a.y_bool IS NOT DISTINCT FROM b.y_bool
                       ELSE a.y_str IS NOT DISTINCT FROM b.y_str END)""",
        query="""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task, param ORDER BY case_id, k) AS nth
                 FROM differing) WHERE nth <= 5""")


def consistency() -> str:
    people = ["P0", "P1", "P2", "P3"]
    loads = [x_pal(p).replace("spans AS", f"spans_{p} AS").replace("moments AS", f"moments_{p} AS")
             .replace("pal AS", f"pal_{p} AS").replace("FROM moments m", f"FROM moments_{p} m")
             .replace("JOIN spans s", f"JOIN spans_{p} s") for p in people]
    rows = " UNION ALL ".join(
        [f"SELECT 'X-PaL' AS task, '{p}' AS param, y, y < 0 OR y <> floor(y) AS ill FROM pal_{p} WHERE k < n"
         for p in people] + ["SELECT 'X-MSt', '', y, y < 0 FROM mst WHERE k < n"])
    return with_ctes(EVENTS, EV, TRACE, *loads, PAIRS, X_MST, f"rows_ AS ({rows})", query="""
        SELECT 'events' AS log, task, param, count(*) AS eval_labels, count(y) AS defined,
               count(CASE WHEN ill THEN 1 END) AS ill_defined, count(*) - count(y) AS bottom,
               count(CASE WHEN ill THEN 1 END) = 0 AS well_defined FROM rows_ GROUP BY task, param""")


def oracles() -> dict[str, str]:
    return {
        "check_measures": with_ctes(*BASE, EVENT_TIMES, query=measures("objects", "e2o", "o2o")),
        "check_measures_damaged": with_ctes(*BASE, DAMAGE, query=DAMAGED),
        "check_report": with_ctes(*BASE, DAMAGE, REPORT, query="""
            SELECT log, "check", violations, violations = 0 AS passed FROM every"""),
        "orphan_objects": with_ctes(*BASE, query="""
            SELECT log, oid, otype FROM objects WHERE oid NOT IN (
              SELECT oid FROM e2o WHERE NOT (qualifier = 'send' AND eid LIKE '%7')
              UNION SELECT src_oid FROM o2o WHERE src_oid NOT LIKE 'msg::%'
              UNION SELECT tgt_oid FROM o2o WHERE src_oid NOT LIKE 'msg::%')"""),
        "fidelity_equivalence": equivalence(EVENTS, ["purchase"]),
        "fidelity_disturbed": equivalence(DISTURBED, ["other", "purchase"], 9),
        "mismatch_examples": examples(),
        "fidelity_consistency": consistency(),
        "result_csv": f"SELECT * REPLACE (nullif(param, '') AS param) FROM ({consistency()})",
    }
