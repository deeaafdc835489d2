"""SQL for ordering, pairing, relations, trace, load, discovery and file formats."""

from oracles.base import EV, EVENTS, ORDERS, PAIRS, RELATIONS, TRACE, with_ctes

MODEL = (EVENTS, EV, PAIRS, RELATIONS)

TRACE_ROWS = """
trace_rows AS (
  SELECT ci AS ci_oid, case_id, event_id, activity, epoch_us(ts) AS ts, actor, is_send, is_receive,
         CASE WHEN is_send THEN 'msg::' || event_id
              WHEN is_receive THEN 'msg::' || p.send_event END AS msg_id,
         CASE WHEN is_send OR is_receive THEN activity END AS msg_type,
         CASE WHEN is_send THEN participant ELSE s.sp END AS msg_from,
         CASE WHEN is_send THEN to_p ELSE s.st END AS msg_to
  FROM ev
  LEFT JOIN (SELECT receive_event, send_event FROM pairs) p ON p.receive_event = ev.event_id
  LEFT JOIN (SELECT event_id AS se, participant AS sp, to_p AS st FROM ev) s ON s.se = p.send_event
)"""
SHOW_TRACE = with_ctes(EVENTS, EV, PAIRS, TRACE_ROWS, query="SELECT * FROM trace_rows")

UNKNOWN_PARTIES = EVENTS.replace("src AS (", "known AS (") + """,
src AS (SELECT * REPLACE (CASE WHEN src_order % 3 <> 0 THEN from_p END AS from_p,
                          CASE WHEN src_order % 5 <> 0 THEN to_p END AS to_p) FROM known)"""

PAIR_COLUMNS = "SELECT case_id, send_event, receive_event FROM pairs"

MESSY = EVENTS.replace("src AS (", "tidy AS (") + """,
src AS (SELECT * REPLACE (
  CASE WHEN src_order % 9 <> 0 THEN ts END AS ts,
  CASE WHEN src_order % 6 = 0 THEN 'task' ELSE elem END AS elem,
  CASE WHEN src_order % 10 <> 0 THEN participant END AS participant) FROM tidy)"""

LOAD = """
spans AS (SELECT actor, case_id, min(ts) AS f, max(ts) AS l FROM ev WHERE actor <> '' GROUP BY ALL)"""

FOLLOWS = """
paths AS (SELECT r.log, r.otype, r.oid, e.event_id AS eid, e.activity,
                 lead(e.activity) OVER w AS target, lead(e.event_id) OVER w AS next_eid
          FROM (SELECT DISTINCT log, otype, oid, eid FROM e2o) r JOIN ev e ON e.event_id = r.eid
          WINDOW w AS (PARTITION BY r.log, r.otype, r.oid ORDER BY e.ts, e.event_id))"""

VIOLATIONS = """
bad AS (
  SELECT 'events' AS section, 'events[' || event_id || ']' AS path, 'absent: time' AS message
    FROM ev WHERE event_id LIKE '%3'
  UNION ALL
  SELECT 'events', 'events[' || eid || '].relationships[' ||
         (row_number() OVER (PARTITION BY eid ORDER BY oid, qualifier) - 1) || ']',
         'absent: qualifier' FROM e2o WHERE eid LIKE '%8'
  UNION ALL
  SELECT 'objects', 'objects[' || oid || '].attributes[' ||
         (row_number() OVER (PARTITION BY oid ORDER BY name) - 1) || ']', 'not text: value'
    FROM (UNPIVOT (SELECT oid, case_attr AS "caseId", name_attr AS "name", participant_attr AS "participant",
                          sender, receiver FROM objects)
          ON "caseId", "name", "participant", sender, receiver INTO NAME name VALUE value)
  UNION ALL
  SELECT 'events', 'events[' || length(event_id) || ']' || place, message FROM ev,
    (VALUES ('', 'not text: id'), ('', 'no date and time: time'), ('.attributes[0]', 'absent: name'),
            ('', 'not a list: relationships')) AS rules(place, message) WHERE event_id LIKE '%7'
  UNION ALL
  SELECT DISTINCT 'eventTypes', 'eventTypes[' || activity || '-bare]', 'absent: attributes' FROM ev
)"""


def oracles() -> dict[str, str]:
    out = {
        "source_order": with_ctes(ORDERS, EV, query="""
            SELECT case_id, event_id, CAST(idx AS BIGINT) AS idx, epoch_us(ts) AS ts FROM ev"""),
        "cut_points": with_ctes(ORDERS, EV, TRACE, query="SELECT case_id, k FROM t WHERE k < n"),
        "match_messages": with_ctes(EVENTS, EV, PAIRS, query=PAIR_COLUMNS),
        "match_messages_orders": with_ctes(ORDERS, EV, PAIRS, query=PAIR_COLUMNS),
        "match_messages_unknown_parties": with_ctes(UNKNOWN_PARTIES, EV, PAIRS, query=PAIR_COLUMNS),
        "unmatched_receives": with_ctes(EVENTS, EV, PAIRS, query="""
            SELECT case_id, event_id FROM ev WHERE is_receive
            AND event_id NOT IN (SELECT receive_event FROM pairs)"""),
        "ocel_events": with_ctes(EVENTS, EV, query="""
            SELECT event_id AS eid, activity, epoch_us(ts) AS ts, elem AS elem_type, value, props FROM ev"""),
        "ocel_objects": with_ctes(*MODEL, query="""
            SELECT oid, otype, case_attr, name_attr, participant_attr, sender, receiver FROM objects"""),
        "ocel_e2o": with_ctes(*MODEL, query="SELECT log, eid, oid, otype, qualifier FROM e2o"),
        "ocel_e2o_without_actor": with_ctes(*MODEL, query="""
            SELECT log, eid, oid, otype, qualifier FROM e2o WHERE qualifier <> 'actor'"""),
        "ocel_o2o": with_ctes(*MODEL, query="SELECT log, src_oid, tgt_oid, qualifier FROM o2o"),
        "ocel_static_attributes": with_ctes(*MODEL, query="""
            SELECT oid, otype, attribute, value, CAST(0 AS BIGINT) AS ts
            FROM (UNPIVOT (SELECT oid, otype, case_attr AS "caseId", name_attr AS "name",
                                  participant_attr AS "participant", sender, receiver FROM objects)
                  ON "caseId", "name", "participant", sender, receiver INTO NAME attribute VALUE value)"""),
        "transformation_stats": with_ctes(*MODEL, query="""
            SELECT log, 'events' AS measure, count(*) AS value FROM ev GROUP BY log
            UNION ALL SELECT log, 'messages', count(*) FROM ev WHERE is_send GROUP BY log
            UNION ALL SELECT log, 'unmatched_receives', count(*) FROM ev WHERE is_receive
              AND event_id NOT IN (SELECT receive_event FROM pairs) GROUP BY log
            UNION ALL SELECT log, 'objects.' || otype, count(*) FROM objects GROUP BY log, otype
            UNION ALL SELECT log, 'objects', count(*) FROM objects GROUP BY log
            UNION ALL SELECT log, 'e2o', count(*) FROM e2o GROUP BY log
            UNION ALL SELECT log, 'o2o', count(*) FROM o2o GROUP BY log
            UNION ALL SELECT log, 'cases', count(DISTINCT case_id) FROM ev GROUP BY log"""),
        "latest_attributes": """
            WITH v AS (SELECT 'order::' || l_orderkey AS oid, strftime(l_shipdate, '%Y-%m') AS month,
                              CASE WHEN l_linenumber % 3 <> 0 THEN l_linestatus END AS status,
                              l_returnflag AS flag, l_linenumber, l_partkey, l_suppkey, l_shipdate,
                              l_returnflag, l_linestatus FROM lineitem),
            ranked AS (
              SELECT oid, status, flag,
                row_number() OVER (PARTITION BY oid, status IS NULL ORDER BY month DESC, l_linenumber DESC,
                  l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_returnflag DESC, l_linestatus DESC) AS s,
                row_number() OVER (PARTITION BY oid ORDER BY month DESC, l_linenumber DESC,
                  l_partkey DESC, l_suppkey DESC, l_shipdate DESC, l_returnflag DESC, l_linestatus DESC) AS f
              FROM v)
            SELECT oid, max(CASE WHEN s = 1 THEN status END) AS status,
                   max(CASE WHEN f = 1 THEN flag END) AS flag FROM ranked GROUP BY oid""",
        "event_roles": with_ctes(*MODEL, query="""
            SELECT eid, max(CASE WHEN qualifier = 'within' THEN oid END) AS ci_oid,
                   max(CASE WHEN qualifier = 'local' THEN oid END) AS lc_oid,
                   max(CASE WHEN otype = 'Participant' THEN oid END) AS pa_oid,
                   max(CASE WHEN otype = 'Message' THEN oid END) AS msg_oid,
                   bool_or(qualifier = 'send') AS sends, bool_or(qualifier = 'receive') AS receives
            FROM e2o GROUP BY eid"""),
        "object_facts": with_ctes(*MODEL, query="""
            SELECT oid, otype, CASE otype WHEN 'CollaborationInstance' THEN case_attr
                     WHEN 'Participant' THEN name_attr WHEN 'LocalCase' THEN participant_attr END AS name,
                   sender AS msg_from, receiver AS msg_to FROM objects"""),
        "participant_spans": with_ctes(ORDERS, EV, query="""
            SELECT actor, case_id, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts
            FROM ev GROUP BY actor, case_id"""),
        "participant_load": with_ctes(EVENTS, EV, LOAD, query="""
            SELECT e.event_id, e.actor, count(s.case_id) AS load FROM ev e
            LEFT JOIN spans s ON s.actor = e.actor AND s.case_id <> e.case_id
                 AND s.f <= e.ts AND e.ts <= s.l GROUP BY ALL"""),
        "object_types": with_ctes(*MODEL, query="SELECT DISTINCT log, otype FROM objects"),
        "event_types": with_ctes(EVENTS, EV, query="SELECT DISTINCT log, activity FROM ev"),
        "activities_per_type": with_ctes(*MODEL, query="""
            SELECT DISTINCT e2o.log, otype, activity FROM e2o JOIN ev ON ev.event_id = e2o.eid"""),
        "directly_follows": with_ctes(*MODEL, FOLLOWS, query="""
            SELECT log, otype, activity AS source, target, count(DISTINCT (eid, next_eid)) AS event_couples,
                   count(DISTINCT oid) AS unique_objects, count(*) AS total_objects
            FROM paths WHERE target IS NOT NULL GROUP BY log, otype, activity, target"""),
        "parameter_domain": with_ctes(ORDERS, EV, query="""
            SELECT DISTINCT log, 'participant' AS kind, actor AS param FROM ev
            UNION ALL SELECT DISTINCT log, 'activity', activity FROM ev WHERE is_send"""),
        "flat_frame": with_ctes(MESSY, query="""
            SELECT log, case_id, src_order, activity,
                   strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS ts,
                   CASE WHEN ts IS NULL THEN 'unknown' END AS unread_ts, elem, participant,
                   from_p AS from_participant, to_p AS to_participant, props, 1 AS attributes FROM src"""),
        "unreadable_times": with_ctes(MESSY, query="""
            SELECT count(*) AS unreadable FROM src WHERE ts IS NULL"""),
        "event_log_registry": with_ctes(EVENTS, query="""
            SELECT w.log, coalesce(events, 0) AS events, coalesce(cases, 0) AS cases, coalesce(events, 0) AS positions,
                   w.log IN ('part2', 'gone') AS failed
            FROM (SELECT unnest(['part0', 'part1', 'part2', 'gone']) AS log) w
            LEFT JOIN (SELECT 'part' || (src_order % 3) AS log, count(*) AS events, count(DISTINCT case_id) AS cases
                       FROM src WHERE src_order % 3 <> 2 GROUP BY ALL) USING (log)"""),
        "event_log_xml": with_ctes(EVENTS, EV, PAIRS, query="""
            SELECT ev.log, ev.case_id, event_id, activity, epoch_us(ts) AS ts, elem, participant,
                   from_p AS from_participant, to_p AS to_participant, props,
                   CASE WHEN is_send THEN event_id ELSE p.send_event END AS send_event
            FROM ev LEFT JOIN pairs p ON p.receive_event = ev.event_id"""),
        "json_violations": with_ctes(*MODEL, VIOLATIONS, query="SELECT * FROM bad"),
    }
    for name in ("trace_of_relations", "trace_of_source", "relational_tables", "flat_ocel_frames",
                 "change_tables", "json_documents"):
        out[name] = SHOW_TRACE
    return out
