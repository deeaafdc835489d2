"""Common table expressions: source events, trace, message pairs, relations."""

EVENTS = """
src AS (
  SELECT 'events' AS log,
         CAST(user_id AS VARCHAR) || '-' || strftime(date_trunc('week', ts), '%Y%m%d') AS case_id,
         event_id AS src_order, event_type AS activity, ts,
         CASE event_type WHEN 'purchase' THEN 'SendTask' WHEN 'signup' THEN 'ReceiveTask'
              ELSE 'task' END AS elem,
         'P' || (k % 4) AS participant,
         CASE WHEN event_type = 'signup' THEN 'P' || ((k + 3) % 4) END AS from_p,
         CASE WHEN event_type = 'purchase' THEN 'P' || ((k + 1) % 4) END AS to_p,
         value, props
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
)"""

ORDERS = """
src AS (
  SELECT 'orders' AS log, CAST(l_orderkey AS VARCHAR) AS case_id,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) - 1 AS src_order,
         l_returnflag AS activity, l_shipdate AS ts,
         CASE l_linestatus WHEN 'O' THEN 'SendTask' WHEN 'F' THEN 'ReceiveTask' ELSE 'task' END AS elem,
         'S' || (l_suppkey % 5) AS participant,
         CASE WHEN l_linestatus = 'F' THEN 'S' || ((l_suppkey + 4) % 5) END AS from_p,
         CASE WHEN l_linestatus = 'O' THEN 'S' || ((l_suppkey + 1) % 5) END AS to_p
  FROM lineitem
)"""

# Positions in the case, minted ids.
EV = """
ev AS (
  SELECT *, 'e::' || case_id || '::' || idx AS event_id, 'ci::' || case_id AS ci,
         elem = 'SendTask' AS is_send, elem = 'ReceiveTask' AS is_receive,
         coalesce(participant, '') AS actor
  FROM (SELECT *, row_number() OVER (PARTITION BY log, case_id ORDER BY ts NULLS LAST, src_order) - 1
                  AS idx
        FROM src WHERE case_id IS NOT NULL)
)"""

TRACE = """
t AS (
  SELECT *, row_number() OVER (PARTITION BY log, case_id ORDER BY ts, event_id) AS k,
         count(*) OVER (PARTITION BY log, case_id) AS n
  FROM ev
)"""

# The general pairing rule, one send after the other, used receives remembered in a list.
PAIRS = """
sends AS (
  SELECT log, case_id, idx, ts, participant, to_p,
         row_number() OVER (PARTITION BY log, case_id ORDER BY idx) AS no
  FROM ev WHERE is_send
),
receives AS (
  SELECT log, case_id,
         list({'idx': idx, 'ts': ts, 'f': from_p, 't': to_p} ORDER BY ts NULLS LAST, idx) AS rs
  FROM ev WHERE is_receive GROUP BY log, case_id
),
walk AS (
  SELECT log, case_id, 0 AS no, CAST(NULL AS BIGINT) AS send_idx, CAST(NULL AS BIGINT) AS recv_idx,
         CAST([] AS BIGINT[]) AS used
  FROM receives
  UNION ALL
  SELECT log, case_id, no, send_idx, pick,
         CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
  FROM (
    SELECT w.log, w.case_id, s.no, s.idx AS send_idx, w.used,
           list_filter(r.rs, lambda x: NOT list_contains(w.used, x.idx)
             AND CASE WHEN x.ts IS NOT NULL AND s.ts IS NOT NULL THEN x.ts >= s.ts
                      ELSE x.idx >= s.idx END
             AND (x.f IS NULL OR s.participant IS NULL OR x.f = s.participant)
             AND (x.t IS NULL OR s.to_p IS NULL OR x.t = s.to_p))[1].idx AS pick
    FROM walk w
    JOIN sends s ON s.log = w.log AND s.case_id = w.case_id AND s.no = w.no + 1
    JOIN receives r ON r.log = w.log AND r.case_id = w.case_id
  )
),
pairs AS (
  SELECT log, case_id, send_idx, recv_idx,
         'e::' || case_id || '::' || send_idx AS send_event,
         'e::' || case_id || '::' || recv_idx AS receive_event
  FROM walk WHERE recv_idx IS NOT NULL
)"""

# Object-centric relations, from events and pairs.
RELATIONS = """
objects AS (
  SELECT DISTINCT log, oid, otype, case_attr, name_attr, participant_attr, sender, receiver FROM (
    SELECT log, ci AS oid, 'CollaborationInstance' AS otype, case_id AS case_attr,
           NULL AS name_attr, NULL AS participant_attr, NULL AS sender, NULL AS receiver FROM ev
    UNION ALL SELECT log, 'part::' || p, 'Participant', NULL, p, NULL, NULL, NULL
      FROM (SELECT log, participant AS p FROM ev UNION SELECT log, from_p FROM ev
            UNION SELECT log, to_p FROM ev) WHERE p IS NOT NULL
    UNION ALL SELECT log, 'lc::' || case_id || '::' || participant, 'LocalCase', case_id, NULL,
      participant, NULL, NULL FROM ev WHERE participant IS NOT NULL
    UNION ALL SELECT log, 'msg::' || event_id, 'Message', NULL, NULL, NULL, participant, to_p
      FROM ev WHERE is_send)
),
e2o AS (
  SELECT log, event_id AS eid, ci AS oid, 'CollaborationInstance' AS otype, 'within' AS qualifier FROM ev
  UNION ALL SELECT log, event_id, 'lc::' || case_id || '::' || participant, 'LocalCase', 'local'
    FROM ev WHERE participant IS NOT NULL
  UNION ALL SELECT log, event_id, 'part::' || participant, 'Participant', 'actor'
    FROM ev WHERE participant IS NOT NULL
  UNION ALL SELECT log, event_id, 'msg::' || event_id, 'Message', 'send' FROM ev WHERE is_send
  UNION ALL SELECT log, receive_event, 'msg::' || send_event, 'Message', 'receive' FROM pairs
),
o2o AS (
  SELECT log, 'msg::' || event_id AS src_oid, 'part::' || participant AS tgt_oid, 'from' AS qualifier
    FROM ev WHERE is_send AND participant IS NOT NULL
  UNION ALL SELECT log, 'msg::' || event_id, 'part::' || to_p, 'to' FROM ev
    WHERE is_send AND to_p IS NOT NULL
  UNION ALL SELECT log, 'msg::' || event_id, ci, 'exchanged_in' FROM ev WHERE is_send
  UNION ALL SELECT DISTINCT log, 'lc::' || case_id || '::' || participant, ci, 'part_of'
    FROM ev WHERE participant IS NOT NULL
  UNION ALL SELECT DISTINCT log, 'lc::' || case_id || '::' || participant, 'part::' || participant,
    'executed_by' FROM ev WHERE participant IS NOT NULL
)"""


def with_ctes(*ctes: str, query: str) -> str:
    return f"WITH RECURSIVE {', '.join(c.strip() for c in ctes)}\n{query.strip()}"
