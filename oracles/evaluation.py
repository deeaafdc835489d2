"""SQL for features, folds, baselines and scores."""

from oracles.base import EV, EVENTS, ORDERS, PAIRS, TRACE, with_ctes
from oracles.labels import expressions, typed
from oracles.quality import DISTURBED

PAST = "(PARTITION BY log, case_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SECONDS = "(epoch_us({b}) - epoch_us({a})) / 1e6"
CASE_END = "max(ts) OVER (PARTITION BY log, case_id)"
CASE_START = "min(ts) OVER (PARTITION BY log, case_id)"

MESSAGES = """
with_message AS (
  SELECT ev.*, CASE WHEN is_send THEN event_id ELSE p.send_event END AS message
  FROM ev LEFT JOIN (SELECT send_event, receive_event FROM pairs) p ON p.receive_event = ev.event_id)"""

BASIC = f"""
  {SECONDS.format(a='ts', b=CASE_END)} AS remaining, {SECONDS.format(a=CASE_START, b='ts')} AS elapsed,
  CAST(count(DISTINCT nullif(actor, '')) OVER {PAST} AS DOUBLE) AS previous_participants,
  CAST(count(DISTINCT message) OVER {PAST} AS DOUBLE) AS previous_messages"""

ACTIVITIES = ["click", "error", "purchase", "signup", "view"]
COUNTS = ", ".join(f"CAST(count(CASE WHEN activity = '{a}' THEN 1 END) OVER {PAST} AS DOUBLE) AS before_{a}"
                   for a in ACTIVITIES)
DIRECT = ", ".join(
    f"CASE WHEN lag(activity) OVER (PARTITION BY log, case_id ORDER BY ts, event_id) = '{a}' "
    f"THEN 1.0 ELSE 0.0 END AS right_before_{a}" for a in ACTIVITIES)

FIRST_SEEN = """
starts AS (SELECT *, min(src_order) OVER (PARTITION BY log, case_id) AS start FROM ev),
seen AS (SELECT log, 'participant' AS kind, actor AS param, start, ts, event_id FROM starts WHERE actor <> ''
         UNION ALL SELECT log, 'activity', activity, start, ts, event_id FROM starts WHERE is_send),
counted AS (SELECT log, kind, param, count(*) AS events, min((start, ts, event_id)) AS first
            FROM seen GROUP BY log, kind, param),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log, kind
                                ORDER BY events DESC, first) AS nth FROM counted) WHERE nth = 1)"""


def _dealt(rows: str, by: str) -> str:
    """Every case in turn, largest first, goes to the fold that has the fewest rows so far."""
    return f"""(
      WITH RECURSIVE sized AS MATERIALIZED (
        SELECT *, least(5, count(*) OVER (PARTITION BY {by})) AS folds,
               row_number() OVER (PARTITION BY {by} ORDER BY "rows" DESC, case_id) AS nth
        FROM (SELECT {by}, case_id, count(*) AS "rows" FROM {rows} GROUP BY {by}, case_id)),
      walk AS (
        SELECT {by}, CAST(0 AS BIGINT) AS nth, list_transform(range(folds), lambda x: CAST(0 AS BIGINT)) AS loads,
               CAST(NULL AS BIGINT) AS fold FROM (SELECT DISTINCT {by}, folds FROM sized)
        UNION ALL
        SELECT s.{by}, s.nth, list_transform(w.loads, lambda x, i: CASE WHEN i = w.lightest THEN x + s."rows" ELSE x END),
               w.lightest - 1
        FROM (SELECT *, list_position(loads, list_min(loads)) AS lightest FROM walk) w
        JOIN sized s ON s.{by} = w.{by} AND s.nth = w.nth + 1)
      SELECT s.{by}, s.case_id, s."rows", s.folds, CASE WHEN s.folds >= 2 THEN w.fold END AS fold
      FROM sized s JOIN walk w ON w.{by} = s.{by} AND w.nth = s.nth)"""


REPRESENTATIVE = ("NE-NPaA", "NE-NMPr", "NV-PrT", "NV-PaT", "NV-NMPr", "OB-M")


def _labelled(tasks: tuple[str, ...] = REPRESENTATIVE) -> str:
    """Defined labels of the tasks with the most frequent parameters."""
    given = {"participant": "(SELECT param FROM best WHERE kind = 'participant')",
             "activity": "(SELECT param FROM best WHERE kind = 'activity')"}
    sql = expressions("\x00p", "\x00a")
    parts = []
    for key in tasks:
        y = sql[key].replace("'\x00p'", "p_star").replace("'\x00a'", "a_hat")
        parts.append(f"SELECT '{key}' AS task, case_id, event_id, k, {typed(key)} "
                     f"FROM (SELECT *, {y} AS y FROM asked) WHERE k < n AND y IS NOT NULL")
    return f"""
asked AS (SELECT t.*, {given['participant']} AS p_star, {given['activity']} AS a_hat FROM t),
defined(task, case_id, event_id, k, y_str, y_num, y_bool) AS ({' UNION ALL '.join(parts)}),
dealt AS {_dealt('defined', 'task')},
labelled AS (SELECT d.*, x.fold FROM defined d JOIN dealt x USING (task, case_id))"""


LABELLED = (EVENTS, EV, TRACE, FIRST_SEEN, _labelled())

MEDIANS = """
medians AS (SELECT task, f.fold, median(y_num) AS median
            FROM labelled l JOIN (SELECT unnest(range(5)) AS fold) f ON f.fold <> l.fold
            WHERE y_num IS NOT NULL GROUP BY task, f.fold)"""
MEDIAN_SCORES = """
mae AS (SELECT l.task, l.fold, count(*) AS "rows", avg(abs(y_num - median)) AS score
        FROM labelled l JOIN medians m ON m.task = l.task AND m.fold = l.fold
        WHERE y_num IS NOT NULL GROUP BY l.task, l.fold)"""
MAJORITY = """
classes AS (SELECT task, fold, coalesce(y_str, CASE WHEN y_bool THEN 'True'
                                                     WHEN NOT y_bool THEN 'False' END) AS y
            FROM labelled WHERE y_num IS NULL),
trained AS (SELECT task, f.fold, y, count(*) AS n
            FROM classes c JOIN (SELECT unnest(range(5)) AS fold) f ON f.fold <> c.fold
            GROUP BY task, f.fold, y),
majority AS (SELECT task, fold, first(y ORDER BY n DESC, y) AS majority FROM trained GROUP BY task, fold),
tested AS (SELECT c.task, c.fold, c.y, m.majority AS prediction FROM classes c
           JOIN majority m USING (task, fold)),
per_label AS (
  SELECT x.task, x.fold, x.label,
         count(CASE WHEN y = x.label AND prediction = x.label THEN 1 END) AS tp,
         count(CASE WHEN prediction = x.label THEN 1 END) AS predicted,
         count(CASE WHEN y = x.label THEN 1 END) AS actual
  FROM (SELECT task, fold, y AS label FROM tested UNION SELECT task, fold, prediction FROM tested) x
  JOIN tested t ON t.task = x.task AND t.fold = x.fold GROUP BY ALL),
f1 AS (SELECT task, fold, avg(2.0 * tp / (actual + predicted)) AS score,
              CAST(sum(actual) AS BIGINT) AS "rows" FROM per_label GROUP BY task, fold)"""



def _constants(tasks: tuple[str, ...]) -> str:
    """Result rows of the constant predictors."""
    sql = expressions("\x00p", "\x00a")
    asks = lambda mark: ", ".join(f"'{k}'" for k in tasks if mark in sql[k]) or "NULL"
    return with_ctes(EVENTS, EV, TRACE, FIRST_SEEN, _labelled(tasks), MEDIANS, MEDIAN_SCORES, MAJORITY, query=f"""
        SELECT w.task, coalesce(s.samples, 0) AS samples, s.samples IS NOT NULL AS ran_end_to_end,
               CASE WHEN folds IS NULL THEN NULL WHEN w.task LIKE 'NV-%' THEN 'mae' ELSE 'f1_macro' END AS metric_name,
               round(mean, 6) AS metric_mean, round(sd, 6) AS metric_sd, round(mean, 6) AS baseline_mean, folds,
               CASE WHEN w.task IN ({asks(chr(0) + 'p')}) THEN (SELECT param FROM best WHERE kind = 'participant') END AS participant,
               CASE WHEN w.task IN ({asks(chr(0) + 'a')}) THEN (SELECT param FROM best WHERE kind = 'activity') END AS obm_activity,
               CASE WHEN s.samples IS NULL THEN 'no labelled rows' END AS note
        FROM (SELECT unnest({list(tasks)}) AS task) w
        LEFT JOIN (SELECT task, count(*) AS samples FROM labelled GROUP BY task) s USING (task)
        LEFT JOIN (SELECT task, avg(score) AS mean, stddev_pop(score) AS sd, CAST(count(*) AS INTEGER) AS folds
                   FROM (SELECT task, fold, score FROM mae UNION ALL SELECT task, fold, score FROM f1)
                   GROUP BY task) USING (task)""")


# Normal equations with a unit diagonal, solved by elimination; the last column is the right side.
def _normal(features: list[str]) -> str:
    n = len(features) + 1
    return f"""
sights AS (SELECT event_id, {BASIC}, {COUNTS} FROM with_message),
xy AS (SELECT l.task, l.fold, l.y_num AS y,
              [1.0::DOUBLE, {", ".join(f"coalesce({c}, 0)" for c in features)}] AS x
       FROM labelled l JOIN sights USING (event_id) WHERE y_num IS NOT NULL),
sums AS (SELECT task, fold, i, j, sum(x[i] * CASE WHEN j > len(x) THEN y ELSE x[j] END) AS s
         FROM xy, (SELECT unnest(range(1, {n + 1})) AS i), (SELECT unnest(range(1, {n + 2})) AS j) GROUP BY ALL),
train AS (SELECT s.task, f.fold, i, j, sum(s) AS s FROM sums s JOIN (SELECT DISTINCT task, fold FROM sums) f
          ON f.task = s.task AND f.fold <> s.fold GROUP BY ALL),
unit AS (SELECT task, fold, i, sqrt(s) AS d FROM train WHERE i = j),
scaled AS (SELECT t.task, t.fold, t.i, list(s / a.d / coalesce(b.d, 1) ORDER BY t.j) AS line, any_value(a.d) AS d
           FROM train t JOIN unit a ON a.task = t.task AND a.fold = t.fold AND a.i = t.i
           LEFT JOIN unit b ON b.task = t.task AND b.fold = t.fold AND b.i = t.j
           GROUP BY t.task, t.fold, t.i),
solved AS (
  SELECT task, fold, 0 AS k, list(line ORDER BY i) AS m, list(d ORDER BY i) AS d, min(d) AS lowest FROM scaled GROUP BY task, fold
  UNION ALL
  SELECT task, fold, k + 1, list_transform(m, lambda line, i: CASE WHEN i = k + 1 THEN list_transform(line, lambda v: v / m[k + 1][k + 1])
           ELSE list_transform(line, lambda v, j: v - line[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END), d,
         least(lowest, m[k + 1][k + 1])
  FROM solved WHERE k < {n}),
fits AS (SELECT task, fold, list_transform(m, lambda line, i: line[{n + 1}] / d[i]) AS b FROM solved WHERE k = {n} AND lowest > 1e-9),
linear AS (SELECT xy.task, xy.fold, avg(abs(y - list_dot_product(x, b))) AS score
           FROM xy JOIN fits ON fits.task = xy.task AND fits.fold = xy.fold GROUP BY ALL)"""


FEATURES = ["elapsed", "previous_participants", "previous_messages", *("before_" + a for a in ACTIVITIES)]


def _least_squares(features: list[str]) -> str:
    tasks = tuple(k for k in expressions("", "") if k.startswith("NV-"))
    sql = expressions("\x00p", "\x00a")
    asks = ", ".join(f"'{k}'" for k in tasks if "\x00p" in sql[k]) or "NULL"
    activities = ", ".join(f"'{k}'" for k in tasks if "\x00a" in sql[k]) or "NULL"
    return with_ctes(EVENTS, EV, PAIRS, MESSAGES, TRACE, FIRST_SEEN, _labelled(tasks), MEDIANS, MEDIAN_SCORES, _normal(features), query=f"""
        SELECT w.task, coalesce(s.samples, 0) AS samples, s.samples IS NOT NULL AS ran_end_to_end,
               CASE WHEN folds IS NOT NULL THEN 'mae' END AS metric_name,
               round(mean, 3) AS metric_mean, round(sd, 3) AS metric_sd, round(median_mean, 3) AS baseline_mean, folds,
               CASE WHEN w.task IN ({asks}) THEN (SELECT param FROM best WHERE kind = 'participant') END AS participant,
               CASE WHEN w.task IN ({activities}) THEN (SELECT param FROM best WHERE kind = 'activity') END AS obm_activity,
               CASE WHEN s.samples IS NULL THEN 'no labelled rows' WHEN folds IS NULL THEN 'every fit is singular' END AS note
        FROM (SELECT unnest({list(tasks)}) AS task) w
        LEFT JOIN (SELECT task, count(*) AS samples FROM labelled GROUP BY task) s USING (task)
        LEFT JOIN (SELECT l.task, avg(l.score) AS mean, stddev_pop(l.score) AS sd, avg(mae.score) AS median_mean,
                          CAST(count(*) AS INTEGER) AS folds
                   FROM linear l JOIN mae ON mae.task = l.task AND mae.fold = l.fold GROUP BY l.task) USING (task)""")


REPEATED = """
pred AS (SELECT actor, lead(activity) OVER w AS y, activity AS prediction,
                (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS seconds, length(event_id) * 1000.0 AS guess
         FROM t WINDOW w AS (PARTITION BY log, case_id ORDER BY ts, event_id)),
cut AS (SELECT * FROM pred WHERE y IS NOT NULL)"""


def oracles() -> dict[str, str]:
    features = (EVENTS, EV, PAIRS, MESSAGES)
    return {
        "cv_baselines": _constants(REPRESENTATIVE),
        "cv_baselines_full_catalog": _constants(tuple(k for k in expressions("", "") if not k.startswith("X-"))),
        "cv_linear": _least_squares(FEATURES),
        # Sends so far and messages so far are the same.
        "cv_linear_independent": _least_squares([f for f in FEATURES if f != "previous_messages"]),
        "feature_table": with_ctes(*features, query=f"""
            SELECT case_id, event_id, {BASIC}, {COUNTS} FROM with_message"""),
        "feature_table_direct": with_ctes(EVENTS, EV, query=f"SELECT event_id, {DIRECT} FROM ev"),
        "past_features": with_ctes(ORDERS, EV, PAIRS, MESSAGES, query=f"""
            SELECT event_id, {BASIC} FROM with_message"""),
        "feature_vectors": with_ctes(
            ORDERS, EV, PAIRS, MESSAGES,
            "places AS (SELECT activity, row_number() OVER (ORDER BY activity) + 2 AS place "
            "FROM (SELECT DISTINCT activity FROM with_message WHERE activity IS NOT NULL))",
            "ranked AS (SELECT *, row_number() OVER (PARTITION BY log, case_id ORDER BY ts, event_id) AS k "
            "FROM with_message LEFT JOIN places USING (activity))",
            """counted AS (
              SELECT event_id, string_agg(place || ':' || n, ' ' ORDER BY place) AS activities
              FROM (SELECT a.event_id, b.place, count(*) AS n FROM ranked a
                    JOIN ranked b ON b.log = a.log AND b.case_id = a.case_id AND b.k < a.k
                    WHERE b.place IS NOT NULL GROUP BY ALL) GROUP BY event_id)""", query=f"""
            SELECT w.event_id, {BASIC}, coalesce(c.activities, '') AS activities
            FROM with_message w LEFT JOIN counted c USING (event_id)"""),
        "preceding_activities": with_ctes(ORDERS, EV, TRACE, query="""
            SELECT a.event_id, b.activity, CAST(count(*) AS DOUBLE) AS occurrences
            FROM t a JOIN t b ON b.log = a.log AND b.case_id = a.case_id AND b.k < a.k GROUP BY ALL"""),
        "feature_alignment": with_ctes(
            EVENTS.replace("src AS (", "src AS (", 1), EV,
            "expected AS (SELECT event_id, " + SECONDS.format(a="ts", b=CASE_END) + " AS e FROM ev)",
            DISTURBED.replace("src AS (SELECT", "src_d AS (SELECT"),
            EV.replace("ev AS (", "ev_d AS (", 1).replace("FROM src ", "FROM src_d "),
            "found AS (SELECT log, event_id, " + SECONDS.format(a="ts", b=CASE_END) + " AS r FROM ev_d)",
            query="""SELECT log, count(*) AS "rows",
                     count(CASE WHEN e IS NULL OR abs(r - e) > 1.0 THEN 1 END) AS misaligned
                     FROM found LEFT JOIN expected USING (event_id) GROUP BY log"""),
        "remaining_times": with_ctes(ORDERS, EV, query=f"""
            SELECT event_id, {SECONDS.format(a='ts', b=CASE_END)} AS expected FROM ev"""),
        "most_frequent": with_ctes(EVENTS, EV, FIRST_SEEN,
                                   query="SELECT log, kind, param, events FROM best"),
        "grouped_folds": with_ctes(ORDERS, query=f"""
            SELECT case_id, "rows", folds, fold FROM {_dealt('src', 'log')}"""),
        "labelled_rows": with_ctes(*LABELLED, query="""
            SELECT task, case_id, event_id, k, y_str, y_num, CAST(y_bool AS VARCHAR) AS y_bool, fold
            FROM labelled"""),
        "training_medians": with_ctes(*LABELLED, MEDIANS, query="""
            SELECT task, fold, round(median, 6) AS median FROM medians"""),
        "median_baseline": with_ctes(*LABELLED, MEDIANS, MEDIAN_SCORES, query="""
            SELECT task, fold, "rows", round(score, 6) AS score FROM mae"""),
        "majority_baseline": with_ctes(*LABELLED, MAJORITY, query="""
            SELECT task, fold, "rows", majority, round(score, 9) AS score FROM f1
            JOIN majority USING (task, fold)"""),
        "fold_summary": with_ctes(*LABELLED, MEDIANS, MEDIAN_SCORES, MAJORITY, query="""
            SELECT task, round(avg(2 * score + fold), 6) AS metric_mean, round(stddev_pop(2 * score + fold), 6) AS metric_sd,
                   round(avg(score), 6) AS baseline_mean, count(*) AS folds
            FROM (SELECT task, fold, score FROM mae UNION ALL SELECT task, fold, score FROM f1)
            GROUP BY task"""),
        "macro_f1": with_ctes(EVENTS, EV, TRACE, REPEATED, query="""
            SELECT actor, CAST(sum(actual) AS BIGINT) AS "rows",
                   round(avg(2.0 * tp / (actual + predicted)), 9) AS score
            FROM (SELECT x.actor, x.label,
                         count(CASE WHEN y = x.label AND prediction = x.label THEN 1 END) AS tp,
                         count(CASE WHEN prediction = x.label THEN 1 END) AS predicted,
                         count(CASE WHEN y = x.label THEN 1 END) AS actual
                  FROM (SELECT actor, y AS label FROM cut UNION SELECT actor, prediction FROM cut) x
                  JOIN cut c ON c.actor = x.actor GROUP BY ALL) GROUP BY actor"""),
        "mean_absolute_error": with_ctes(EVENTS, EV, TRACE, REPEATED, query="""
            SELECT actor, count(*) AS "rows", round(avg(abs(seconds - guess)), 6) AS score
            FROM cut GROUP BY actor"""),
    }
