"""SQL for the queries that SQL can express, run by DuckDB on the same tables."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

MIX = rf"""
WITH d AS (
  SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size, length(bin(CAST({WORDS} AS BIGINT))) AS odds,
         (CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
         / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::DOUBLE AS weight,
             3::DOUBLE * source_size AS cap FROM p),
l AS (SELECT *, (SELECT sum(source_size) FROM w) AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS stopped,
             sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
               AS open_weight FROM w),
t AS (SELECT source, source_size, least(cap, weight * (SELECT max((total - stopped) / open_weight) FROM l)) AS target
      FROM l),
k AS (SELECT source, odds, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source, odds),
h AS (SELECT k.*, t.source_size, t.target,
             coalesce(sum(words) OVER (PARTITION BY k.source ORDER BY odds DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS held,
             sum(words * odds) OVER (PARTITION BY k.source ORDER BY odds DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
               AS open FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, coalesce(least(3::DOUBLE, greatest(odds * max(CASE WHEN open > 0 THEN (target - 3::DOUBLE * held) / open END)
                                                   OVER (PARTITION BY source), 0)), 0) AS e FROM h),
f AS (SELECT *, CASE WHEN abs(e - round(e)) < 1e-9 THEN round(e) ELSE e END AS expected FROM e),
x AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS part,
             target - sum(CAST(floor(expected) AS BIGINT) * words) OVER (PARTITION BY source) AS rest FROM f),
y AS (SELECT d.*, x.source_size, x.target, x.whole, x.rest,
             CASE WHEN part > 0 THEN u / (1::DOUBLE - u) / (part / (1::DOUBLE - part)) END AS z
      FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.odds = x.odds),
r AS (SELECT *, CASE WHEN z IS NOT NULL THEN
               sum(size) OVER (PARTITION BY source, z IS NULL ORDER BY z, doc_id NULLS FIRST, size
                               RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto FROM y),
g AS (SELECT source, min(rest) - coalesce(max(upto) FILTER (WHERE upto <= rest), 0) AS gap FROM r GROUP BY source),
c AS (SELECT r.source, r.doc_id, r.size, r.z, g.gap,
             row_number() OVER (PARTITION BY r.source ORDER BY abs(g.gap - r.size), z, doc_id NULLS FIRST, size) AS n
      FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source
      WHERE r.upto > r.rest AND r.size > 0 AND r.size < 2 * g.gap),
closing AS (SELECT * FROM c WHERE n = 1)
SELECT r.doc_id, r.size, r.source_size, r.target,
       CAST((r.whole + CASE WHEN r.upto <= r.rest OR closing.n IS NOT NULL THEN 1 ELSE 0 END) * r.size AS BIGINT) AS taken
FROM r LEFT JOIN closing ON r.source IS NOT DISTINCT FROM closing.source
  AND r.doc_id IS NOT DISTINCT FROM closing.doc_id AND r.z = closing.z AND r.size = closing.size
"""

LINES = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20
        GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, bad.key IS NOT NULL AND bad.last <> k.doc_id AS gone FROM k LEFT JOIN bad ON k.key = bad.key)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

# The usual CRC-32 of the bytes in a list of numbers, from a table of 256 entries named `crc`.
CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY i) AS entries FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))))"""
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b:
  xor(c >> 8, crc.entries[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""
BYTES = """list_transform(range(1, len(hex(encode({text}))) + 1, 2), lambda i:
  CAST('0x' || substr(hex(encode({text})), i, 2) AS BIGINT))"""


def _simhash() -> str:
    votes = ", ".join(f"sum(n * (({half} >> {i}) & 1)) AS {half}{i}" for half in ("hi", "lo") for i in range(32))
    halves = {half: " + ".join(f"CASE WHEN 2 * {half}{i} > n THEN {1 << i}::BIGINT ELSE 0 END" for i in range(32))
              for half in ("hi", "lo")}
    mix = f"(xor({{0}}, {{0}} >> 16) * {0x45D9F3B}) & 4294967295"
    return f"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS seat, count(*) OVER () AS total FROM d),
e AS (SELECT o.seat, o.doc_id, o.text, length(o.text) AS n,
             left(o.text, length(o.text) - length(o.text) // 4) || left(p.text, length(o.text) // 4) AS edited
      FROM o JOIN o AS p ON p.seat = o.seat % o.total + 1),
t AS (SELECT seat, 'own' AS kind, text FROM e UNION ALL SELECT seat, 'edited', edited FROM e),
w AS (SELECT seat, kind, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS words FROM t),
g AS (SELECT seat, kind, unnest(CASE WHEN len(words) = 1 THEN words ELSE list_transform(range(1, len(words)), lambda i:
             words[i] || ' ' || words[i + 1]) END) AS term FROM w),
c AS (SELECT seat, kind, term, count(*) AS n FROM g GROUP BY seat, kind, term),
h AS (SELECT term, {CRC.format(codes=BYTES.format(text="term"))} AS crc
      FROM (SELECT DISTINCT term FROM c), crc),
x AS (SELECT term, xor(crc, {0x9E3779B9}::BIGINT) AS hi, xor(crc, {0x7F4A7C15}::BIGINT) AS lo FROM h),
y AS (SELECT term, {mix.format("hi")} AS hi, {mix.format("lo")} AS lo FROM x),
z AS (SELECT term, {mix.format("hi")} AS hi, {mix.format("lo")} AS lo FROM y),
m AS (SELECT term, xor(hi, hi >> 16) AS hi, xor(lo, lo >> 16) AS lo FROM z),
v AS (SELECT seat, kind, sum(n) AS n, {votes} FROM c JOIN m USING (term) GROUP BY seat, kind),
f AS (SELECT seat, kind, {halves["hi"]} AS hi, {halves["lo"]} AS lo FROM v),
p AS (SELECT w.seat, w.kind, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM w LEFT JOIN f ON w.seat = f.seat AND w.kind = f.kind),
own AS (SELECT * FROM p WHERE kind = 'own'), other AS (SELECT * FROM p WHERE kind = 'edited'),
s AS (SELECT hi, lo, count(*) AS members FROM own GROUP BY hi, lo),
near AS (SELECT a.hi, a.lo, sum(b.members) - 1 AS n_near FROM s AS a, s AS b
         WHERE bit_count(xor(CAST(a.hi AS BIGINT), CAST(b.hi AS BIGINT)))
               + bit_count(xor(CAST(a.lo AS BIGINT), CAST(b.lo AS BIGINT))) <= 3 GROUP BY a.hi, a.lo)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256,
       printf('%08x%08x', CAST(own.hi AS BIGINT), CAST(own.lo AS BIGINT)) AS fingerprint,
       printf('%08x%08x', CAST(other.hi AS BIGINT), CAST(other.lo AS BIGINT)) AS edited_fingerprint,
       1 - (bit_count(xor(CAST(own.hi AS BIGINT), CAST(other.hi AS BIGINT)))
            + bit_count(xor(CAST(own.lo AS BIGINT), CAST(other.lo AS BIGINT)))) / 64.0::DOUBLE AS near_edited,
       1 - (bit_count(xor(CAST(own.hi AS BIGINT), CAST(after.hi AS BIGINT)))
            + bit_count(xor(CAST(own.lo AS BIGINT), CAST(after.lo AS BIGINT)))) / 64.0::DOUBLE AS near_next,
       CAST(near.n_near AS BIGINT) AS n_near
FROM e JOIN own ON own.seat = e.seat JOIN other ON other.seat = e.seat
JOIN own AS after ON after.seat = e.seat % (SELECT count(*) FROM e) + 1
JOIN near ON near.hi = own.hi AND near.lo = own.lo
"""

TRIE = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place,
             coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {CRC.format(codes=BYTES.format(text="CAST(conv_id AS VARCHAR)"))} % 9 AS h, conv_id - conv_id % 5 AS base
      FROM (SELECT DISTINCT conv_id FROM t), crc),
s AS (SELECT c.conv_id, place, role, text FROM c JOIN t ON t.conv_id = c.base AND place < h
      UNION ALL SELECT c.conv_id, place + 100, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND place >= h),
r AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
             md5(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER w) AS node
      FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
every AS (SELECT conv_id, depth, bytes, node, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
                 depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM r
          UNION ALL SELECT conv_id, 0, 0, '', NULL, conv_id NOT IN (SELECT conv_id FROM s) FROM c),
n AS (SELECT node, any_value(parent) AS parent, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(bytes) AS bytes,
             count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), ''))
               AS ends_sha256 FROM every GROUP BY node),
k AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
-- Every node of a conversation's way lies below every earlier one; a node counts once there.
pairs AS (SELECT DISTINCT a.node AS top, b.node FROM every AS a JOIN every AS b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
below AS (SELECT top, sum((n.n_convs - 1) * n.bytes) AS saved, count_if(k.parent IS NULL) AS leaves
          FROM pairs JOIN n ON n.node = pairs.node LEFT JOIN k ON k.parent = n.node GROUP BY top)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN n AS p ON p.node = n.parent LEFT JOIN k ON k.parent = n.node JOIN below ON below.top = n.node
"""


TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
      FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


CALLS = """
WITH c AS (
  SELECT conv_id, turn, text, 'call-' || turn AS call_id, conv_id % 10 AS kind,
         ['search', 'quote', 'paint'][1 + CAST((conv_id + turn) % 3 AS INTEGER)] AS name FROM conversations
  WHERE role = 'user'),
n AS (SELECT *, CASE WHEN kind = 3 OR (kind = 7 AND turn < 2) THEN turn + 2 WHEN turn >= 2 THEN turn - 2 END AS need
      FROM c),
g AS (SELECT n.*, n.need IS NOT NULL AND o.turn IS NULL AS missing,
             n.kind = 7 AND min(n.turn) OVER (PARTITION BY n.conv_id) < 2
               AND count(*) OVER (PARTITION BY n.conv_id) > 1 AS cyclic
      FROM n LEFT JOIN c AS o ON o.conv_id = n.conv_id AND o.turn = n.need),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN kind = 3 THEN -turn ELSE turn END) - 1 AS seq,
             CASE name WHEN 'search' THEN CAST(length(text) < 60 AS INTEGER) + CAST(length(text) > 300 AS INTEGER)
                       WHEN 'quote' THEN CAST(length(text) > 250 AS INTEGER) ELSE 1 END
             + CAST(missing AS INTEGER) + CAST(cyclic AS INTEGER) AS n_errors FROM g),
r AS (SELECT conv_id, turn, text, 'call-' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'),
j AS (SELECT coalesce(s.conv_id, r.conv_id) AS conv_id, s.seq, coalesce(s.call_id, r.call_id) AS call_id, s.name,
             CASE WHEN s.turn IS NULL THEN 'unasked' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
             s.turn AS call_position, r.turn AS result_position, s.text AS query, r.text AS result,
             coalesce(s.n_errors, 0) AS n_errors
      FROM s FULL JOIN r ON s.conv_id = r.conv_id AND s.call_id = r.call_id)
SELECT conv_id, seq, call_id, name, status, call_position, result_position, n_errors = 0 AS valid,
       CAST(n_errors AS BIGINT) AS n_errors,
       sha256('{"arguments":' || CASE WHEN status = 'unasked' THEN 'null' ELSE '{"limit":' || length(query)
              || ',"query":' || CAST(to_json(query) AS VARCHAR) || ',"turn":' || call_position || '}' END
              || ',"call_id":"' || call_id || '","name":' || coalesce('"' || name || '"', 'null') || ',"result":'
              || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || ',"status":"' || status || '"}') AS message_sha256
FROM j
"""


def all_oracles() -> dict[str, str]:
    return {"op1_tool_calls": CALLS, "op2_mix_sources": MIX, "op4_va_file": TOP_K, "op5_line_dedup": LINES,
            "op11_simhash": _simhash(), "op12_prefix_trie": TRIE}
