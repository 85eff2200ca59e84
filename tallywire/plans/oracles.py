"""DuckDB SQL by query name. Written from the rules, not from the plans: each is its own way to the same rows."""

from __future__ import annotations

import json

from . import fixtures as X

_EV = """timing_events AS (SELECT o_orderkey AS seq, o_custkey AS entity_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Donation' WHEN '2' THEN 'Vote' WHEN '3' THEN 'Indictment' WHEN '4' THEN 'Pardon' ELSE 'Lobbying' END AS event_type, CAST(o_orderdate AS DATE) AS date FROM orders)"""
_PAIRS = (
    _EV
    + """, pairs AS (SELECT a.entity_id, a.seq AS seq_a, b.seq AS seq_b, a.event_type AS ea, b.event_type AS eb, a.date AS da, b.date AS db, b.date - a.date AS days
  FROM timing_events a JOIN timing_events b USING (entity_id) WHERE a.date < b.date OR (a.date = b.date AND a.seq < b.seq)),
corr AS (SELECT entity_id, seq_a AS event_a_id, ea AS event_a_description, da AS event_a_date, seq_b AS event_b_id, eb AS event_b_description, db AS event_b_date, CAST(days AS INTEGER) AS days_between,
  CASE ea WHEN 'Donation' THEN 'DonationToVote' WHEN 'Lobbying' THEN 'LobbyingToVote' ELSE 'IndictmentToPardon' END AS correlation_type, true AS auto_flagged, CASE ea WHEN 'Donation' THEN 90 WHEN 'Lobbying' THEN 180 END AS threshold_days
  FROM pairs WHERE (ea = 'Donation' AND eb = 'Vote' AND days < 90) OR (ea = 'Lobbying' AND eb = 'Vote' AND days < 180) OR (ea = 'Indictment' AND eb = 'Pardon'))"""
)
_FLOWS = """flows AS (SELECT event_id AS flow_id, user_id AS donor, (user_id + CAST(regexp_extract(props, '"k": ?(\\d+)', 1) AS BIGINT)) % (SELECT count(DISTINCT user_id) FROM events) AS recipient, value AS amount, CAST(ts AS DATE) AS date, event_type FROM events),
sparse AS (SELECT * FROM flows WHERE event_type = 'purchase' AND amount > 100),
edges AS (SELECT flow_id AS seq, donor AS src, recipient AS dst, CASE event_type WHEN 'purchase' THEN 'DonatedTo' WHEN 'signup' THEN 'ReceivedContract' WHEN 'click' THEN 'LobbiedFor' WHEN 'view' THEN 'HoldsPosition' ELSE 'Pardoned' END AS rel_type, amount FROM flows WHERE amount > 100),
money AS (SELECT * FROM edges WHERE rel_type = 'DonatedTo'),
busiest AS (SELECT src AS node FROM money GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"""


def _ent(table: str, prefix: str, kind: str, key: str, name: str, extra: str) -> str:
    made = f"TIMESTAMP '2020-01-01' + to_hours(CAST({key} % 5000 AS INTEGER))"
    return f"SELECT '{prefix}' || {key} AS entity_id, '{kind}' AS entity_type, {name} AS name, CAST({key} % 3 + 1 AS BIGINT) AS version, {made} AS created_at, {made} + to_days(CAST({key} % 97 AS INTEGER)) AS updated_at, '{{\"{kind}\":{{' || {extra} || '}}}}' AS data FROM {table}"


_ENT = "entities AS (" + " UNION ALL ".join((
    _ent("customer", "P", "Person", "c_custkey", "c_name", """'"name":"' || c_name || '","segment":"' || c_mktsegment || '","tags":["customer","n' || c_nationkey || '"]'"""),
    _ent("supplier", "O", "Organization", "s_suppkey", "s_name", """'"name":"' || s_name || '","tags":["supplier","n' || s_nationkey || '"]'"""),
    _ent("orders", "Y", "Payment", "o_orderkey", "'payment ' || o_orderkey", """'"status":"' || o_orderstatus || '"'"""),
    _ent("documents", "D", "Document", "doc_id", "'document ' || doc_id", """'"source":"' || source || '"'"""),
)) + ")"
_REL = """rel AS (SELECT 'R' || l_orderkey || '-' || l_linenumber AS rel_id, 'P' || o_custkey AS src, 'O' || l_suppkey AS dst, CASE l_returnflag WHEN 'A' THEN 'DonatedTo' WHEN 'N' THEN 'ReceivedContract' ELSE 'LobbiedFor' END AS rel_type, CAST(l_shipdate AS DATE) AS start_date,
  CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_shipdate AS DATE) + l_linenumber * 30 END AS end_date, CAST(l_linenumber % 2 + 1 AS BIGINT) AS version, o_orderdate AS created_at, l_extendedprice AS amount FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""
_BATCH = """k AS (SELECT *, CAST(substr(entity_id, 2) AS BIGINT) AS k FROM entities WHERE entity_type = 'Person'),
old AS (SELECT entity_id, entity_type, version + seq AS version, updated_at AS created_at, updated_at + to_days(1) AS updated_at, '{"Person":{"name":"seq' || seq || '"}}' AS data, seq FROM k, (VALUES (1), (2)) AS t(seq) WHERE k % 10 = 0),
batch AS (SELECT * FROM old UNION ALL SELECT 'N' || entity_id, entity_type, version, created_at, updated_at, data, seq FROM old WHERE seq = 2)"""
_DOCS = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS entity_id, (['Person', 'Organization', 'Document', 'Payment', 'CourtCase', 'Pardon', 'FlightLogEntry', 'TimingCorrelation', 'ConductComparison', 'PublicStatement', 'PolicyDecision', 'LobbyingActivity'])[CAST(substr(source, 4) AS INTEGER) % 12 + 1] AS entity_type,
  array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 4), ' ') AS name, text AS content, lang || ' ' || source AS tags, DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) AS date FROM documents),
tok AS (SELECT *, list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) < 40) AS tn, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) < 40) AS tc,
  list_filter(regexp_split_to_array(lower(tags), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) < 40) AS tt FROM docs)"""


def _bm25(words: list[str], where: str = "true") -> str:
    terms = ", ".join(f"('{w}')" for w in words)
    return f"""WITH {_DOCS}, f AS (SELECT entity_id, 'name' AS field, tn AS t FROM tok UNION ALL SELECT entity_id, 'content', tc FROM tok UNION ALL SELECT entity_id, 'tags', tt FROM tok),
p AS (SELECT entity_id, field, len(t) AS len, w, len(list_filter(t, lambda x: x = w)) AS tf FROM f, (VALUES {terms}) AS q(w)),
s AS (SELECT field, w, count(*) FILTER (tf > 0) AS df, count(*) AS n, avg(len) AS mean FROM p GROUP BY ALL),
h AS (SELECT entity_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * p.len / mean))) AS score, count(DISTINCT w) AS terms FROM p JOIN s USING (field, w) WHERE tf > 0 GROUP BY entity_id)
SELECT entity_id, entity_type, name, round(score, 4) AS score FROM h JOIN docs USING (entity_id) WHERE terms = {len(words)} AND {where} ORDER BY round(h.score, 6) DESC, entity_id LIMIT 20"""


def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v) if isinstance(v, int) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str, first: int = -1) -> str:
    return "(VALUES " + ", ".join(f"({', '.join(map(_q, (first - i, *r)))})" for i, r in enumerate(rows)) + f") AS t(id, {columns})"


_REP = """r AS (SELECT user_id AS contributor, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'disputed' ELSE 'seen' END AS status FROM events),
w AS (SELECT *, sum(CASE status WHEN 'approved' THEN 10 WHEN 'rejected' THEN -3 WHEN 'disputed' THEN 15 ELSE 0 END) OVER o AS s, count(*) FILTER (status = 'approved') OVER o AS a, count(*) FILTER (status = 'rejected') OVER o AS j, count(*) FILTER (status = 'disputed') OVER o AS d
  FROM r WINDOW o AS (PARTITION BY contributor ORDER BY seq)),
prof AS (SELECT contributor, CAST(arg_max(s, seq) AS BIGINT) AS score, arg_max(a, seq) AS approved, arg_max(j, seq) AS rejected, arg_max(d, seq) AS disputed, CASE WHEN max(s) >= 200 THEN 'Trusted' WHEN max(s) >= 50 THEN 'Established' ELSE 'New' END AS tier, bool_or(s < -10 AND j >= 3 AND a = 0) AS suspended FROM w GROUP BY contributor)"""
_SUB = """e AS (SELECT event_id % 997 AS id, event_id AS seq, CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'dispute' ELSE 'withdraw' END AS action FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM e),
walk(id, k, status, errors) AS (SELECT DISTINCT id, 0::BIGINT, 'Pending', 0::BIGINT FROM n UNION ALL
  SELECT n.id, n.k, coalesce(m.b, status), errors + CASE WHEN m.b IS NULL THEN 1 ELSE 0 END FROM walk JOIN n ON n.id = walk.id AND n.k = walk.k + 1
  LEFT JOIN (VALUES ('Pending', 'claim', 'InReview'), ('InReview', 'approve', 'Approved'), ('InReview', 'reject', 'Rejected'), ('Rejected', 'dispute', 'Disputed')) AS m(a, act, b) ON m.a = walk.status AND m.act = n.action),
states AS (SELECT id AS submission_id, arg_max(status, k) AS status, arg_max(errors, k) AS errors FROM walk GROUP BY id)"""
_VER = """v AS (SELECT *, CASE kind WHEN 'filing' THEN CASE WHEN found THEN 1.0 ELSE 0.0 END WHEN 'url' THEN CASE WHEN live AND archived THEN 1.0 WHEN live THEN 0.85 WHEN archived THEN 0.5 ELSE 0.0 END WHEN 'sanctions' THEN CASE WHEN found THEN least(1.0, greatest(0.0, coalesce(score, 0.5))) ELSE 0.0 END ELSE 0.0 END::DOUBLE AS confidence FROM
  (SELECT o_orderkey AS source_id, CASE o_orderkey % 4 WHEN 0 THEN 'filing' WHEN 1 THEN 'url' WHEN 2 THEN 'sanctions' ELSE 'not_applicable' END AS kind, o_orderstatus = 'O' AS found, o_orderkey % 3 <> 0 AS live, o_orderkey % 2 = 0 AS archived, CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 130)::DOUBLE / 100 END AS score, CASE WHEN o_orderkey % 17 = 0 THEN 'timeout' END AS error FROM orders))"""
_REC = """p AS (SELECT p_partkey AS seq, lower(p_name) AS nm, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN ' ' ELSE '$' || p_size || 'K' END AS amount FROM part),
fp AS (SELECT *, sha256('filing' || chr(0) || CASE WHEN amount IS NULL THEN '' ELSE 'amount' || chr(1) || lower(trim(amount)) || chr(0) END || 'name' || chr(1) || nm || chr(0)) AS fingerprint FROM p),
taken AS (SELECT * FROM fp ORDER BY seq LIMIT {cap}), kept AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM (SELECT * FROM taken QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY seq) = 1))"""
_ALL = 1_000_000_000
_AUD = """a AS (SELECT s_suppkey AS seq, unhex(md5('a' || s_suppkey)) || encode(strftime(TIMESTAMP '2024-01-01' + to_minutes(CAST(s_suppkey AS INTEGER)), '%Y-%m-%dT%H:%M:%S+00:00') || 'Create' || 'Organization') || unhex(md5('O' || s_suppkey)) || encode(sha256(s_name)) AS head FROM supplier),
o AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM a),
c(k, seq, prev_hash, entry_hash) AS (SELECT k, seq, repeat('0', 64), sha256(head || encode(repeat('0', 64))) FROM o WHERE k = 1 UNION ALL SELECT o.k, o.seq, c.entry_hash, sha256(o.head || encode(c.entry_hash)) FROM c JOIN o ON o.k = c.k + 1)"""
_COMP = """both_ AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach(a, b) AS (SELECT a, a FROM both_ UNION SELECT b, b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"""
_SIM = "(CASE WHEN {a} = {b} THEN 1.0 ELSE jaro_similarity({a}, {b}) END)"


def _jw(a: str, b: str) -> str:
    j = _SIM.format(a=a, b=b)
    same = " + ".join(f"CASE WHEN length({a}) >= {i} AND left({a}, {i}) = left({b}, {i}) THEN 1 ELSE 0 END" for i in range(1, 5))
    return f"({j} + ({same}) * 0.1 * (1 - {j}))"


def _bfs(ways: str) -> str:
    return f"""WITH RECURSIVE {_FLOWS}, target AS (SELECT max(dst) AS node FROM money WHERE dst <> (SELECT node FROM busiest)), way AS ({ways}),
d(node, k) AS (SELECT node, 0 FROM busiest UNION SELECT way.b, k + 1 FROM d JOIN way ON way.a = d.node WHERE k < 12),
dist AS (SELECT node, min(k) AS k FROM d GROUP BY node),
walk(node, k, nodes) AS (SELECT node, 0, [CAST(node AS VARCHAR)] FROM busiest UNION ALL SELECT node, k, nodes FROM (SELECT way.b AS node, walk.k + 1 AS k, min(list_append(nodes, CAST(way.b AS VARCHAR))) AS nodes FROM walk JOIN way ON way.a = walk.node JOIN dist ON dist.node = way.b AND dist.k = walk.k + 1 GROUP BY 1, 2))
SELECT array_to_string(nodes, '->') AS path, walk.k AS length FROM walk JOIN target ON target.node = walk.node"""


_WAY, _WAYS = "SELECT DISTINCT src AS a, dst AS b FROM money", "SELECT src AS a, dst AS b FROM money UNION SELECT dst, src FROM money"


# all walks of k steps: at the least k there is one, they are the shortest paths
_BETWEEN = f"""WITH RECURSIVE {_FLOWS}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), size AS (SELECT count(*) AS n FROM n), e AS (SELECT src, dst, count(*) AS m FROM edges GROUP BY ALL),
w(s, v, k, sigma) AS (SELECT node, node, 0, 1.0::DOUBLE FROM n UNION ALL SELECT s, dst, k + 1, sum(sigma * m) FROM w JOIN e ON src = v, size WHERE k < least(size.n, 40) GROUP BY s, dst, k),
d AS (SELECT s, v, min(k) AS k, arg_min(sigma, k) AS sigma FROM w GROUP BY s, v),
p AS (SELECT a.v AS node, sum(a.sigma * b.sigma / c.sigma) AS s FROM d a JOIN d b ON b.s = a.v JOIN d c ON c.s = a.s AND c.v = b.v AND c.k = a.k + b.k WHERE a.v <> a.s AND b.v <> a.v GROUP BY 1)
SELECT n.node, round(coalesce(p.s, 0) / ((size.n - 1) * (size.n - 2)), 9) AS centrality FROM n LEFT JOIN p USING (node), size"""
# who is cut off from a node's least neighbour when the node is taken away
_CUTS = f"""WITH RECURSIVE {_FLOWS}, b AS (SELECT src AS a, dst AS b FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst), f AS (SELECT a AS node, min(b) AS first FROM b GROUP BY a),
r(cut, node) AS (SELECT node, first FROM f UNION SELECT r.cut, b.b FROM r JOIN b ON b.a = r.node WHERE b.b <> r.cut)
SELECT DISTINCT b.a AS node FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.cut = b.a AND r.node = b.b)"""
# one step is one node's turn; labels stand in a list by the nodes' order, and `still` counts the turns without a change
_LABELS = f"""WITH RECURSIVE {_FLOWS}, ends AS (SELECT src AS node, 2 * seq AS q FROM edges UNION ALL SELECT dst, 2 * seq + 1 FROM edges), o AS (SELECT node, min(q) AS first, row_number() OVER (ORDER BY min(q)) AS i FROM ends GROUP BY node),
g AS (SELECT x.i AS i, list(y.i) AS near FROM (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) JOIN o x ON x.node = a JOIN o y ON y.node = b GROUP BY x.i), size AS (SELECT count(*) AS n FROM o),
s(k, labels, still) AS (SELECT 0::BIGINT, (SELECT list(first ORDER BY i) FROM o), 0::BIGINT
  UNION ALL SELECT k + 1, list_concat(list_concat(list_slice(labels, 1, turn - 1), [best]), list_slice(labels, turn + 1, n)), CASE WHEN best = labels[turn] THEN still + 1 ELSE 0 END
  FROM (SELECT s.*, size.n AS n, s.k % size.n + 1 AS turn, list_sort(list_transform(map_entries(list_aggregate(list_transform(g.near, lambda x: s.labels[x]), 'histogram')), lambda e: {{'n': -CAST(e.value AS BIGINT), 'l': e.key}}))[1].l AS best
        FROM s, size, g WHERE g.i = s.k % size.n + 1 AND s.still < size.n AND s.k < 100 * size.n))
SELECT o.node, labels[o.i] AS label FROM o, (SELECT labels FROM s ORDER BY k DESC LIMIT 1)"""


def _ego(ways: str) -> str:
    return f"""WITH RECURSIVE {_FLOWS}, way AS ({ways}), d(node, k) AS (SELECT node, 0 FROM busiest UNION SELECT way.b, k + 1 FROM d JOIN way ON way.a = d.node WHERE k < 2), i AS (SELECT DISTINCT node FROM d)
SELECT seq, src, dst, rel_type FROM money WHERE src IN (FROM i) AND dst IN (FROM i)"""


_TRACE = f"""WITH RECURSIVE {_FLOWS}, last AS (SELECT src, dst, arg_max(amount, seq) AS amount FROM money GROUP BY ALL), e AS (SELECT CAST(src AS VARCHAR) AS a, CAST(dst AS VARCHAR) AS b, last.amount AS amount FROM money JOIN last USING (src, dst)),
t(hops, total, loc) AS (SELECT [CAST(node AS VARCHAR)], 0.0::DOUBLE, CAST(node AS VARCHAR) FROM busiest UNION ALL SELECT list_append(hops, b), total + amount, b FROM t JOIN e ON e.a = t.loc WHERE NOT list_contains(hops, b) AND len(hops) <= 3)"""
_CHAIN = f"""WITH RECURSIVE {_FLOWS}, f AS (SELECT *, row_number() OVER (ORDER BY date, flow_id) AS rank FROM sparse),
c(ranks, nodes, total, first_date, last_date, loc) AS (SELECT [rank], [CAST(donor AS VARCHAR), CAST(recipient AS VARCHAR)], amount, date, date, recipient FROM f UNION ALL
  SELECT list_append(ranks, rank), list_append(nodes, CAST(recipient AS VARCHAR)), total + amount, first_date, date, recipient FROM c JOIN f ON f.donor = c.loc AND f.date - c.last_date BETWEEN 0 AND 5 AND NOT list_contains(ranks, rank)),
m AS (SELECT * FROM c WHERE len(ranks) >= 2 AND NOT EXISTS (SELECT 1 FROM f WHERE f.donor = c.loc AND f.date - c.last_date BETWEEN 0 AND 5 AND NOT list_contains(c.ranks, f.rank)))
SELECT array_to_string(nodes, '->') AS path, CAST(len(ranks) AS INTEGER) AS n, round(total, 2) AS total, first_date, last_date FROM m QUALIFY row_number() OVER (PARTITION BY nodes ORDER BY ranks) = 1"""


def _bursts(source: str) -> str:
    return f"""s AS ({source}), b0 AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ts, seq) AS i FROM s),
b1 AS (SELECT a.*, (SELECT count(*) FROM b0 b WHERE b.entity = a.entity AND b.i >= a.i AND b.ts <= a.ts + INTERVAL 7 DAY) AS n FROM b0 a),
bw(entity, i, n) AS (SELECT entity, i, n FROM b1 WHERE i = 1 UNION ALL SELECT b1.entity, b1.i, b1.n FROM bw JOIN b1 ON b1.entity = bw.entity AND b1.i = bw.i + CASE WHEN bw.n >= 3 THEN bw.n ELSE 1 END),
bursts AS (SELECT bw.entity, x.ts AS first_ts, y.ts AS last_ts, bw.n FROM bw JOIN b1 x ON x.entity = bw.entity AND x.i = bw.i JOIN b1 y ON y.entity = bw.entity AND y.i = bw.i + bw.n - 1 WHERE bw.n >= 3)"""


_PERIODIC = """g AS (SELECT o_custkey AS entity, o_orderkey AS seq, o_orderdate AS ts, lag(o_orderdate) OVER w AS before, coalesce(epoch(o_orderdate) - epoch(lag(o_orderdate) OVER w) BETWEEN 76 * 86400 AND 104 * 86400, false) AS hit FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
h AS (SELECT *, count(*) FILTER (NOT hit) OVER (PARTITION BY entity ORDER BY ts, seq) AS run FROM g),
periodic AS (SELECT entity, min(before) AS first_ts, max(ts) AS last_ts, count(*) + 1 AS n FROM h WHERE hit GROUP BY entity, run HAVING count(*) >= 2 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY min(before), run) = 1)"""
_ORDERS_TS = "SELECT o_custkey AS entity, o_orderkey AS seq, o_orderdate AS ts FROM orders"

ORACLES: dict[str, str] = {
    "timing_correlations": f"WITH {_PAIRS} SELECT * FROM corr",
    "timing_flags": f"""WITH {_PAIRS} SELECT entity_id, CASE WHEN ea = 'Indictment' THEN 'Indictment followed by pardon (' || days || ' days apart)' ELSE ea || ' followed by vote within ' || days || ' days' END AS description,
  CASE ea WHEN 'Donation' THEN 'High' WHEN 'Lobbying' THEN 'Medium' ELSE 'Critical' END AS severity, CAST(days AS INTEGER) AS time_delta FROM pairs
  WHERE (ea = 'Donation' AND eb = 'Vote' AND days < 30) OR (ea = 'Lobbying' AND eb = 'Vote' AND days < 90) OR (ea = 'Indictment' AND eb = 'Pardon')""",
    "correlations_by_type": f"WITH {_PAIRS} SELECT correlation_type, count(*) AS n, min(days_between) AS min_days, max(days_between) AS max_days FROM corr GROUP BY 1",
    "correlations_for_official": f"WITH {_PAIRS}, v AS (SELECT min(seq) AS s FROM timing_events WHERE event_type = 'Vote') SELECT corr.* FROM corr, v WHERE event_a_id = s OR event_b_id = s",
    "timing_page_stats": f"WITH {_PAIRS} SELECT count(*) AS n, count(*) AS flagged, CAST(round(avg(days_between)) AS BIGINT) AS avg_gap, min(days_between) AS min_gap FROM corr",
    "bursts_greedy": f"WITH RECURSIVE {_bursts('SELECT user_id AS entity, event_id AS seq, ts FROM events')} SELECT * FROM bursts",
    "periodic_runs": f"WITH {_PERIODIC} SELECT entity, first_ts, last_ts, n FROM periodic",
    "response_chains": """WITH a AS (SELECT event_id, ts FROM events WHERE value > 100 AND event_type = 'purchase'), b AS (SELECT event_id, ts FROM events WHERE value > 100 AND event_type = 'error')
SELECT a.event_id AS seq_a, b.event_id AS seq_b, CAST(floor((epoch_us(b.ts) - epoch_us(a.ts)) / 86400e6) AS BIGINT) AS days FROM a JOIN b ON b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAY""",
    "temporal_all": f"WITH RECURSIVE {_PERIODIC}, {_bursts(_ORDERS_TS)} SELECT *, 'burst' AS pattern FROM bursts UNION ALL SELECT entity, first_ts, last_ts, n, 'periodic' FROM periodic",
    "rate_limited": """WITH RECURSIVE o AS (SELECT user_id AS key, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w(key, k, held, accepted) AS (SELECT key, 0::BIGINT, []::TIMESTAMP[], false FROM o WHERE k = 1 UNION ALL
  SELECT key, k, CASE WHEN len(live) < 2 THEN list_append(live, ts) ELSE live END, len(live) < 2 FROM (SELECT o.key, o.k, o.ts, list_filter(held, lambda t: t > o.ts - INTERVAL 6 HOUR) AS live FROM w JOIN o ON o.key = w.key AND o.k = w.k + 1))
SELECT o.key, o.seq, o.ts, accepted FROM w JOIN o USING (key, k)""",
    "flows_in_window": f"WITH {_FLOWS}, m AS (SELECT min(date) AS d FROM flows) SELECT flow_id, donor, recipient, amount, date FROM flows, m WHERE date BETWEEN d + 3 AND d + 9",
    "flow_periods_30d": """WITH m AS (SELECT min(CAST(o_orderdate AS DATE)) AS d FROM orders) SELECT d + CAST(k * 30 AS INTEGER) AS period_start, d + CAST(k * 30 + 29 AS INTEGER) AS period_end, round(sum(o_totalprice), 2) AS total, count(*) AS n, count(DISTINCT o_custkey) AS donors, count(DISTINCT o_orderstatus) AS recipients
FROM (SELECT *, (CAST(o_orderdate AS DATE) - d) // 30 AS k FROM orders, m) GROUP BY d, k""",
    "suspicious_bursts": f"""WITH {_FLOWS}, v AS (SELECT DISTINCT date AS vote_date, date - DATE '2000-01-01' AS vote_row FROM flows)
SELECT vote_row, vote_date, count(*) AS n, round(sum(amount), 2) AS total, round(avg(amount), 4) AS average, count(DISTINCT donor) AS donors, count(DISTINCT recipient) AS recipients FROM v JOIN flows ON date >= vote_date - 5 AND date < vote_date AND amount > 0 AND amount <= 50 GROUP BY ALL HAVING count(*) >= 3""",
    "flow_chains": _CHAIN,
    "money_trace": _TRACE + " SELECT array_to_string(hops, '->') AS path, round(total, 2) AS total_amount, CAST(len(hops) - 1 AS INTEGER) AS hop_count FROM t WHERE len(hops) > 1",
    "flow_destinations": _TRACE + " SELECT hops[-1] AS destination, round(sum(total), 2) AS total, count(*) AS paths FROM t WHERE len(hops) > 1 GROUP BY 1",
    "entity_point_lookup": f"WITH {_ENT} SELECT * FROM entities WHERE entity_id = 'P7'",
    "entities_page": f"WITH {_ENT} SELECT * FROM entities ORDER BY created_at DESC, entity_id LIMIT 10 OFFSET 20",
    "entities_by_type": f"WITH {_ENT} SELECT * FROM entities WHERE entity_type = 'Organization'",
    "entities_date_range": f"WITH {_ENT} SELECT * FROM entities WHERE updated_at BETWEEN TIMESTAMP '2020-02-01' AND TIMESTAMP '2020-02-10'",
    "entities_contains": f"""WITH {_ENT} SELECT * FROM entities WHERE entity_type = 'Person' AND contains(data, '"segment":"BUILDING"') AND contains(data, '"n3"]')""",
    "entities_type_version": f"WITH {_ENT} SELECT * FROM entities WHERE entity_type = 'Person' AND version >= 2",
    "entities_recent": f"WITH {_ENT} SELECT * FROM entities ORDER BY updated_at DESC, entity_id LIMIT 25",
    "entities_keyset_page": f"WITH {_ENT}, a AS (SELECT * FROM entities WHERE (created_at, entity_id) > (TIMESTAMP '2020-01-03', 'O3')) SELECT *, (SELECT count(*) FROM a) > 15 AS has_more FROM a ORDER BY created_at, entity_id LIMIT 15",
    "entity_counts": f"WITH {_ENT} SELECT entity_type, count(*) AS n FROM entities GROUP BY 1",
    "entities_faceted": f"WITH {_ENT} SELECT * FROM entities WHERE contains(lower(name), 'customer') AND entity_type = 'Person' AND CAST(created_at AS DATE) BETWEEN DATE '2020-01-02' AND DATE '2020-01-08'",
    "like_search": f"WITH {_ENT} SELECT * FROM entities WHERE data ILIKE '%building%'",
    "rel_from": f"WITH {_REL} SELECT * FROM rel WHERE src = 'P7'",
    "rel_to": f"WITH {_REL} SELECT * FROM rel WHERE dst = 'O3'",
    "rel_between": f"WITH {_REL} SELECT * FROM rel WHERE (src = 'P7' AND dst = 'O3') OR (src = 'O3' AND dst = 'P7')",
    "rel_active_on": f"WITH {_REL} SELECT * FROM rel WHERE start_date <= DATE '1998-03-01' AND (end_date IS NULL OR end_date >= DATE '1998-03-01')",
    "rel_by_type": f"WITH {_REL} SELECT rel_type, count(*) AS n FROM rel GROUP BY 1",
    "upsert_merge": f"""WITH {_ENT}, {_BATCH}, last AS (SELECT * FROM batch QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) = 1), one AS (SELECT entity_id, min_by(created_at, seq) AS c FROM batch GROUP BY 1)
SELECT entity_id, coalesce(l.entity_type, k.entity_type) AS entity_type, coalesce(l.version, k.version) AS version, coalesce(k.created_at, one.c) AS created_at, coalesce(l.updated_at, k.updated_at) AS updated_at, coalesce(l.data, k.data) AS data FROM k FULL JOIN last l USING (entity_id) LEFT JOIN one USING (entity_id)""",
    "insert_new": f"WITH {_ENT}, {_BATCH} SELECT entity_id, version FROM batch WHERE seq = 2 AND entity_id NOT IN (SELECT entity_id FROM entities)",
    "versioned_update": f"""WITH {_ENT}, k AS (SELECT *, CAST(substr(entity_id, 2) AS BIGINT) AS k FROM entities WHERE entity_type IN ('Person', 'Organization')),
c AS (SELECT CASE WHEN k % 10 = 0 THEN entity_id ELSE 'X' || entity_id END AS entity_id, k % 4 AS version FROM k WHERE k % 5 = 0),
j AS (SELECT c.entity_id, c.version AS v, k.version AS old, CASE WHEN c.version <= 0 THEN 'invalid' WHEN k.version IS NULL THEN 'missing' WHEN k.version <> c.version - 1 THEN 'stale' ELSE 'applied' END AS outcome FROM c LEFT JOIN k USING (entity_id))
SELECT entity_id, outcome, CASE WHEN outcome = 'applied' THEN v ELSE old END AS new_version, CASE WHEN outcome = 'applied' THEN 'id:' || entity_id || ',kind:new,note:x' END AS data FROM j""",
    "cascade_delete": f"WITH {_REL} SELECT rel_type, count(*) AS n FROM rel WHERE CAST(substr(dst, 2) AS BIGINT) % 2 <> 0 GROUP BY 1",
    "rel_orphans": f"WITH {_REL} SELECT rel_type, count(*) AS n FROM rel WHERE CAST(substr(src, 2) AS BIGINT) % 3 = 0 GROUP BY 1",
    "stats": f"WITH {_ENT}, {_REL} SELECT 'entities' AS what, count(*) AS n FROM entities UNION ALL SELECT 'relationships', count(*) FROM rel UNION ALL SELECT 'pending', count(*) FROM events WHERE event_type = 'view'",
    "neighbors_out": f"WITH {_REL}, {_ENT} SELECT rel_id, rel_type, dst AS neighbour, entity_type, name FROM rel JOIN entities ON entity_id = dst WHERE src = 'P7'",
    "neighbors_in": f"WITH {_REL}, {_ENT} SELECT rel_id, rel_type, src AS neighbour, entity_type, name FROM rel JOIN entities ON entity_id = src WHERE dst = 'O3'",
    "relationship_bundle": f"WITH {_REL} SELECT rel_id, 'in' AS direction FROM rel WHERE dst = 'O3'",
    "timeline": f"WITH {_REL} SELECT rel_id, rel_type, start_date, end_date, 'out' AS direction FROM rel WHERE src = 'P7'",
    "degrees": f"WITH {_FLOWS} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT src AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1",
    "degree_centrality": f"WITH {_FLOWS}, n AS (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) SELECT node, round(count(*) / ((SELECT count(DISTINCT node) FROM n) - 1), 6) AS centrality FROM n GROUP BY 1",
    "ego_subgraph": _ego(_WAY),
    "ego_network_undirected": _ego(_WAYS),
    "simple_paths": f"""WITH RECURSIVE {_FLOWS}, target AS (SELECT dst AS node FROM money WHERE dst <> (SELECT node FROM busiest) GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),
t(nodes, loc) AS (SELECT [CAST(node AS VARCHAR)], node FROM busiest UNION ALL SELECT list_append(nodes, CAST(dst AS VARCHAR)), dst FROM t JOIN money ON src = t.loc WHERE NOT list_contains(nodes, CAST(dst AS VARCHAR)) AND t.loc <> (SELECT node FROM target) AND len(nodes) <= 3)
SELECT array_to_string(nodes, '->') AS path, count(*) AS n FROM t WHERE loc = (SELECT node FROM target) GROUP BY 1""",
    "shortest_path": _bfs(_WAY),
    "shortest_path_undirected": _bfs(_WAYS),
    "components": f"WITH RECURSIVE {_FLOWS}, {_COMP} SELECT * FROM comp",
    "component_communities": f"WITH RECURSIVE {_FLOWS}, {_COMP} SELECT dense_rank() OVER (ORDER BY component) - 1 AS community, node FROM comp",
    "betweenness": _BETWEEN,
    "articulation_points": _CUTS,
    "label_propagation": _LABELS,
    "dense_clusters": f"""WITH RECURSIVE {_FLOWS}, {_COMP}, z AS (SELECT component, count(*) AS size FROM comp GROUP BY 1), i AS (SELECT component, count(*) AS internal_edges FROM edges JOIN comp ON src = node GROUP BY 1)
SELECT component, size, internal_edges, round(CASE WHEN size > 1 THEN 2 * internal_edges / (size * (size - 1)) ELSE 0.0 END, 6) AS density FROM z JOIN i USING (component) WHERE size >= 2""",
    "modularity": f"""WITH RECURSIVE {_FLOWS}, {_COMP}, o AS (SELECT src, count(*) AS o FROM edges GROUP BY 1), i AS (SELECT dst, count(*) AS i FROM edges GROUP BY 1), m AS (SELECT count(*) AS m FROM edges)
SELECT round(coalesce(sum(1 - o * i / m) / any_value(m), 0.0), 6) AS modularity FROM edges JOIN o USING (src) JOIN i USING (dst), m""",
    "export_dot": f"""WITH {_FLOWS}, n AS (SELECT DISTINCT src AS node FROM edges UNION SELECT dst FROM edges), l AS (SELECT 0 AS part, 0 AS k, 'digraph {{' AS line UNION ALL SELECT 1, row_number() OVER (ORDER BY node), '    "' || node || '";' FROM n
  UNION ALL SELECT 2, row_number() OVER (ORDER BY seq), '    "' || src || '" -> "' || dst || '" [label="' || rel_type || '"];' FROM edges UNION ALL SELECT 3, 0, '}}') SELECT row_number() OVER (ORDER BY part, k) - 1 AS line_no, line FROM l""",
    "export_graphml": f"""WITH {_FLOWS}, n AS (SELECT DISTINCT src AS node FROM edges UNION SELECT dst FROM edges), e AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS i FROM edges),
l AS (SELECT 0 AS part, k, line FROM (VALUES (0, '<?xml version="1.0" encoding="UTF-8"?>'), (1, '<graphml xmlns="http://graphml.graphdrawing.org/graphml"'), (2, '         xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'),
  (3, '         xsi:schemaLocation="http://graphml.graphdrawing.org/graphml http://graphml.graphdrawing.org/graphml/graphml.xsd">'), (4, '  <key id="relationship" for="edge" attr.name="relationship" attr.type="string"/>'), (5, '  <graph id="G" edgedefault="directed">')) AS h(k, line)
  UNION ALL SELECT 1, row_number() OVER (ORDER BY node), '    <node id="' || node || '"/>' FROM n UNION ALL SELECT 2, i * 3, '    <edge id="e' || i || '" source="' || src || '" target="' || dst || '">' FROM e
  UNION ALL SELECT 2, i * 3 + 1, '      <data key="relationship">' || rel_type || '</data>' FROM e UNION ALL SELECT 2, i * 3 + 2, '    </edge>' FROM e UNION ALL SELECT 3, 0, '  </graph>' UNION ALL SELECT 3, 1, '</graphml>')
SELECT row_number() OVER (ORDER BY part, k) - 1 AS line_no, line FROM l""",
    "export_cytoscape": f"""WITH {_FLOWS}, n AS (SELECT DISTINCT src AS node FROM edges UNION SELECT dst FROM edges) SELECT 'node' AS kind, '{{"data":{{"id":"' || node || '"}}}}' AS json FROM n
UNION ALL SELECT 'edge', '{{"data":{{"source":"' || src || '","target":"' || dst || '","relationship":"' || rel_type || '"}}}}' FROM edges""",
    "export_correlations": f"""WITH {_PAIRS} SELECT '{{"entity_id":' || entity_id || ',"event_a_date":"' || event_a_date || '","event_b_date":"' || event_b_date || '","days_between":' || days_between || ',"correlation_type":"DonationToVote"}}' AS json FROM corr WHERE correlation_type = 'DonationToVote'""",
    "entity_labels": f"""WITH {_ENT} SELECT entity_id, CASE WHEN entity_type = 'Payment' THEN '$' || CAST(round_even(CAST(o_totalprice AS DECIMAL(18, 6)), 0) AS BIGINT) || ' payment' ELSE name END AS label FROM entities LEFT JOIN orders ON entity_id = 'Y' || o_orderkey""",
    "search_bm25": _bm25(["the", "that", "with"]),
    "search_filtered": _bm25(["the", "en"], "entity_type = 'Payment' AND date BETWEEN DATE '2020-02-01' AND DATE '2020-12-31'"),
    "search_facets": f"WITH {_DOCS} SELECT entity_type, count(DISTINCT entity_id) AS n FROM tok WHERE list_has_any(list_concat(tn, tc), ['erin', 'der']) GROUP BY 1",
    "search_prefix": f"WITH {_DOCS} SELECT DISTINCT name FROM tok WHERE len(list_filter(tn, lambda t: starts_with(t, 'th'))) > 0 ORDER BY name LIMIT 20",
    "search_builder": f"WITH {_DOCS} SELECT entity_id FROM tok WHERE list_has_any(list_concat(list_concat(tn, tc), tt), ['erin', 'der']) AND entity_type = 'Document' AND date BETWEEN DATE '2020-01-05' AND DATE '2021-06-30'",
    "search_snippets": f"WITH {_DOCS} SELECT name, regexp_replace(name, '\\b(the|of)\\b', '<b>\\1</b>', 'gi') AS snippet FROM (SELECT DISTINCT name FROM tok WHERE len(list_filter(tn, lambda t: starts_with(t, 'the'))) > 0 ORDER BY name LIMIT 50)",
    "sanitized_queries": f"SELECT id, q FROM {_values([(x[3],) for x in X.TEXTS], 'q')}",
    "norm_person_name": f"""SELECT id, t, name FROM {_values(X.NAMES, 't, name')} UNION ALL SELECT p_partkey, upper(split_part(p_name, ' ', -1)) || ', ' || split_part(p_name, ' ', 1) || ' Jr.',
  upper(left(split_part(p_name, ' ', 1), 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || ' ' || upper(left(split_part(p_name, ' ', -1), 1)) || lower(substr(split_part(p_name, ' ', -1), 2)) FROM part""",
    "norm_dollar": f"SELECT id, amount FROM {_values([(x[1],) for x in X.AMOUNTS], 'amount')}",
    "norm_date": f"SELECT id, CAST(day AS DATE) AS day FROM {_values([(x[1],) for x in X.DATES], 'day')}",
    "norm_state": f"SELECT id, code FROM {_values([(x[1],) for x in X.STATES], 'code')}",
    "fingerprints": f"WITH {_REC.format(cap=_ALL)} SELECT seq, fingerprint FROM fp",
    "fec_id_checks": f"SELECT * FROM {_values([x[1:] for x in X.IDS], 'candidate, committee')}",
    "sanitize_text": f"SELECT id, clean, plain FROM {_values([x[1:3] for x in X.TEXTS], 'clean, plain')}",
    "url_checks": f"SELECT page_id AS id, regexp_matches(url, '^https?://[^/?#]+') AS ok FROM pages UNION ALL SELECT id, ok FROM {_values([(x[1],) for x in X.URLS], 'ok')}",
    "kind_maps": f"SELECT * FROM {_values([x[1:] for x in X.KINDS], 'committee, case_type, docket, party, member_party')}",
    "content_hashes": "SELECT doc_id, h AS content_hash, left(h, 2) || '/' || substr(h, 3, 2) || '/' || h AS path FROM (SELECT doc_id, sha256(text) AS h FROM documents)",
    "doc_dedup": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1",
    "ingest_dedup_stats": f"WITH {_REC.format(cap=_ALL)} SELECT count(*) AS total_seen, count(*) - count(DISTINCT fingerprint) AS duplicates_skipped, count(DISTINCT fingerprint) AS unique_passed FROM fp",
    "ingest_validation": f"WITH {_REC.format(cap=_ALL)} SELECT CAST(i AS BIGINT) AS record_index, 'amount' AS field, CASE WHEN amount IS NULL THEN 'missing' ELSE 'empty' END AS reason FROM kept WHERE amount IS NULL OR trim(amount) = ''",
    "ingest_pipeline": f"""WITH {_REC.format(cap=1000)} SELECT CAST(i AS BIGINT) AS record_index, seq, array_to_string(list_transform(string_split(nm, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS name,
  CASE WHEN amount LIKE '$%' THEN CAST(CAST(replace(replace(amount, '$', ''), 'K', '') AS BIGINT) * 1000 AS VARCHAR) ELSE amount END AS amount FROM kept""",
    "ingest_counters": f"WITH {_REC.format(cap=1000)} SELECT (SELECT count(*) FROM kept) AS processed, (SELECT count(*) FROM taken) - (SELECT count(*) FROM kept) AS skipped_duplicate, (SELECT count(*) FROM kept WHERE amount IS NULL OR trim(amount) = '') AS validation_errors",
    "person_fuzzy": f"""WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 > 0 THEN DATE '1950-01-01' + CAST(p_partkey % 37 AS INTEGER) END AS born, lower(split_part(p_name, ' ', 1)) AS f, lower(split_part(p_name, ' ', -1)) AS l FROM part),
n AS (SELECT DISTINCT f, l FROM p), s AS (SELECT a.f AS fa, a.l AS la, b.f AS fb, b.l AS lb, ({_jw('a.f', 'b.f')} + {_jw('a.l', 'b.l')}) / 2 AS sim FROM n a, n b),
m AS (SELECT a.id AS new_id, b.id AS existing_id, sim, coalesce(a.born = b.born, false) AS same, a.born <> b.born AS apart FROM p a JOIN s ON a.f = fa AND a.l = la JOIN p b ON b.f = fb AND b.l = lb WHERE a.id % 50 = 0),
c AS (SELECT *, CASE WHEN same THEN greatest(sim, 0.95) WHEN sim >= 0.85 AND apart THEN sim * 0.7 ELSE sim END AS confidence FROM m)
SELECT new_id, existing_id, round(confidence, 6) AS confidence, concat_ws(', ', CASE WHEN sim >= 0.85 THEN 'name similarity ' || printf('%.2f', sim) END, CASE WHEN same THEN 'birth_date match' END) AS reason FROM c WHERE confidence >= 0.85""",
    "html_title": "SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title FROM pages",
    "csv_records": "SELECT c_custkey, trim(c_name) AS name, c_mktsegment AS segment, CAST(c_custkey AS VARCHAR) AS key FROM customer",
    "mime_routes": f"SELECT id, CAST(NULL AS VARCHAR) AS extractor FROM {_values([(x[0],) for x in X.KINDS], 't')} UNION ALL SELECT id, e FROM {_values([(x[1],) for x in X.MIMES], 'e', -101)}",
    "reputation": f"WITH {_REP} SELECT * FROM prof",
    "leaderboard": f"WITH {_REP} SELECT * FROM prof WHERE NOT suspended ORDER BY score DESC, contributor LIMIT 10",
    "submission_states": f"WITH RECURSIVE {_SUB} SELECT * FROM states",
    "submission_status_counts": f"WITH RECURSIVE {_SUB} SELECT status, count(*) AS n FROM states GROUP BY 1",
    "watch_alerts": """WITH c AS (SELECT event_id AS seq, user_id AS entity_id, CASE event_type WHEN 'purchase' THEN 'NewRelationship' WHEN 'signup' THEN 'NewTimingCorrelation' ELSE 'EntityUpdated' END AS alert_type FROM events)
SELECT c_custkey AS sub_id, c_nationkey AS subscriber, seq, entity_id, alert_type FROM c JOIN customer ON entity_id = c_custkey % 200 WHERE c_acctbal > 0 AND (c_custkey % 4 = 0 OR (c_custkey % 4 = 1 AND alert_type = 'NewRelationship') OR (c_custkey % 4 = 2 AND alert_type = 'NewTimingCorrelation'))""",
    "confidence_levels": f"WITH {_VER} SELECT source_id, confidence, CASE WHEN confidence >= 0.85 THEN 'High' WHEN confidence >= 0.6 THEN 'Medium' WHEN confidence >= 0.3 THEN 'Low' ELSE 'Unverified' END AS level FROM v",
    "batch_stats": f"""WITH {_VER}, c AS (SELECT count(*) FILTER (error IS NULL AND kind <> 'not_applicable' AND confidence >= 0.5) AS verified, count(*) FILTER (error IS NOT NULL OR (kind <> 'not_applicable' AND confidence < 0.5)) AS failed,
  count(*) FILTER (error IS NULL AND kind = 'not_applicable') AS not_applicable, round(coalesce(avg(confidence) FILTER (error IS NULL), 0.0), 6) AS avg_confidence FROM v) SELECT *, round(CASE WHEN verified + failed = 0 THEN 0.0 ELSE verified / (verified + failed) END, 6) AS success_rate FROM c""",
    "sanction_flags": f"SELECT * FROM {_values([(True, True, 'Ann Lee', 0.91), (True, False, 'Acme', 0.4), (False, True, None, None), (False, False, 'Bo', 0.2), (False, False, None, None)], 'is_sanctioned, is_pep, matched_name, match_score')}",
    "verify_routes": f"SELECT * FROM {_values([(x[2],) for x in X.SOURCE_ROWS], 'route')}",
    "audit_chain_build": f"WITH RECURSIVE {_AUD} SELECT seq, prev_hash, entry_hash FROM c",
    "audit_chain_verify": "SELECT s_suppkey AS seq, true AS link_ok, s_suppkey <> 10 AS hash_ok FROM supplier",
    "audit_summary": "SELECT count(*) AS total_entries, true AS chain_valid, 'valid' AS status FROM supplier",
    "archive_integrity": "SELECT doc_id || '/' || left(h, 2) || '/' || substr(h, 3, 2) || '/' || h AS path FROM (SELECT doc_id, sha256('other') AS h FROM documents WHERE doc_id % 100 = 0)",
    "sources_by_tier": "SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, count(*) AS n, count(DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS hosts FROM pages GROUP BY 1",
}


_SUBM = "m AS (SELECT o_orderkey AS submission_id, o_custkey AS contributor, CASE o_orderstatus WHEN 'O' THEN 'Pending' WHEN 'F' THEN 'Approved' ELSE 'Rejected' END AS status, o_orderdate AS submitted_at FROM orders)"
ORACLES |= {
    "submissions_pending": f"WITH {_SUBM} SELECT submission_id, contributor, submitted_at FROM m WHERE status = 'Pending' ORDER BY submitted_at, submission_id LIMIT 50",
    "submissions_by_contributor": f"WITH {_SUBM} SELECT * FROM m WHERE contributor = 7",
    "submissions_by_status": f"WITH {_SUBM} SELECT status, count(*) AS n FROM m GROUP BY 1",
    "review_counts": """SELECT user_id % 10 AS reviewer, CASE event_type WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'reject' WHEN 'click' THEN 'dispute' ELSE 'withdraw' END AS action, count(*) AS n, count(DISTINCT event_id % 997) AS submissions FROM events GROUP BY ALL""",
    "current_subscriptions": "SELECT user_id AS subscriber, event_id % 7 AS entity_id FROM events GROUP BY ALL HAVING arg_max(event_type, event_id) <> 'click'",
    "alerts_unread": ORACLES["watch_alerts"] + " AND seq % 3 <> 0",
    "alerts_digest": f"SELECT subscriber, count(*) AS n FROM ({ORACLES['watch_alerts']}) WHERE sub_id % 2 = 0 GROUP BY 1",
    "evidence_lines": f"""WITH {_VER} SELECT source_id, CASE kind WHEN 'filing' THEN CASE WHEN found THEN 'Filing found' ELSE 'Filing not found' END WHEN 'url' THEN CASE WHEN live THEN 'URL is live' ELSE 'URL is not reachable' END || CASE WHEN archived THEN '; archived copy exists' ELSE '; no archived copy' END
  WHEN 'sanctions' THEN CASE WHEN found THEN 'Name found on a list' ELSE 'Name not on any list' END ELSE 'Not applicable' END AS evidence FROM v""",
    "filing_answers": f"SELECT id, found, filing_name, CAST(filing_date AS DATE) AS filing_date FROM {_values([(True, 'Forward', '2024-05-06'), (False, None, None), (False, None, None), (True, 'Back', None)], 'found, filing_name, filing_date')}",
    "source_chains": "SELECT o_orderkey AS entity_id, CAST(count(l_orderkey) + 1 AS INTEGER) AS source_count, concat_ws(' ', 'o/' || o_orderkey, string_agg('l/' || l_linenumber, ' ' ORDER BY l_linenumber)) AS urls FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "endpoint_checks": f"WITH {_REL} SELECT rel_type, count(*) AS n FROM rel WHERE CAST(substr(src, 2) AS BIGINT) % 3 <> 0 GROUP BY 1",
    "audit_by_entity": "SELECT s_suppkey AS seq, 'Create' AS operation, md5('O3') AS entity_id FROM supplier WHERE s_suppkey = 3",
    "merkle_check": """WITH d AS (SELECT doc_id, sha256(text) AS own FROM documents), bad AS (SELECT * FROM d WHERE doc_id % 50 = 0)
SELECT 'd' || doc_id AS id FROM bad UNION SELECT 'p' || (doc_id // 10) FROM bad WHERE own NOT IN (SELECT own FROM d WHERE doc_id % 50 <> 0)""",
    "pardon_days": f"WITH {_PAIRS} SELECT entity_id, event_a_id, min(days_between) AS days_indictment_to_pardon FROM corr WHERE correlation_type = 'IndictmentToPardon' GROUP BY ALL",
    "search_documents": f"WITH {_DOCS} SELECT entity_id, entity_type, name, CAST(len(tc) AS INTEGER) AS words, CAST(epoch(date) AS BIGINT) AS date_seconds FROM tok",
}


def _found(pattern: str) -> str:
    inline = _values([(x,) for x in X.PASSAGES], "t")
    return f"WITH c AS (SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT id, t FROM {inline}) SELECT id, array_to_string(regexp_extract_all(t, {_q(pattern)}), '|') AS found FROM c WHERE len(regexp_extract_all(t, {_q(pattern)})) > 0"


ORACLES |= {
    "creation_checks": """SELECT c_custkey AS entity_id, CASE WHEN c_custkey % 4 = 0 THEN 'no source' WHEN c_custkey % 3 < 2 AND c_custkey % 5 = 0 THEN 'empty name' WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 'invalid URL' END AS error FROM customer""",
    "submission_checks": """SELECT o_orderkey AS seq, 'order ' || o_orderkey AS description, CASE WHEN o_orderkey % 17 > 0 AND o_orderkey % 19 = 0 THEN 'empty url' WHEN o_orderkey % 23 = 0 THEN 'empty reference' WHEN o_orderkey % 17 = 0 THEN 'invalid url'
  WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 THEN 'empty entity_type' WHEN o_orderkey % 4 = 2 AND o_orderkey % 7 = 0 THEN 'empty current_value' WHEN o_orderkey % 4 = 3 AND o_orderkey % 5 = 0 THEN 'empty documented_consequence'
  WHEN o_orderkey % 4 = 3 AND o_orderkey % 3 = 0 THEN 'invalid consequence_source_url' END AS error FROM orders""",
    "limiter_windows": """WITH RECURSIVE o AS (SELECT user_id AS key, event_id AS seq, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w(key, k, begun, n, accepted, retry_after) AS (SELECT key, 0::BIGINT, TIMESTAMP '1900-01-01', 0, false, NULL::BIGINT FROM o WHERE k = 1 UNION ALL
  SELECT key, k, b, CASE WHEN c < 3 THEN c + 1 ELSE c END, c < 3, CASE WHEN c >= 3 THEN greatest((43200000000 - (epoch_us(ts) - epoch_us(b))) // 1000000, 1) END
  FROM (SELECT o.key, o.k, o.ts, CASE WHEN o.ts >= begun + INTERVAL 12 HOUR THEN o.ts ELSE begun END AS b, CASE WHEN o.ts >= begun + INTERVAL 12 HOUR THEN 0 ELSE n END AS c FROM w JOIN o ON o.key = w.key AND o.k = w.k + 1))
SELECT o.key, o.seq, accepted, retry_after FROM w JOIN o USING (key, k)""",
    "url_liveness": """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 200 WHEN o_orderkey % 7 = 0 THEN 504 WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 404 ELSE 204 END AS status_code FROM orders)
SELECT id, status_code BETWEEN 200 AND 299 AS is_live, CAST(status_code AS INTEGER) AS status_code, id % 4 > 0 AND id % 3 = 0 AS archive_available, CASE WHEN id % 4 > 0 AND id % 3 = 0 THEN 'http://w/' || id END AS archive_url FROM t""",
    "batch_verify": """WITH t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'filing' WHEN o_orderkey % 2 = 0 THEN 'not_applicable' ELSE 'url' END AS kind FROM orders),
c AS (SELECT *, CASE kind WHEN 'filing' THEN id % 3 > 0 WHEN 'url' THEN id % 5 > 0 ELSE true END AS answered, CASE kind WHEN 'filing' THEN CASE WHEN id % 8 = 0 THEN 1.0 ELSE 0.0 END
  WHEN 'url' THEN CASE WHEN id % 3 = 0 AND id % 7 = 0 THEN 1.0 WHEN id % 3 = 0 THEN 0.85 WHEN id % 7 = 0 THEN 0.5 ELSE 0.0 END ELSE 0.0 END AS conf FROM t)
SELECT id AS source_id, kind, CASE WHEN answered THEN CAST(conf AS DOUBLE) END AS confidence, CASE WHEN answered THEN CASE WHEN conf >= 0.85 THEN 'High' WHEN conf >= 0.6 THEN 'Medium' WHEN conf >= 0.3 THEN 'Low' ELSE 'Unverified' END END AS level,
  CASE WHEN answered THEN CASE kind WHEN 'filing' THEN CASE WHEN id % 8 = 0 THEN 'Filing found' ELSE 'Filing not found' END WHEN 'url' THEN CASE WHEN id % 3 = 0 THEN 'URL is live' ELSE 'URL is not reachable' END || CASE WHEN id % 7 = 0 THEN '; archived copy exists' ELSE '; no archived copy' END ELSE 'Not applicable' END END AS evidence,
  CASE WHEN NOT answered THEN 'no answer' END AS error FROM c""",
    "content_summaries": "SELECT doc_id AS id, 'text' AS extractor, CAST(NULL AS VARCHAR) AS title, CAST(strlen(coalesce(text, '')) AS BIGINT) AS text_length, 0::BIGINT AS page_count, 0::BIGINT AS table_count FROM documents",
    "tier_rights": f"WITH {_REP} SELECT contributor, tier, CASE tier WHEN 'New' THEN 5 WHEN 'Established' THEN 15 ELSE 30 END AS per_hour, tier = 'Trusted' AS expedited FROM prof",
    "review_notes": "SELECT o_orderkey AS submission_id, o_orderpriority || ': order ' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN chr(10) || chr(10) || 'DISPUTE: see file' ELSE '' END AS note FROM orders",
    "watch_subscriptions": f"WITH {_ENT} SELECT event_id AS sub_id, entity_id, name AS entity_name, CASE WHEN event_id % 2 = 0 THEN 'NewDocument' ELSE 'EntityUpdate,NewRelationship,NewCorrelation,NewDocument' END AS notify_on, ts AS subscribed_at FROM events JOIN entities ON entity_id = 'P' || user_id WHERE event_id % 9 > 0",
    "display_texts": "SELECT p_partkey, 'b' || p_name || '/b' AS text, CASE WHEN p_partkey % 3 = 1 THEN epoch_ms(CAST(DATE '2020-01-01' + CAST(p_partkey % 900 AS INTEGER) AS TIMESTAMP)) ELSE 0 END AS sort_ms FROM part",
    "committee_detail": "SELECT * FROM (VALUES ('https://r/committee/C1/', 'Forward', 'T. Lee', 'Q'), ('https://r/committee/C3/', '', NULL, NULL)) AS t(url, name, treasurer_name, filing_frequency)",
    "bill_detail": """SELECT url, title, congress, bill_type, bill_number, CAST(introduced AS DATE) AS introduced_date, latest_action, policy_area FROM (VALUES ('https://r/bill/118/hr/21', 'Roads', 117, 'S', '9', '2023-01-02', 'Passed', 'Transport'), ('https://r/bill/118/hr/22', '', 118, 'hr', '22', NULL, NULL, NULL))
AS t(url, title, congress, bill_type, bill_number, introduced, latest_action, policy_area)""",
    "story_package": f"""WITH {_ENT}, {_REL}, l AS ((SELECT * FROM rel WHERE src = 'P7' ORDER BY created_at DESC, rel_id LIMIT 500) UNION ALL (SELECT * FROM rel WHERE dst = 'P7' ORDER BY created_at DESC, rel_id LIMIT 500)),
g AS (SELECT * FROM entities WHERE entity_id IN (SELECT CASE WHEN src = 'P7' THEN dst ELSE src END FROM l))
SELECT 'entity' AS part, count(*) AS n, min(entity_id) AS first_key, max(entity_id) AS last_key FROM entities WHERE entity_id = 'P7' UNION ALL SELECT 'relationships', count(*), min(rel_id), max(rel_id) FROM l
UNION ALL SELECT 'timeline', count(*), min(rel_id), max(rel_id) FROM l UNION ALL SELECT 'graph', count(*), min(entity_id), max(entity_id) FROM g""",
    "search_index": ORACLES["search_bm25"],
    "missing_fields": """SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 2 = 0 THEN 'Person' ELSE 'Organization' END AS entity_type, 'name' AS field FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 'Organization', 'org_type' FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 3 > 0""",
}


# pages without a table in a table, an anchor in an anchor or a comment inside a text: there, patterns find what a parser does
_HTML = "h AS (SELECT page_id, html FROM pages UNION ALL SELECT id, html FROM {rows})"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_PLAIN = "replace(replace(replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


def _plain(x: str) -> str:
    return _STRIP.format(x=_PLAIN.format(x=x))


def _pages() -> None:
    h = _HTML.format(rows=_values([(x,) for x in X.PAGES], "html"))
    gone = r"regexp_replace(html, '(?is)<title[^>]*>.*?</title>|<script.*?</script>|<style.*?</style>|<!--.*?-->', '<>', 'g')"
    ORACLES["html_links"] = rf"""WITH {h}, l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]+"[^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*href="[^"]+"[^>]*>.*?</a>'), 1) - 1 AS k FROM h)
SELECT page_id, CAST(k AS INTEGER) AS k, {_PLAIN.format(x="regexp_extract(a, '(?i)href=\"([^\"]+)\"', 1)")} AS href, {_plain("regexp_replace(a, '<[^>]*>', '', 'g')")} AS text FROM l"""
    ORACLES["html_text"] = rf"""WITH {h}, p AS (SELECT page_id, html, list_filter(list_transform(string_split_regex({gone}, '<[^>]*>'), lambda x: {_plain("x")}), lambda x: x <> '') AS parts FROM h)
SELECT page_id, nullif({_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '') AS title, nullif({_plain("regexp_extract(html, '(?i)<meta name=\"description\" content=\"([^\"]*)\"', 1)")}, '') AS description, nullif(array_to_string(parts, ' '), '') AS text FROM p"""
    cell = _plain("regexp_replace(c, '<[^>]*>', '', 'g')")
    ORACLES["html_tables"] = rf"""WITH {h}, t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1)) AS t, generate_subscripts(regexp_extract_all(html, '(?is)<table[^>]*>(.*?)</table>', 1), 1) AS n FROM h),
r AS (SELECT page_id, n, list_filter(list_transform(regexp_extract_all(t, '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: {cell})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM t),
f AS (SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY n) - 1 AS table_no, rows FROM r WHERE len(rows) > 0)
SELECT page_id, CAST(table_no AS INTEGER) AS table_no, CAST(row_no - 1 AS INTEGER) AS row_no, array_to_string(rows[row_no], '|') AS cells FROM (SELECT *, unnest(generate_series(1, len(rows))) AS row_no FROM f)"""
    found = [
        (-1, "person", "Sen. John Smith", 0), (-1, "person", "John Smith", 5), (-1, "amount", "$1,500", 25), (-1, "organization", "Acme Holdings LLC", 37), (-1, "date", "Jan. 15, 2024", 58), (-1, "filing", "FEC-2024-123", 78),
        (-2, "filing", "H.R. 123", 12), (-2, "filing", "S.Res. 34", 25), (-2, "date", "01/15/2024", 42), (-2, "amount", "$2.3 million", 54), (-2, "amount", "$500K", 71), (-2, "date", "Q1 2024", 91), (-2, "date", "FY 2024", 103),
        (-3, "person", "Mary Jones", 0), (-3, "person", "Robert Brown", 15), (-4, "filing", "24-cv-12345", 5), (-4, "organization", "Widget Corp.", 25), (-4, "person", "Dr. Anna Lee Moore", 44), (-4, "person", "Anna Lee Moore", 48),
    ]
    rows = ", ".join(f"({i}, '{k}', '{t}', {at})" for i, k, t, at in found)
    ORACLES["ner_passages"] = f"SELECT CAST(id AS BIGINT) AS id, kind, mention, CAST(place AS BIGINT) AS char_offset, CAST(place AS BIGINT) AS byte_offset FROM (VALUES {rows}) AS t(id, kind, mention, place)"


def _finish() -> None:
    from ..functions import ner

    ORACLES["ner_amounts"], ORACLES["ner_dates"], ORACLES["ner_filings"] = _found(ner.AMOUNT), _found(ner.DATE), _found(ner.FILING)
    ORACLES["name_keys"] = f"SELECT id, first, last FROM {_values(X.NAME_PARTS, 'first, last')}"
    landed = [
        ("Person", "DOE, JANE", "H2NY05168", "Democrat", None, None, 0), ("Person", "ROE, RAY", "S6TX00194", "Other", None, None, 0), ("Person", "POE, PAT", "P80003338", None, None, None, 0), ("Organization", "Forward", "C00000001", "SuperPac", None, None, 1),
        ("Person", "Ann", "t1", None, None, None, 2), ("Organization", "Forward", "C1", None, None, None, 2), ("Payment", "Ann to Forward", "t1", "IndividualContribution", 250.5, "2024-03-01", 2), ("Organization", "Forward", "C1", None, None, None, 3),
        ("Organization", "Printer", "t4", None, None, None, 3), ("Payment", "Forward to Printer", "t4", "PacContribution", 10.0, "2024-04-02", 3), ("Person", "Lee, Ann", "M1", "Democrat", None, None, 4), ("PolicyDecision", "Roads", "HR12", None, None, "2023-05-01", 5),
        ("PolicyDecision", "Parks", "S13", None, None, "2023-06-01", 5), ("PolicyDecision", "Ponds", "S14", None, None, "2024-01-01", 5), ("CourtCase", "77", "77", "Appellate", None, "2024-01-02", 6), ("CourtCase", "2:24", "2:24", "Criminal", None, None, 6), ("CourtCase", "opinion-5", "opinion-5", "SupremeCourt", None, "2023-04-05", 10), ("CourtCase", "unknown", "unknown", "Civil", None, None, 11), ("CourtCase", "K1", "K1", "Civil", None, "2022-02-02", 7),
    ]
    opinions = next(x for x in X.LANDED if x[0] == "opinions")
    page = lambda k: ("https://www.courtlistener.com/opinion/5/", json.dumps(opinions[2])) if k == 10 else (opinions[1], json.dumps(opinions[2])) if k == 11 else (X.LANDED[k][1], json.dumps(X.LANDED[k][2]))
    rows = [(*r[:6], *page(r[6])) for r in landed]
    ORACLES["landed_entities"] = f"SELECT entity_type, name, key, detail, CAST(amount AS DOUBLE) AS amount, CAST(date AS DATE) AS date, url, sha256(body) AS content_hash FROM {_values(rows, 'entity_type, name, key, detail, amount, date, url, body')}"


_finish()
_pages()
