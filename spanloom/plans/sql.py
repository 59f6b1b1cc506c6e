"""Shared WITH clauses of the queries' SQL."""

CTES = r"""
WITH k AS (SELECT *, (props ->> 'k')::INT AS k FROM events),
kd AS (SELECT *, CASE event_type WHEN 'signup' THEN 'turn_start' WHEN 'purchase' THEN 'turn_end' WHEN 'error' THEN 'abort'
    WHEN 'click' THEN CASE WHEN k % 7 = 0 THEN 'hook_start' WHEN k % 11 = 1 THEN 'skill_invoked' ELSE 'tool_start' END
    ELSE CASE WHEN k % 7 = 0 THEN 'hook_end' WHEN k % 5 = 1 THEN 'assistant_message' WHEN k % 13 = 2 THEN 'mode_changed' WHEN k % 13 = 3 THEN 'model_change' ELSE 'tool_complete' END END AS kind FROM k),
ev AS (SELECT user_id::VARCHAR AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id::VARCHAR AS event_id, ts, kind,
    CASE WHEN kind IN ('hook_start', 'hook_end') THEN 'hook' || (k % 3) WHEN kind = 'skill_invoked' THEN 'skill' || (k % 2) WHEN kind = 'tool_start' THEN CASE WHEN k % 2 = 0 THEN 'mcp__s' || (k % 3) || '__t' || (k % 4) WHEN k % 17 = 3 THEN 'ask_user' ELSE 'tool' || (k % 5) END END AS name,
    CASE WHEN kind = 'assistant_message' THEN CASE WHEN k % 3 = 2 THEN 'claude-haiku-4' ELSE 'gpt-5-m' || (k % 3) END END AS model, CASE WHEN kind = 'assistant_message' THEN k::BIGINT END AS output_tokens,
    CASE k % 3 WHEN 0 THEN 'plan' WHEN 1 THEN 'autopilot' ELSE 'interactive' END AS mode, event_id % 5 <> 0 AS success, CASE WHEN event_id % 5 = 0 THEN 'failed' END AS error_message FROM kd),
r1 AS (SELECT *, sum(CASE WHEN kind = 'tool_start' THEN 1 WHEN kind IN ('tool_complete', 'abort') THEN -1 ELSE 0 END) OVER w AS s FROM ev WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
r1b AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM r1),
r2 AS (SELECT * EXCLUDE (s, low), kind IN ('tool_complete', 'abort') AND s < low AS tool_orphan, CASE WHEN kind = 'tool_start' THEN s - least(low, s) WHEN kind IN ('tool_complete', 'abort') AND s >= low THEN s - least(low, s) + 1 END::BIGINT AS tool_level FROM r1b),
r3 AS (SELECT *, sum(CASE WHEN kind = 'hook_start' THEN 1 WHEN kind = 'hook_end' OR kind = 'abort' AND tool_orphan THEN -1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM r2),
r3b AS (SELECT *, least(0, coalesce(min(s) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low, kind = 'hook_end' OR kind = 'abort' AND tool_orphan AS hook_pop FROM r3),
r3c AS (SELECT * EXCLUDE (s, low), hook_pop AND s < low AS hook_orphan, CASE WHEN kind = 'hook_start' THEN s - least(low, s) WHEN hook_pop AND s >= low THEN s - least(low, s) + 1 END AS hook_level FROM r3b),
r3d AS (SELECT *, max(CASE WHEN kind IN ('turn_start', 'turn_end') OR kind = 'abort' AND tool_orphan AND hook_orphan THEN seq END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS slot_seq,
    count(CASE WHEN kind = 'mode_changed' THEN 1 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS mode_no, max(seq) OVER (PARTITION BY session_id) AS last_seq, arg_max(ts, seq) OVER (PARTITION BY session_id) AS last_ts FROM r3c),
r4 AS (SELECT a.*, CASE WHEN b.kind = 'turn_start' THEN b.seq END AS turn_seq, CASE WHEN b.kind = 'turn_start' THEN b.event_id END AS turn_id,
    CASE WHEN a.kind = 'abort' THEN CASE WHEN NOT a.tool_orphan THEN 'tool' WHEN NOT a.hook_orphan THEN 'hook' WHEN b.kind = 'turn_start' THEN 'turn' ELSE 'session' END END AS route,
    coalesce(max(CASE WHEN a.kind = 'mode_changed' THEN a.mode END) OVER (PARTITION BY a.session_id, a.mode_no), 'interactive') AS mode_now
    FROM r3d a LEFT JOIN ev b ON a.session_id = b.session_id AND a.slot_seq = b.seq),
tp AS (SELECT *, lead(kind) OVER p AS e_kind, lead(seq) OVER p AS e_seq, lead(ts) OVER p AS e_ts, lead(success) OVER p AS e_ok, lead(error_message) OVER p AS e_error FROM r4 WHERE tool_level IS NOT NULL WINDOW p AS (PARTITION BY session_id, tool_level ORDER BY seq)),
c0 AS (SELECT session_id, name, seq AS start_seq, e_seq AS commit_seq, ts AS started_at, greatest(ts, coalesce(e_ts, last_ts)) AS ended_at,
      CASE WHEN e_seq IS NULL THEN 'open_at_end' WHEN e_kind = 'abort' OR NOT e_ok THEN 'failure' ELSE 'success' END AS status, CASE WHEN e_kind = 'abort' THEN 'aborted' WHEN NOT e_ok THEN e_error END AS error_message, turn_seq, turn_id FROM tp WHERE kind = 'tool_start'
    UNION ALL SELECT session_id, '<orphan>', seq, seq, ts, ts, 'orphan', NULL, turn_seq, turn_id FROM r4 WHERE kind = 'tool_complete' AND tool_orphan),
calls AS (SELECT *, (epoch_us(ended_at) - epoch_us(started_at)) // 1000 AS duration_ms, row_number() OVER (PARTITION BY session_id, name ORDER BY commit_seq NULLS LAST, start_seq) - 1 AS call_index FROM c0),
hp AS (SELECT *, lead(kind) OVER p AS e_kind, lead(seq) OVER p AS e_seq, lead(ts) OVER p AS e_ts, lead(success) OVER p AS e_ok FROM r4 WHERE hook_level IS NOT NULL WINDOW p AS (PARTITION BY session_id, hook_level ORDER BY seq)),
h0 AS (SELECT session_id, name, seq AS start_seq, e_seq AS commit_seq, ts AS started_at, greatest(ts, coalesce(e_ts, last_ts)) AS ended_at, CASE WHEN e_kind = 'abort' THEN false ELSE coalesce(e_ok, true) END AS success, false AS synthesized, turn_seq FROM hp WHERE kind = 'hook_start'
    UNION ALL SELECT session_id, name, seq, seq, ts, ts, success, true, turn_seq FROM r4 WHERE kind = 'hook_end' AND hook_orphan),
hooks AS (SELECT *, (epoch_us(ended_at) - epoch_us(started_at)) // 1000 AS duration_ms FROM h0),
ti AS (SELECT session_id, turn_seq, arg_max(model, seq) FILTER (kind = 'assistant_message') AS model, sum(output_tokens) FILTER (kind = 'assistant_message')::BIGINT AS output_tokens, max(ts) FILTER (kind = 'turn_end') AS end_ts, max(ts) FILTER (route = 'turn') AS abort_at FROM r4 WHERE turn_seq IS NOT NULL GROUP BY ALL),
turns AS (SELECT s.session_id, s.seq AS turn_seq, s.event_id AS turn_id, s.ts AS started_at, CASE WHEN coalesce(abort_at, end_ts) IS NOT NULL THEN greatest(s.ts, coalesce(abort_at, end_ts)) END AS ended_at,
      CASE WHEN abort_at IS NOT NULL THEN 'aborted' WHEN end_ts IS NOT NULL THEN 'completed' ELSE 'open' END AS status, ti.model, ti.output_tokens, mode_now AS mode, CASE WHEN abort_at IS NOT NULL THEN 'abort' END AS abort_reason
      FROM r4 s LEFT JOIN ti ON ti.session_id = s.session_id AND ti.turn_seq = s.seq WHERE s.kind = 'turn_start'
    UNION ALL SELECT session_id, seq, 'synthesized-' || event_id, ts, ts, 'completed', NULL, NULL, mode_now, NULL FROM r4 WHERE kind = 'turn_end' AND turn_seq IS NULL),
modes AS (SELECT m.session_id, m.seq, m.mode, m.ts AS started_at, greatest(m.ts, coalesce((SELECT min_by(n.ts, n.seq) FROM ev n WHERE n.session_id = m.session_id AND n.kind = 'mode_changed' AND n.seq > m.seq),
      (SELECT max_by(n.ts, n.seq) FROM ev n WHERE n.session_id = m.session_id AND n.kind = 'model_change' AND n.seq > m.seq), m.last_ts)) AS ended_at FROM r4 m WHERE m.kind = 'mode_changed'),
ends AS (SELECT session_id, ended_at FROM turns UNION ALL SELECT session_id, ended_at FROM calls UNION ALL SELECT session_id, ended_at FROM hooks UNION ALL SELECT session_id, ended_at FROM modes UNION ALL SELECT session_id, ts FROM ev WHERE kind = 'skill_invoked'),
walls AS (SELECT f.session_id, started_at, greatest(0, (epoch_us(coalesce(z, started_at)) - epoch_us(started_at)) // 1000) AS wall_ms FROM (SELECT session_id, arg_min(ts, seq) AS started_at FROM ev GROUP BY 1) f LEFT JOIN (SELECT session_id, max(ended_at) AS z FROM ends GROUP BY 1) e ON e.session_id = f.session_id)
"""

WASTE = r"""
WITH ot AS (SELECT o_orderkey::VARCHAR AS session_id, o_custkey, regexp_replace(p_brand, '[^A-Za-z0-9]', '-', 'g') AS server, regexp_replace(p_type, '[^A-Za-z0-9]', '-', 'g') AS tool, (l_quantity * 1000)::BIGINT AS duration_ms, l_returnflag <> 'R' AS ok
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
lt AS (SELECT session_id, server, tool, ascii(right(server, 1)) % 2 = 0 AS w, ascii(right(server, 1)) % 2 <> 0 OR length(tool) % 2 = 0 AS c FROM (SELECT DISTINCT o_custkey, session_id FROM ot) JOIN (SELECT DISTINCT o_custkey, server, tool FROM ot) USING (o_custkey)),
cc AS (SELECT session_id, server, tool, count(*) AS call_count FROM ot GROUP BY ALL),
wt AS (SELECT session_id, server, tool, CASE WHEN w AND c THEN 'both' WHEN w THEN 'wire' WHEN c THEN 'config' ELSE 'inferred' END AS origin, coalesce(call_count, 0) AS call_count, CASE WHEN server LIKE '%1' THEN length(tool) * 10 ELSE 200 END::BIGINT AS tokens FROM lt FULL JOIN cc USING (session_id, server, tool)),
ws AS (SELECT session_id, server, count(*) AS loaded, count_if(call_count > 0)::BIGINT AS called, count_if(call_count = 0)::BIGINT AS unused, sum(CASE WHEN call_count = 0 THEN tokens ELSE 0 END)::BIGINT AS unused_tokens FROM wt GROUP BY ALL)
"""

FLAME = CTES.replace("WITH", "WITH RECURSIVE", 1) + r"""
, bd AS (SELECT session_id, arg_min(ts, seq) AS zero, arg_max(ts, seq) AS fin FROM ev GROUP BY 1),
tn AS (SELECT t.*, row_number() OVER w AS ordinal, lead(t.started_at) OVER w AS nxt, zero, fin FROM turns t JOIN bd USING (session_id) WINDOW w AS (PARTITION BY t.session_id ORDER BY turn_seq)),
tr AS (SELECT session_id, turn_seq, ordinal, 'turn-' || ordinal || CASE WHEN ended_at IS NULL THEN ' (open)' ELSE '' END AS name, greatest(0, (epoch_us(started_at) - epoch_us(zero)) // 1000) AS a,
    greatest(0, (epoch_us(coalesce(ended_at, least(fin, nxt))) - epoch_us(zero)) // 1000) AS z, greatest(0, (epoch_us(coalesce(ended_at, fin)) - epoch_us(zero)) // 1000) AS stop FROM tn),
kd0 AS (SELECT session_id, turn_seq, 1 AS part, start_seq AS seq, CASE WHEN name LIKE 'mcp\_\_%' ESCAPE '\' THEN 'mcp:' || regexp_extract(name, '^mcp__(.*?)__(.*)$', 1) || '::' || regexp_extract(name, '^mcp__(.*?)__(.*)$', 2) ELSE name END AS name, started_at, ended_at FROM calls
    UNION ALL SELECT session_id, turn_seq, 2, start_seq, 'hook:' || name, started_at, ended_at FROM hooks WHERE turn_seq IS NOT NULL
    UNION ALL SELECT session_id, turn_seq, 3, seq, 'skill:' || name, ts, ts FROM r4 WHERE kind = 'skill_invoked' AND turn_seq IS NOT NULL),
kids AS (SELECT k.session_id, ordinal, k.name, t.a AS first, stop, greatest(0, (epoch_us(started_at) - epoch_us(zero)) // 1000) AS a, greatest(0, (epoch_us(ended_at) - epoch_us(zero)) // 1000) AS z, part, seq
    FROM kd0 k JOIN bd USING (session_id) LEFT JOIN tr t ON t.session_id = k.session_id AND t.turn_seq = k.turn_seq WHERE k.turn_seq IS NULL OR ordinal IS NOT NULL),
nk AS (SELECT *, row_number() OVER (PARTITION BY session_id, ordinal ORDER BY a, part, seq) AS n FROM kids WHERE ordinal IS NOT NULL),
f1 AS (SELECT session_id, ordinal, name, n, a AS b, greatest(least(z, stop), a) AS e FROM nk WHERE n = 1 AND a >= first
    UNION ALL SELECT session_id, ordinal, name, n, first + 1, greatest(least(greatest(z, first + 2), stop), first + 1) FROM nk WHERE n = 1 AND a < first
    UNION ALL SELECT k.session_id, k.ordinal, k.name, k.n, CASE WHEN k.a < f.e THEN f.e + 1 ELSE k.a END, greatest(least(CASE WHEN k.a < f.e THEN greatest(k.z, f.e + 2) ELSE k.z END, k.stop), CASE WHEN k.a < f.e THEN f.e + 1 ELSE k.a END)
      FROM f1 f JOIN nk k ON k.session_id = f.session_id AND k.ordinal = f.ordinal AND k.n = f.n + 1),
tops AS (SELECT session_id, max(m) AS top FROM (SELECT session_id, greatest(a, z) AS m FROM tr UNION ALL SELECT session_id, greatest(b, e) FROM f1) GROUP BY 1),
ok AS (SELECT k.*, greatest(coalesce(top, 0), min(a) OVER (PARTITION BY k.session_id)) AS begin_, row_number() OVER (PARTITION BY k.session_id ORDER BY a, part, seq) AS n, count(*) OVER (PARTITION BY k.session_id) AS c FROM kids k LEFT JOIN tops USING (session_id) WHERE ordinal IS NULL),
f2 AS (SELECT session_id, name, n, c, z, begin_, CASE WHEN a < begin_ THEN begin_ + 1 ELSE a END AS b, CASE WHEN a < begin_ THEN greatest(z, begin_ + 2) ELSE greatest(z, a) END AS e FROM ok WHERE n = 1
    UNION ALL SELECT k.session_id, k.name, k.n, k.c, k.z, k.begin_, CASE WHEN k.a < f.e THEN f.e + 1 ELSE k.a END, CASE WHEN k.a < f.e THEN greatest(k.z, f.e + 2) ELSE greatest(k.z, k.a) END FROM f2 f JOIN ok k ON k.session_id = f.session_id AND k.n = f.n + 1),
sp AS (SELECT session_id, ordinal, 0 AS depth, name, a AS open_ms, z AS close_ms FROM tr UNION ALL SELECT session_id, ordinal, 1, name, b, e FROM f1
    UNION ALL SELECT session_id, 1099511627776, 1, name, b, e FROM f2 UNION ALL SELECT session_id, 1099511627776, 0, 'turn-orphan', begin_, greatest(begin_, z, e) FROM f2 WHERE n = c)
SELECT session_id, ordinal::BIGINT AS ordinal, depth::INT AS depth, name, type, CASE type WHEN 'O' THEN open_ms ELSE close_ms END::BIGINT AS at FROM sp, (VALUES ('O'), ('C')) v(type)
"""
