"""Queries by their number in the survey, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.percentiles import ceiling_rank
from ..operators import audit, episodes, flame, ranks, redact, waste
from ..operators.bundle import Episodes
from ..sources import folders, sessionstore, store
from ..streaming import exports, rollups, telemetry
from . import inputs
from .sql import CTES, FLAME, WASTE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = CTES):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = ctes + sql
        return f

    return add


def on_episodes(sql: str | None = None, ctes: str = CTES):
    def add(f: Callable[[Episodes], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Episodes(inputs.events(spark, sf_dir)))
            # instants go out as they came in, without a zone
            return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in out.dtypes if kind == "timestamp"})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return query(sql, ctes)(run)

    return add


@on_episodes("SELECT session_id, name, start_seq, commit_seq, status, error_message, duration_ms FROM calls")
def D2_tool_calls(e):
    return e.calls.select("session_id", "name", "start_seq", "commit_seq", "status", "error_message", "duration_ms")


@on_episodes("SELECT session_id, name, start_seq, commit_seq, success, synthesized, duration_ms FROM hooks")
def D3_hook_calls(e):
    return e.hooks.select("session_id", "name", "start_seq", "commit_seq", "success", "synthesized", "duration_ms")


@on_episodes("SELECT session_id, seq, route FROM r4 WHERE kind = 'abort'")
def D4_abort_routes(e):
    return e.rows.where("kind = 'abort'").select("session_id", "seq", F.col("abort_route").alias("route"))


@on_episodes("SELECT session_id, start_seq, turn_seq, turn_id FROM calls")
def D5_turn_of_call(e):
    return e.calls.select("session_id", "start_seq", "turn_seq", "turn_id")


@on_episodes("""SELECT s.session_id, s.name AS skill, s.seq AS skill_seq, c.name, c.call_index FROM r4 s JOIN calls c USING (session_id)
 WHERE s.kind = 'skill_invoked' AND (c.commit_seq BETWEEN s.seq + 1 AND s.seq + 49 OR c.commit_seq IS NULL AND s.last_seq - s.seq <= 48)""")
def D7_skill_triggered(e):
    return episodes.skill_triggered(e.rows, e.calls)


@on_episodes("SELECT session_id, turn_id, status, model, output_tokens, mode, abort_reason FROM turns")
def E1_turns(e):
    return e.turns.select("session_id", "turn_id", "status", "model", "output_tokens", "mode", "abort_reason")


@on_episodes("""SELECT t.session_id, t.turn_id, t.status, t.model, t.output_tokens, t.mode, (epoch_us(t.ended_at) - epoch_us(t.started_at)) // 1000 AS duration_ms, coalesce(c.n, 0) AS tools, coalesce(h.n, 0) AS hooks, coalesce(s.n, 0) AS skills
 FROM turns t LEFT JOIN (SELECT session_id, turn_seq, count(*) AS n FROM calls GROUP BY ALL) c USING (session_id, turn_seq) LEFT JOIN (SELECT session_id, turn_seq, count(*) AS n FROM hooks GROUP BY ALL) h USING (session_id, turn_seq)
 LEFT JOIN (SELECT session_id, turn_seq, count(*) AS n FROM r4 WHERE kind = 'skill_invoked' GROUP BY ALL) s USING (session_id, turn_seq)""")
def E2_turn_summary(e):
    return ranks.turn_summary(e.turns, e.calls, e.hooks, e.skills)


_P = "list_sort(list(duration_ms))[round({p} * (count(*) - 1))::BIGINT + 1] AS {n}"
_P50, _P95 = _P.format(p="0.5::DOUBLE", n="p50"), _P.format(p="0.95::DOUBLE", n="p95")


_RANK = f"""SELECT session_id, name, count(*) AS calls, count_if(status = 'success')::BIGINT AS ok, count_if(status = 'failure')::BIGINT AS fail, count_if(status IN ('orphan', 'open_at_end'))::BIGINT AS orphan, 0::BIGINT AS user_requested,
 sum(duration_ms)::BIGINT AS total_ms, max(duration_ms) AS max_ms, {_P50}, {_P95} FROM calls GROUP BY session_id, name"""


@on_episodes(_RANK)
def E3_tool_rank(e):
    return ranks.tool_rank(e.calls)


@on_episodes(f"SELECT session_id, name, count(*) AS calls, count_if(success)::BIGINT AS ok, count_if(NOT success)::BIGINT AS fail, count_if(synthesized)::BIGINT AS synthesized, sum(duration_ms)::BIGINT AS total_ms, {_P50}, {_P95} FROM hooks GROUP BY session_id, name")
def E4_hook_rank(e):
    return ranks.hook_rank(e.hooks)


_SOURCE = "CASE WHEN regexp_matches(name, '^mcp__.*?__') THEN 'mcp' WHEN regexp_matches(name, '^skill__.*?__') THEN 'skill' ELSE 'builtin' END"
_NAME = "regexp_extract(name, '^mcp__(.*?)__', 1)"
_BY_TOOL = f"SELECT name, {_SOURCE} AS source_kind, {_NAME} AS source_name, count(*) AS calls, count_if(status = 'success')::BIGINT AS ok, count_if(status = 'failure')::BIGINT AS fail, sum(duration_ms)::BIGINT AS total_ms, count(DISTINCT session_id) AS sessions, {_P50}, {_P95} FROM calls GROUP BY name"


@on_episodes(_BY_TOOL)
def E11_by_tool(e):
    return ranks.by_tool(e.calls)


@on_episodes("SELECT session_id, started_at, wall_ms FROM walls")
def E15_session_wall(e):
    return e.walls


@on_episodes("SELECT count(*) AS sessions, coalesce(sum(wall_ms), 0)::BIGINT AS total_wall_ms FROM walls")
def E16_header(e):
    return ranks.header(e.walls)


_BY_DAY = """SELECT CAST(started_at AS DATE) AS day, count(*) AS sessions, sum(wall_ms)::BIGINT AS wall_ms, coalesce(sum(t), 0)::BIGINT AS tool_ms, coalesce(sum(k), 0)::BIGINT AS output_tokens,
 CASE WHEN sum(wall_ms) > 0 THEN least(100.0::DOUBLE, 100.0::DOUBLE * coalesce(sum(t), 0)::DOUBLE / sum(wall_ms)::DOUBLE) ELSE 0 END::FLOAT AS utilisation,
 CASE WHEN sum(wall_ms) > 0 THEN least(100.0::DOUBLE, 100.0::DOUBLE * coalesce(sum(t), 0)::DOUBLE / sum(wall_ms)::DOUBLE) ELSE 0 END::FLOAT < 20::FLOAT AS low
 FROM walls LEFT JOIN (SELECT session_id, sum(duration_ms) AS t FROM calls GROUP BY 1) USING (session_id) LEFT JOIN (SELECT session_id, sum(output_tokens) AS k FROM turns GROUP BY 1) USING (session_id) GROUP BY 1"""


@on_episodes(_BY_DAY)
def E13_by_day(e):
    return ranks.by_day(e.walls, e.calls, e.turns)


@on_episodes("""SELECT f.model, count(*) AS sessions, sum(n)::BIGINT AS turns, coalesce(sum(k), 0)::BIGINT AS output_tokens, sum(wall_ms)::BIGINT AS wall_ms FROM
 (SELECT session_id, arg_min(struct_pack(m := model), turn_seq).m AS model, count(*) AS n, sum(output_tokens) AS k FROM turns GROUP BY 1) f JOIN walls USING (session_id) WHERE f.model IS NOT NULL GROUP BY 1""")
def E14_by_model(e):
    return ranks.by_model(e.walls, e.turns)


@on_episodes("""SELECT session_id, mode, count(*) AS turns, coalesce(sum((epoch_us(ended_at) - epoch_us(started_at)) // 1000), 0)::BIGINT AS duration_ms, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(n), 0)::BIGINT AS tool_calls
 FROM turns LEFT JOIN (SELECT session_id, turn_seq, count(*) AS n FROM calls GROUP BY ALL) USING (session_id, turn_seq) GROUP BY 1, 2""")
def E25_by_mode(e):
    return ranks.by_mode(e.turns, e.calls)


@on_episodes("""SELECT w.session_id, w.started_at, t.model, coalesce(t.turns, 0) AS turns, coalesce(t.k, 0)::BIGINT AS output_tokens, span_ms FROM walls w LEFT JOIN
 (SELECT session_id, arg_min(model, turn_seq) FILTER (model IS NOT NULL) AS model, count(*) AS turns, sum(output_tokens) AS k, (epoch_us(max(started_at)) - epoch_us(min(started_at))) // 1000 AS span_ms FROM turns GROUP BY 1) t USING (session_id)""")
def E27_session_list(e):
    return ranks.session_list(e.turns, e.walls)


@on_episodes("SELECT session_id, model, turns, output_tokens FROM (SELECT session_id, started_at FROM walls ORDER BY started_at DESC, session_id LIMIT 20) LEFT JOIN (SELECT session_id, arg_min(model, turn_seq) FILTER (model IS NOT NULL) AS model, count(*) AS turns, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM turns GROUP BY 1) USING (session_id)")
def G1_latest_sessions(e):
    """Top-k: the 20 latest sessions."""
    return ranks.session_list(e.turns, e.walls).orderBy(F.desc("started_at"), "session_id").limit(20).select("session_id", "model", "turns", "output_tokens")


@on_episodes("""SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN ts < lag_ts THEN 'non_monotonic' END, CASE WHEN kind = 'tool_complete' AND tool_orphan THEN 'orphan_tool' END, CASE WHEN kind = 'hook_end' AND hook_orphan THEN 'orphan_hook' END,
 CASE WHEN kind = 'turn_end' AND turn_seq IS NULL THEN 'orphan_turn_end' END, CASE WHEN route = 'session' THEN 'session_abort' END], lambda x: x IS NOT NULL)) AS kind FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY seq) AS lag_ts FROM r4)) GROUP BY 1""")
def E30_warning_counts(e):
    return episodes.warnings(e.rows).groupBy("kind").agg(F.count("*").alias("n"))


@on_episodes("""SELECT pair, starts, ends, starts - ends AS delta, CASE WHEN abs(starts - ends) / greatest(starts, ends) < 0.05 THEN 'ok' WHEN abs(starts - ends) / greatest(starts, ends) < 0.2 THEN 'minor' ELSE 'severe' END AS class FROM
 (SELECT CASE WHEN kind LIKE 'turn%' THEN 'turn' WHEN kind LIKE 'tool%' THEN 'tool' ELSE 'hook' END AS pair, count_if(kind LIKE '%start')::BIGINT AS starts, count_if(kind NOT LIKE '%start')::BIGINT AS ends FROM ev WHERE kind IN ('turn_start', 'turn_end', 'tool_start', 'tool_complete', 'hook_start', 'hook_end') GROUP BY 1)""")
def E32_balance(e):
    return audit.balance(e.events)


@on_episodes("SELECT kind, count(*) AS n, CASE WHEN kind IN ('mode_changed', 'model_change') THEN list_sort(list(event_id ORDER BY ts, session_id, seq)[:2]) END AS samples FROM ev GROUP BY kind")
def E31_kind_counts(e):
    known = ("turn_start", "turn_end", "tool_start", "tool_complete", "hook_start", "hook_end", "abort", "skill_invoked", "assistant_message")
    return audit.kind_counts(e.events, known)


@on_episodes("""SELECT kind, count(*) AS n, array_to_string(list_slice(list(session_id || ':' || ref ORDER BY session_id, ref), 1, 3), ' ') AS locations FROM (SELECT session_id, event_id AS ref, unnest(list_filter([CASE WHEN ts < lag_ts THEN 'non_monotonic' END, CASE WHEN kind = 'tool_complete' AND tool_orphan THEN 'orphan_tool' END, CASE WHEN kind = 'hook_end' AND hook_orphan THEN 'orphan_hook' END,
 CASE WHEN kind = 'turn_end' AND turn_seq IS NULL THEN 'orphan_turn_end' END, CASE WHEN route = 'session' THEN 'session_abort' END], lambda x: x IS NOT NULL)) AS kind FROM (SELECT *, lag(ts) OVER (PARTITION BY session_id ORDER BY seq) AS lag_ts FROM r4)) GROUP BY 1""")
def E31_warning_locations(e):
    """Warnings by kind with the first three places of each."""
    return audit.warning_groups(episodes.warnings(e.rows)).withColumn("locations", F.array_join("locations", " "))


_IDS = CTES + """, id AS (SELECT event_id::VARCHAR AS event_id, 'c' || (props ->> 'k')::INT AS cid, props FROM events),
st AS (SELECT tp.session_id, tp.name, tp.seq AS s, e_seq AS c, cid FROM tp JOIN id USING (event_id) WHERE kind = 'tool_start'),
rq AS (SELECT DISTINCT session_id, coalesce(max(s) FILTER (s < m AND (c IS NULL OR c > m)), min(s) FILTER (s > m)) AS start_seq FROM (SELECT session_id, seq AS m, cid FROM ev JOIN id USING (event_id) WHERE kind = 'model_change') JOIN st USING (session_id, cid) GROUP BY session_id, m, cid HAVING start_seq IS NOT NULL) """


def _requested(e: Episodes) -> DataFrame:
    """Calls that a user asked for, where changes of the model stand for the marks."""
    marked = e.rows.withColumn("kind", F.when(F.col("kind") == "model_change", "tool_user_requested").otherwise(F.col("kind")))
    return episodes.user_requested(marked, e.calls)


@on_episodes("SELECT * FROM rq", _IDS)
def D6_user_requested(e):
    return _requested(e)


@on_episodes("SELECT session_id, name, count(*) AS calls, count(rq.start_seq) AS user_requested FROM calls LEFT JOIN rq USING (session_id, start_seq) GROUP BY 1, 2", _IDS)
def E3_requested_tools(e):
    """Tool ranks with the calls that a user asked for."""
    return ranks.tool_rank(e.calls, _requested(e)).select("session_id", "name", "calls", "user_requested")


_ARGUMENTS = """, ar AS (SELECT c.session_id, c.start_seq, a.props AS arguments FROM (SELECT x.session_id, x.s AS start_seq, coalesce(CASE WHEN b.kind <> 'abort' THEN i.cid END, x.cid) AS cid FROM st x LEFT JOIN ev b ON b.session_id = x.session_id AND b.seq = x.c LEFT JOIN id i ON i.event_id = b.event_id
 UNION ALL SELECT session_id, seq, cid FROM r4 JOIN id USING (event_id) WHERE kind = 'tool_complete' AND tool_orphan) c LEFT JOIN (SELECT session_id, cid, arg_min(props, seq) AS props FROM ev JOIN id USING (event_id) WHERE kind = 'assistant_message' GROUP BY ALL) a USING (session_id, cid)) """


def _first_arguments(e: Episodes) -> DataFrame:
    """Messages request the call of their own id, with their properties as arguments."""
    asked = e.rows.where("kind = 'assistant_message'").withColumn("tool_requests", F.array(F.struct("call_id", F.concat(F.lit('{"k": '), F.substring("call_id", 2, 20), F.lit("}")).alias("arguments"))))
    return episodes.first_arguments(asked)


@on_episodes("SELECT * FROM ar", _IDS + _ARGUMENTS)
def D1_arguments(e):
    """Each call's arguments by its first request."""
    return e.calls.select("session_id", "start_seq", "call_id").join(_first_arguments(e), ["session_id", "call_id"], "left").select("session_id", "start_seq", "arguments")


@on_episodes("SELECT session_id, turn_id, name, status, duration_ms, " + _SOURCE + " AS source, arguments[:80] AS preview FROM calls LEFT JOIN ar USING (session_id, start_seq) WHERE turn_seq IS NOT NULL", _IDS + _ARGUMENTS)
def E37_turn_detail(e):
    return ranks.turn_detail(e.calls, _first_arguments(e))


@on_episodes("SELECT *, CASE WHEN calls > 0 THEN floor(100 * ok / calls)::BIGINT END AS ok_pct, CASE WHEN sum(total_ms) OVER (PARTITION BY session_id) > 0 THEN floor(100 * total_ms / sum(total_ms) OVER (PARTITION BY session_id))::BIGINT END AS time_pct FROM (" + _RANK + ")")
def E34_percent_columns(e):
    return ranks.percent_columns(ranks.tool_rank(e.calls))


@on_episodes("SELECT session_id, seq, tool_level AS level, tool_orphan AS orphan FROM r4 WHERE kind IN ('tool_start', 'tool_complete', 'abort')")
def F3_stack_depth(e):
    return e.rows.where("kind in ('tool_start', 'tool_complete', 'abort')").select("session_id", "seq", F.col("tool_level").alias("level"), F.col("tool_orphan").alias("orphan"))


@on_episodes("SELECT session_id, greatest(1, coalesce(p, top, 1))::BIGINT AS scale_ms FROM (SELECT session_id, quantile_disc(ms, 0.95) FILTER (status = 'completed' AND NOT waits) AS p, max(ms) AS top FROM (SELECT session_id, status, (epoch_us(ended_at) - epoch_us(started_at)) // 1000 AS ms, coalesce(w, false) AS waits FROM turns LEFT JOIN (SELECT DISTINCT session_id, turn_seq, true AS w FROM calls WHERE name = 'ask_user') USING (session_id, turn_seq)) GROUP BY 1)")
def F6_flame_scale(e):
    return ranks.flame_scale(e.turns, e.calls)


@on_episodes("SELECT name, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95 FROM calls GROUP BY 1")
def F5_ceiling_percentiles(e):
    return ceiling_rank(e.calls, ["name"], "duration_ms", {"p50": 50, "p95": 95})


@on_episodes("SELECT session_id, seq, mode_now FROM r4")
def F7_current_mode(e):
    return e.rows.select("session_id", "seq", "mode_now")


@on_episodes("SELECT session_id, seq, mode, started_at, ended_at FROM modes")
def F8_mode_segments(e):
    return e.modes


@on_episodes("SELECT session_id, name, call_index, start_seq FROM calls")
def F9_call_index(e):
    return e.calls.select("session_id", "name", "call_index", "start_seq")


@on_episodes("SELECT session_id, name, call_index, status, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY session_id, name ORDER BY call_index DESC) AS r FROM calls) WHERE r <= 5")
def F11_recent_calls(e):
    return ranks.recent_calls(e.calls)


@on_episodes(" ", FLAME)
def F12_flame_events(e):
    """The SQL follows the same rule by recursion."""
    return flame.marks(flame.adjusted(e.bounds, e.turns, e.calls, e.hooks, e.skills))


@on_episodes("SELECT DISTINCT session_id, last_ts FROM r4")
def F13_last_event(e):
    return e.rows.select("session_id", "last_ts").distinct()


_ENDS = "(SELECT session_id, zero, greatest(zero, max(tm)) AS fin FROM (SELECT session_id, arg_min(ts, seq) AS zero FROM ev GROUP BY 1) LEFT JOIN (SELECT session_id, coalesce(ended_at, started_at) AS tm FROM turns UNION ALL SELECT session_id, ended_at FROM calls UNION ALL SELECT session_id, ended_at FROM hooks UNION ALL SELECT session_id, ts FROM ev WHERE kind = 'skill_invoked') USING (session_id) GROUP BY 1, 2)"
_PROFILES = FLAME[: FLAME.rindex("SELECT session_id, ordinal::BIGINT")].replace("(SELECT session_id, arg_min(ts, seq) AS zero, arg_max(ts, seq) AS fin FROM ev GROUP BY 1)", _ENDS) + """
, lf AS (SELECT session_id, CASE WHEN name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'mcp:' || regexp_extract(name, '^mcp__(.*?)__(.*)$', 1) || '::' || regexp_extract(name, '^mcp__(.*?)__(.*)$', 2) ELSE name END AS name FROM calls
    UNION SELECT session_id, 'hook:' || name FROM hooks UNION SELECT session_id, 'skill:' || name FROM ev WHERE kind = 'skill_invoked'),
fr AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY d, o, name) - 1 AS frame FROM (SELECT session_id, -1 AS d, 0 AS o, 'session' AS name FROM bd UNION ALL SELECT session_id, 0, ordinal, name FROM sp WHERE depth = 0 UNION ALL SELECT session_id, 1, 0, name FROM lf)),
mk AS (SELECT session_id, ordinal AS o, 0 AS p, 0 AS d, 'O' AS t, a AS tm, name FROM tr UNION ALL SELECT session_id, ordinal, 1099511627776, 0, 'C', z, name FROM tr
    UNION ALL SELECT session_id, ordinal, 2 * n, 1, 'O', b, name FROM f1 UNION ALL SELECT session_id, ordinal, 2 * n + 1, 1, 'C', e, name FROM f1
    UNION ALL SELECT session_id, 1099511627776, 2 * n, 1, 'O', b, name FROM f2 UNION ALL SELECT session_id, 1099511627776, 2 * n + 1, 1, 'C', e, name FROM f2
    UNION ALL SELECT session_id, 1099511627776, 0, 0, 'O', begin_, 'turn-orphan' FROM f2 WHERE n = c UNION ALL SELECT session_id, 1099511627776, 1099511627776, 0, 'C', greatest(begin_, z, e), 'turn-orphan' FROM f2 WHERE n = c)
"""


@on_episodes("""SELECT session_id, fs.frames, n_frames, m.marks, coalesce(n, 0) + 2 AS n_events, greatest(coalesce(top, 0), (epoch_us(fin) - epoch_us(zero)) // 1000)::BIGINT AS end_value FROM bd
 JOIN (SELECT session_id, string_agg(name, '|' ORDER BY frame) AS frames, count(*) AS n_frames FROM fr GROUP BY 1) fs USING (session_id)
 LEFT JOIN (SELECT session_id, count(*) AS n, max(tm) AS top, string_agg(t || frame || '@' || tm, ' ' ORDER BY mk.o, p) AS marks FROM mk JOIN fr USING (session_id, d, name) GROUP BY 1) m USING (session_id)""", _PROFILES)
def B11_profiles(e):
    """The parts of each session's profile: frames, inner marks with their frames, and the end."""
    made = flame.profiles(flame.session_ends(e.bounds, e.turns, e.calls, e.hooks, e.skills), e.turns, e.calls, e.hooks, e.skills)
    p = F.col("profile.profiles")[0]
    inner = F.slice(p["events"], F.lit(2), F.size(p["events"]) - 2)
    marks = F.array_join(F.transform(inner, lambda m: F.concat(m["type"], m["frame"].cast("string"), F.lit("@"), m["at"].cast("string"))), " ")
    frames = F.col("profile.shared.frames")
    return made.select("session_id", F.array_join(F.transform(frames, lambda x: x["name"]), "|").alias("frames"), F.size(frames).cast("long").alias("n_frames"), F.nullif(marks, F.lit("")).alias("marks"), F.size(p["events"]).cast("long").alias("n_events"), p["endValue"].alias("end_value"))


def _live(e: Episodes, spark: SparkSession) -> DataFrame:
    """Totals after three batches: the beginnings of all logs, then the whole logs of half the sessions, then those of the others."""
    live = rollups.LiveRollups(spark, folders.scratch(spark, "live-rollups"))
    half = F.col("session_id").cast("long") % 2
    live.refresh(e.events.where("seq < 40"), 0)
    live.refresh(e.events.where(half == 0), 1)
    live.refresh(e.events.where(half == 1), 2)
    return live.totals()


@on_episodes(_BY_TOOL)
def I9_live_by_tool(e):
    """E11 kept up to date over growing logs."""
    return rollups.by_tool(_live(e, e.events.sparkSession))


@on_episodes(_BY_DAY)
def I9_live_by_day(e):
    """E13 kept up to date over growing logs."""
    return rollups.by_day(_live(e, e.events.sparkSession))


_NOW = "TIMESTAMP '2024-02-01 00:00:00'"


@on_episodes(f"SELECT session_id, name, start_seq, name = 'ask_user' AS blocking, (epoch_us({_NOW}) - epoch_us(started_at)) // 1000 AS age_ms FROM calls WHERE status = 'open_at_end' AND (epoch_us({_NOW}) - epoch_us(started_at)) // 1000 >= CASE name WHEN 'ask_user' THEN 30000 ELSE 300000 END")
def C9_pending_calls(e):
    return ranks.pending(e.calls, F.to_timestamp(F.lit("2024-02-01 00:00:00")))


@on_episodes(f"""SELECT t.session_id, t.turn_id, CASE WHEN t.status = 'aborted' THEN 'aborted' WHEN coalesce(p, false) THEN 'pending' WHEN t.status = 'open' THEN 'open' WHEN p IS NULL THEN 'no_tools' ELSE 'normal' END AS class
 FROM turns t LEFT JOIN (SELECT session_id, turn_seq, bool_or(status = 'open_at_end' AND (epoch_us({_NOW}) - epoch_us(started_at)) // 1000 >= CASE name WHEN 'ask_user' THEN 30000 ELSE 300000 END) AS p FROM calls GROUP BY ALL) USING (session_id, turn_seq)""")
def C10_turn_class(e):
    return ranks.turn_class(e.turns, e.calls, ranks.pending(e.calls, F.to_timestamp(F.lit("2024-02-01 00:00:00"))))


@on_episodes("SELECT name, CASE WHEN fail / calls > 0.5 THEN 'high' WHEN fail > 0 AND calls >= 3 THEN 'medium' ELSE 'low' END AS severity FROM (" + _BY_TOOL + ")")
def C11_severity(e):
    return ranks.by_tool(e.calls).select("name", S.severity(F.col("calls"), F.col("fail")).alias("severity"))


@on_episodes("SELECT DISTINCT name, regexp_extract(name, '^mcp__(.*?)__(.*)$', 1) AS server, CASE WHEN name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN regexp_extract(name, '^mcp__(.*?)__(.*)$', 2) ELSE name END AS short, CASE WHEN name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'mcp:' || regexp_extract(name, '^mcp__(.*?)__(.*)$', 1) || '::' || regexp_extract(name, '^mcp__(.*?)__(.*)$', 2) ELSE name END AS display FROM calls")
def C5_tool_names(e):
    n = F.col("name")
    return e.calls.select("name").distinct().select("name", F.coalesce(S.split_full_name(n)["server"], F.lit("")).alias("server"), S.short_name(n).alias("short"), S.display_name(n).alias("display"))


@on_episodes("SELECT original, '<uuid-' || (row_number() OVER (ORDER BY place, original) - 1) || '>' AS pseudonym FROM (SELECT turn_id AS original, min(epoch_us(started_at)) AS place FROM turns GROUP BY 1)")
def F14_pseudonyms(e):
    return redact.pseudonyms(e.turns.select(F.col("turn_id").alias("id"), F.unix_micros("started_at").alias("place")), per_bucket=10**10)


@on_episodes("SELECT CASE WHEN name LIKE 'mcp\\_\\_%' ESCAPE '\\' THEN 'mcp__' || substr(sha256(regexp_extract(name, '^mcp__(.*?)__(.*)$', 1)), 1, 8) || '__' || regexp_extract(name, '^mcp__(.*?)__(.*)$', 2) ELSE name END AS name, count(*) AS calls FROM calls GROUP BY 1")
def H4_hashed_servers(e):
    return redact.redact_tools(e.calls.groupBy("name").agg(F.count("*").alias("calls")), anonymize=True)


@on_episodes("SELECT array_to_string(string_split(model, '-')[:2], '-') AS model, count(*) AS turns, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens FROM turns WHERE model IS NOT NULL GROUP BY 1")
def E33_consolidated_models(e):
    by_model = e.turns.where("model is not null").groupBy("model").agg(F.count("*").alias("turns"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))
    return redact.redact_rollup(by_model)


# Order tables: usage and waste.

_USAGE = """WITH u AS (SELECT o_orderkey::VARCHAR AS session_id, o_orderpriority AS model, CAST(o_orderdate AS DATE) AS day, floor(l_extendedprice)::BIGINT AS input_tokens, floor(l_quantity)::BIGINT AS output_tokens, floor(l_extendedprice * l_discount)::BIGINT AS cache_read, floor(l_extendedprice * l_tax)::BIGINT AS cache_write FROM lineitem JOIN orders ON l_orderkey = o_orderkey) """
_SUMS = "sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write"


def _metrics(by: str) -> str:
    return f"""SELECT *, input_tokens + output_tokens + cache_read + cache_write AS total, CASE WHEN cache_read + cache_write > 0 THEN CASE WHEN cache_read + input_tokens > 0 THEN cache_read / (cache_read + input_tokens) ELSE 0 END END AS naive,
 CASE WHEN cache_read + cache_write > 0 THEN cache_read / (cache_read + cache_write) END AS honest, CASE WHEN cache_read + cache_write > 0 THEN round(0.9::DOUBLE * cache_read)::BIGINT END AS gross, CASE WHEN cache_read + cache_write > 0 THEN round(0.9::DOUBLE * cache_read - 0.25::DOUBLE * cache_write)::BIGINT END AS net
 FROM (SELECT {by}, {_SUMS} FROM u GROUP BY ALL)"""


@query(_metrics("session_id, model"), _USAGE)
def E9_cache_metrics(spark, sf_dir):
    return ranks.model_usage(inputs.order_usage(spark, sf_dir), ["session_id", "model"])


@query(_metrics("model"), _USAGE)
def E10_cache_by_model(spark, sf_dir):
    return ranks.model_usage(inputs.order_usage(spark, sf_dir), ["model"])


@query(_metrics("day"), _USAGE)
def E10_cache_by_day(spark, sf_dir):
    return ranks.model_usage(inputs.order_usage(spark, sf_dir), ["day"])


@query("SELECT session_id, model, input_tokens + output_tokens + cache_read + cache_write AS total FROM (SELECT session_id, model, " + _SUMS + " FROM u GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY total DESC, model) = 1", _USAGE)
def E23_dominant_model(spark, sf_dir):
    return ranks.dominant_model(ranks.model_usage(inputs.order_usage(spark, sf_dir), ["session_id", "model"]))


@query("SELECT model, " + _SUMS + ", round(0.9::DOUBLE * sum(cache_read) - 0.25::DOUBLE * sum(cache_write))::BIGINT AS net_saved FROM u GROUP BY ROLLUP (model)", _USAGE)
def E26_model_table(spark, sf_dir):
    return ranks.model_table(inputs.order_usage(spark, sf_dir))


@query("SELECT * FROM wt", WASTE)
def D8_waste_tools(spark, sf_dir):
    return waste.shared_tools(*inputs.shared_tools(spark, sf_dir))


@query("SELECT session_id, server, loaded, called, unused, unused_tokens, called = 0 AS fully_unused FROM ws", WASTE)
def E18_waste_servers(spark, sf_dir):
    return waste.shared_session_servers(*inputs.shared_tools(spark, sf_dir)).drop("calls")


@query("""SELECT session_id, count(*) AS loaded, count_if(call_count = 0)::BIGINT AS unused, sum(CASE WHEN call_count = 0 THEN tokens ELSE 0 END)::BIGINT AS wasted_tokens,
 CASE WHEN bool_or(origin IN ('wire', 'both')) AND bool_or(origin IN ('config', 'both')) THEN 'wire_and_config' WHEN bool_or(origin IN ('wire', 'both')) THEN 'wire' WHEN bool_or(origin IN ('config', 'both')) THEN 'config' ELSE 'calls' END AS data_source FROM wt GROUP BY 1""", WASTE)
def E19_waste_totals(spark, sf_dir):
    return waste.shared_totals(*inputs.shared_tools(spark, sf_dir))


_CROSS = "SELECT server, count(*) AS sessions, count_if(calls = 0)::BIGINT AS zero_sessions, sum(calls)::BIGINT AS calls, sum(unused_tokens)::BIGINT AS unused_tokens FROM (SELECT session_id, server, sum(call_count) AS calls, sum(CASE WHEN call_count = 0 THEN tokens ELSE 0 END) AS unused_tokens FROM wt GROUP BY ALL) GROUP BY 1"


@query(_CROSS, WASTE)
def E20_cross_servers(spark, sf_dir):
    servers = waste.shared_servers(*inputs.shared_tools(spark, sf_dir))
    return servers.select("server", "sessions", "zero_sessions", "calls", "unused_tokens")


@query("SELECT server, tool, count(DISTINCT session_id) AS sessions, sum(call_count)::BIGINT AS calls FROM wt GROUP BY 1, 2", WASTE)
def E36_cross_tools(spark, sf_dir):
    return waste.shared_cross_tools(*inputs.shared_tools(spark, sf_dir)[:3])


@query("SELECT * FROM (" + _CROSS + ") WHERE unused_tokens > 0 ORDER BY unused_tokens DESC, zero_sessions, server DESC LIMIT 1", WASTE)
def E22_largest_waste(spark, sf_dir):
    """Top-k: the server with the largest waste."""
    return waste.largest_waste(waste.shared_servers(*inputs.shared_tools(spark, sf_dir)).select("server", "sessions", "zero_sessions", "calls", "unused_tokens"))


@query("""SELECT server, tools, calls, fail, total_ms, sessions, unused, unused_sessions, wasted_tokens FROM
 (SELECT server, count(DISTINCT tool) AS tools, count(*) AS calls, count_if(NOT ok)::BIGINT AS fail, sum(duration_ms)::BIGINT AS total_ms, count(DISTINCT session_id) AS sessions FROM ot GROUP BY 1)
 FULL JOIN (SELECT server, sum(unused)::BIGINT AS unused, count_if(called = 0)::BIGINT AS unused_sessions, sum(unused_tokens)::BIGINT AS wasted_tokens FROM ws GROUP BY 1) USING (server)""", WASTE)
def E12_by_server(spark, sf_dir):
    calls = inputs.order_tools(spark, sf_dir)
    named = calls.select("session_id", F.concat(F.lit("mcp__"), "server", F.lit("__"), "tool").alias("name"), F.when(F.col("ok"), "success").otherwise("failure").alias("status"), "duration_ms")
    return ranks.by_server(named, waste.shared_servers(*inputs.shared_tools(spark, sf_dir)))


@query(_CROSS, WASTE)
def E20_servers_by_session(spark, sf_dir):
    """E20 over servers written out by session."""
    return waste.servers_of_sessions(waste.shared_session_servers(*inputs.shared_tools(spark, sf_dir)))


@on_episodes("SELECT DISTINCT model, array_to_string(string_split(model, '-')[:2], '-') AS family, substr(sha256(model), 1, 8) AS hash, CASE WHEN regexp_matches(model, '^(gpt-5|gpt-4o|o1|o3)') THEN 'o200k' ELSE 'cl100k' END AS tokenizer FROM ev WHERE model IS NOT NULL")
def H3_model_names(e):
    m = F.col("model")
    return e.events.where("model is not null").select(m, S.model_family(m).alias("family"), S.short_hash(m).alias("hash"), S.tokenizer_class(m).alias("tokenizer")).distinct()


@query(r"""WITH x AS (SELECT 'd' || doc_id AS doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
 SELECT doc_id, line::BIGINT AS line, name FROM (SELECT doc_id, line, unnest(regexp_extract_all(x, '(?:/home/|/Users/|[A-Za-z]:\\Users\\)([A-Za-z0-9._-]+)', 1)) AS name FROM x) WHERE name NOT IN ('user', 'runner', 'example')
 UNION ALL SELECT 'c' || c_custkey, 2::BIGINT, replace(c_name, '#', '_') FROM customer WHERE c_custkey % 3 <> 1
 UNION ALL SELECT 'c' || c_custkey, 3, 'C' || c_nationkey FROM customer WHERE c_custkey % 3 <> 1 UNION ALL SELECT 'c' || c_custkey, 3, 'm.' || c_custkey FROM customer WHERE c_custkey % 3 <> 1""", "")
def C15_home_leaks(spark, sf_dir):
    """All documents, and texts of three lines made of each customer: no path, a Linux path, and paths of Windows and macOS; a third has names that are allowed."""
    c = inputs.table(spark, sf_dir, "customer")
    some = F.col("c_custkey") % 3 != 1
    name = lambda x, other: F.when(some, x).otherwise(F.lit(other))
    home, windows, mac = name(F.translate("c_name", "#", "_"), "runner"), name(F.concat(F.lit("C"), F.col("c_nationkey")), "user"), name(F.concat(F.lit("m."), F.col("c_custkey")), "example")
    text = F.concat(F.lit("no path\ncd /home/"), home, F.lit("/src\nC:\\Users\\"), windows, F.lit(" and /Users/"), mac, F.lit("/x"))
    made = c.select(F.concat(F.lit("c"), F.col("c_custkey")).alias("doc_id"), text.alias("text"))
    return audit.leaks(inputs.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text").unionByName(made))


# Store, telemetry and logs, over tables that Spark derives from the given ones.


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as stored sessions."""
    return inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("started_at"), F.concat(F.lit("/s/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_custkey").alias("mtime"), "o_orderkey")


def _refs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The orders as two sides that overlap: files lack every third order, the store every fifth of the others; each order is on one side at least."""
    o = _orders(spark, sf_dir)
    files = o.where("o_orderkey % 3 <> 0").drop("o_orderkey")
    store_ = o.where("o_orderkey % 5 <> 0 or o_orderkey % 3 = 0").withColumn("mtime", F.col("mtime") + F.col("o_orderkey") % 2).drop("o_orderkey")
    return files, store_


_REFS = "WITH o AS (SELECT o_orderkey::VARCHAR AS id, epoch_ms(o_orderdate) AS started_at, '/s/' || o_orderkey AS path, o_custkey AS mtime, o_orderkey AS k FROM orders) "


@query("""SELECT id, CASE WHEN k % 3 <> 0 THEN mtime ELSE mtime + k % 2 END AS mtime, started_at, path, CASE WHEN k % 3 <> 0 AND k % 5 <> 0 AND k % 2 = 1 THEN 'mtime' ELSE '' END AS differs, CASE WHEN k % 3 <> 0 THEN 'file' ELSE 'store' END AS origin FROM o""", _REFS)
def D11_merged_refs(spark, sf_dir):
    return store.merge_refs(*_refs(spark, sf_dir))


@query("SELECT id, started_at, path, CASE WHEN k % 3 <> 0 THEN mtime ELSE mtime + k % 2 END AS mtime, CASE WHEN k % 3 <> 0 THEN 2 ELSE 1 END::BIGINT AS ingested_at FROM o", _REFS)
def B1_upsert(spark, sf_dir):
    files, old = _refs(spark, sf_dir)
    return store.upsert(old.withColumn("ingested_at", F.lit(1).cast("long")), files.withColumn("ingested_at", F.lit(2).cast("long")))


@query("SELECT id, started_at FROM o WHERE started_at >= 800000000000", _REFS)
def A12_window_scan(spark, sf_dir):
    return store.newer(_orders(spark, sf_dir), 900_000_000_000, 100_000_000_000).select("id", "started_at")


@query("SELECT o.id AS session_id, l_linenumber::INT AS line FROM lineitem JOIN o ON l_orderkey = k WHERE NOT coalesce(started_at < 800000000000, false)", _REFS)
def B6_prune(spark, sf_dir):
    kids = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("session_id"), F.col("l_linenumber").alias("line"))
    return store.prune(_orders(spark, sf_dir), kids, 900_000_000_000, 100_000_000_000)[1]


@on_episodes("SELECT count(*) AS sessions, min(started_at) AS first, max(started_at) AS last, (SELECT count(*) FROM calls) AS tools, (SELECT count(*) FROM turns) AS turns FROM walls")
def B7_store_stats(e):
    return store.stats(e.walls, e.calls, e.turns)


_TELEMETRY = """WITH t0 AS (SELECT *, (props ->> 'k')::INT AS k FROM events),
te AS (SELECT user_id::VARCHAR AS session_id, event_id, CASE event_type WHEN 'click' THEN 'tool_start' WHEN 'view' THEN 'tool_result' WHEN 'purchase' THEN 'token_usage' WHEN 'signup' THEN 'session_start' ELSE 'unrecognised' END AS event_type,
    CASE WHEN k % 2 = 0 THEN 'codex' ELSE 'copilot' END AS agent, ts, 't' || (k % 2) AS turn_id, 'tool' || (k % 3) AS tool_name, CASE WHEN event_id % 5 = 0 THEN 'failure' ELSE 'success' END AS status, 'm' || (k % 2) AS model, ['input', 'output', 'cache_read', 'cache_creation'][k % 4 + 1] AS direction, k AS value FROM t0),
good AS (SELECT * FROM te WHERE event_type <> 'unrecognised') """


@query("""SELECT session_id, tool_name, count(*) AS calls, count_if(status = 'success')::BIGINT AS ok, count_if(status = 'failure')::BIGINT AS fail, count_if(status = 'open')::BIGINT AS orphan, sum(ms)::BIGINT AS total_ms, max(ms)::BIGINT AS max_ms, quantile_disc(ms, 0.5)::BIGINT AS p50, quantile_disc(ms, 0.95)::BIGINT AS p95, 'builtin' AS source FROM
 (SELECT session_id, tool_name, CASE WHEN event_type = 'tool_start' THEN 'open' ELSE status END AS status, CASE WHEN event_type = 'tool_start' THEN (epoch_us(fin) - epoch_us(ts)) // 1000 WHEN was = 'tool_start' THEN (epoch_us(ts) - epoch_us(begun)) // 1000 ELSE 0 END AS ms FROM
  (SELECT *, lag(event_type) OVER w AS was, lag(ts) OVER w AS begun, lead(ts) OVER w IS NULL AS is_last FROM good WHERE event_type LIKE 'tool%' WINDOW w AS (PARTITION BY session_id, tool_name, turn_id ORDER BY ts, event_type = 'tool_result'))
  JOIN (SELECT session_id, max(ts) AS fin FROM good GROUP BY 1) USING (session_id) WHERE event_type = 'tool_result' OR is_last) GROUP BY 1, 2""", _TELEMETRY)
def E29_telemetry_tools(spark, sf_dir):
    return telemetry.session_tools(telemetry.split_records(inputs.telemetry_events(spark, sf_dir))[0])


@query("""SELECT session_id, model, coalesce(sum(value) FILTER (direction = 'input'), 0)::BIGINT AS input, coalesce(sum(value) FILTER (direction = 'output'), 0)::BIGINT AS output, coalesce(sum(value) FILTER (direction = 'cache_read'), 0)::BIGINT AS cache_read, coalesce(sum(value) FILTER (direction = 'cache_creation'), 0)::BIGINT AS cache_creation FROM good WHERE event_type = 'token_usage' GROUP BY 1, 2
 UNION ALL SELECT session_id, arg_max(model, ts) FILTER (event_type = 'session_start'), 0, 0, 0, 0 FROM good GROUP BY 1 HAVING count_if(event_type = 'token_usage') = 0 AND count_if(event_type = 'session_start') > 0""", _TELEMETRY)
def E29_telemetry_usage(spark, sf_dir):
    return telemetry.session_usage(telemetry.split_records(inputs.telemetry_events(spark, sf_dir))[0])


@query("SELECT session_id, coalesce(arg_max(agent, ts) FILTER (event_type = 'session_start'), 'claude') AS agent, coalesce(min(ts) FILTER (event_type = 'session_start'), TIMESTAMP '2024-02-01 00:00:00') AS started_at, 0::BIGINT AS prompts FROM good GROUP BY 1", _TELEMETRY)
def E29_telemetry_heads(spark, sf_dir):
    out = telemetry.session_heads(telemetry.split_records(inputs.telemetry_events(spark, sf_dir))[0], F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    return out.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))


@query("SELECT event_type, agent, count(*) AS records FROM te WHERE event_type = 'unrecognised' GROUP BY 1, 2", _TELEMETRY)
def I7_dropped_records(spark, sf_dir):
    return telemetry.dropped_counts(telemetry.split_records(inputs.telemetry_events(spark, sf_dir))[1])


def _stored(e: Episodes) -> sessionstore.SessionStore:
    """A store that took in all sessions without their failed calls and unfinished turns, and then every third session again as a whole."""
    spark = e.events.sparkSession
    store_ = sessionstore.SessionStore(spark, folders.scratch(spark, "session-store"), parts=4)
    with e.held() as h:
        meta = h.walls.select("session_id", F.lit("copilot").alias("agent"), "started_at", F.concat(F.lit("/s/"), "session_id").alias("raw_path"), F.lit(1).cast("long").alias("raw_mtime"))
        used = h.rows.where("kind = 'assistant_message'").groupBy("session_id", "model").agg(F.sum("output_tokens").alias("output_tokens")).select("*", *[F.lit(0).cast("long").alias(c) for c in ("input_tokens", "cache_read", "cache_write")])
        again = F.col("session_id").cast("long") % 3 == 0
        store_.upsert(*sessionstore.report_tables(meta, ranks.tool_rank(h.calls.where("status <> 'failure'")), h.turns.where("status = 'completed'"), used.limit(0)), at_ms=1)
        store_.upsert(*sessionstore.report_tables(meta.where(again), ranks.tool_rank(h.calls.where(again)), h.turns.where(again), used.where(again)), at_ms=2)
    return store_


_STORED = CTES + """, um AS (SELECT session_id, model, sum(output_tokens)::BIGINT AS k FROM ev WHERE kind = 'assistant_message' GROUP BY ALL),
us AS (SELECT session_id, sum(k)::BIGINT AS k, arg_min(model, (-k, model)) AS model FROM um WHERE session_id::BIGINT % 3 = 0 GROUP BY 1) """


@on_episodes("""SELECT session_id AS id, us.model AS dominant_model, epoch_us(started_at) // 1000 AS started_at, CASE WHEN us.k IS NOT NULL THEN 0 END::BIGINT AS total_input_tokens, us.k AS total_output_tokens, CASE WHEN session_id::BIGINT % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS ingested_at FROM walls LEFT JOIN us USING (session_id)""", _STORED)
def B1_stored_sessions(e):
    """Sessions on disk after two batches, of which the second replaces every third."""
    return _stored(e).table("sessions").select("id", "dominant_model", "started_at", "total_input_tokens", "total_output_tokens", "ingested_at")


@on_episodes("SELECT session_id, name AS tool_name, CASE WHEN regexp_matches(name, '^mcp__.*?__') THEN 'mcp:' || regexp_extract(name, '^mcp__(.*?)__', 1) ELSE 'builtin' END AS source, count(*) AS call_count, sum(duration_ms)::BIGINT AS total_duration_ms FROM calls WHERE session_id::BIGINT % 3 = 0 OR status <> 'failure' GROUP BY ALL")
def B2_stored_tools(e):
    """The store's tools, replaced with their sessions."""
    return _stored(e).table("tools_loaded").select("session_id", "tool_name", "source", "call_count", "total_duration_ms")


@on_episodes("SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn_seq) - 1 AS turn_index, output_tokens, model FROM turns WHERE session_id::BIGINT % 3 = 0 OR status = 'completed'")
def B3_stored_turns(e):
    """The store's turns, replaced with their sessions."""
    return _stored(e).table("turn_buckets").select("session_id", "turn_index", "output_tokens", "model")


_CUT = "TIMESTAMP '2024-01-01 06:00:00'"


@on_episodes(f"SELECT session_id, coalesce(n, 0)::BIGINT AS turns FROM walls LEFT JOIN (SELECT session_id, count(*) AS n FROM turns WHERE session_id::BIGINT % 3 = 0 OR status = 'completed' GROUP BY 1) USING (session_id) WHERE started_at >= {_CUT}")
def B6_pruned_store(e):
    """Sessions that pruning leaves in the store, with their numbers of turns."""
    store_ = _stored(e)
    cut = 1_704_088_800_000
    store_.prune(cut, 0)
    turns = store_.table("turn_buckets").groupBy("session_id").agg(F.count("*").alias("n"))
    return store_.table("sessions").select(F.col("id").alias("session_id")).join(turns, "session_id", "left").select("session_id", F.coalesce("n", F.lit(0)).cast("long").alias("turns"))


_EXPORTS = """WITH t0 AS (SELECT *, (props ->> 'k')::INT AS k, event_id AS i, user_id::VARCHAR AS u FROM events),
t AS (SELECT *, CASE WHEN i % 3 = 0 OR i % 7 = 0 THEN 'claude' WHEN i % 3 = 1 THEN 'codex' ELSE 'copilot' END AS agent, CASE WHEN i % 5 <> 0 THEN u WHEN i % 10 = 0 THEN 'c' || u END AS sid FROM t0),
lg AS (SELECT *, coalesce(sid, CASE WHEN i % 20 <> 5 THEN 'r' || u END) AS s, CASE WHEN sid IS NULL AND i % 20 = 5 THEN 'session.id is too long' END AS lost, tm, nm, ['session_start', 'session_end', 'prompt', 'prompt', 'tool_start', 'tool_start', 'tool_start', 'tool_result', 'tool_result', 'unrecognised'][nm + 1] AS kind
    FROM (SELECT *, i % 10 AS nm, i % 13 = 0 AS late, ts + (i % 2) * INTERVAL 1 MICROSECOND AS tm FROM t UNION ALL SELECT *, 3, false, ts + (i % 2) * INTERVAL 1 MICROSECOND FROM t)),
lx AS (SELECT *, CASE WHEN late THEN 'time is out of range' WHEN kind <> 'unrecognised' THEN lost END AS problem FROM lg),
mp AS (SELECT *, 1 AS p, ['input', 'prompt', 'output', 'completion', 'cache_read', 'cache.read', 'cache_create', 'cache_creation', 'cache.create', 'sideways'][k % 10 + 1] AS way FROM t WHERE i % 11 <> 0 UNION ALL SELECT *, 2, CASE WHEN i % 6 <> 0 THEN 'input' END FROM t WHERE i % 11 <> 0),
mx AS (SELECT *, ['input', 'input', 'output', 'output', 'cache_read', 'cache_read', 'cache_creation', 'cache_creation', 'cache_creation'][list_position(['input', 'prompt', 'output', 'completion', 'cache_read', 'cache.read', 'cache_create', 'cache_creation', 'cache.create'], way)] AS direction,
    CASE WHEN sid IS NULL THEN 'missing session.id' WHEN way IS NULL THEN 'missing gen_ai.token.type' WHEN way = 'sideways' THEN 'unknown token direction: sideways' WHEN p = 1 AND i % 7 = 0 THEN 'invalid token count: -1' END AS problem FROM mp),
sp AS (SELECT *, CASE WHEN i % 5 = 0 THEN 'session_start' WHEN i % 5 = 1 THEN 'session_end' WHEN i % 5 = 3 OR i % 5 = 2 AND i % 2 = 0 THEN 'tool' END AS kind, greatest(ts, ts + (i % 3 - 1) * INTERVAL 5 MILLISECOND) AS fin FROM t) """


def _typed(spark: SparkSession, sf_dir: str, signal: str) -> DataFrame:
    out = exports.typed_events(inputs.exports(spark, sf_dir), signals=(signal,)).where(F.col("signal") == signal)
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT CASE WHEN ok THEN s END AS session_id, CASE WHEN problem IS NOT NULL THEN 'error' ELSE kind END AS event_type, agent, CASE WHEN NOT late THEN tm END AS ts, CASE WHEN ok AND kind NOT LIKE 'session%' THEN 't' || (k % 2) END AS turn_id,
 CASE WHEN tool THEN CASE WHEN k % 4 <> 0 THEN 'tool' || (k % 3) ELSE '' END END AS tool_name, CASE WHEN tool THEN 'builtin' END AS source, CASE WHEN tool AND kind = 'tool_start' THEN i % 2 = 0 END AS user_approved, CASE WHEN tool AND kind = 'tool_result' THEN CASE WHEN i % 4 = 1 THEN 'failure' ELSE 'success' END END AS status,
 CASE WHEN tool AND kind = 'tool_result' AND i % 4 = 1 THEN 'failed' END AS error_message, CASE WHEN ok AND kind = 'session_start' THEN 'm' || (k % 2) END AS model, NULL::VARCHAR AS direction, NULL::BIGINT AS value, CASE WHEN ok AND kind = 'session_start' THEN '/w' END AS cwd,
 CASE WHEN ok AND kind = 'prompt' THEN CASE i % 3 WHEN 0 THEN k WHEN 1 THEN k + 1 END END::BIGINT AS prompt_size_bytes, 'log' AS signal, CASE WHEN problem IS NOT NULL THEN problem WHEN kind = 'unrecognised' THEN 'log.event_name=other.name' END AS identity
 FROM (SELECT *, problem IS NULL AND kind <> 'unrecognised' AS ok, problem IS NULL AND kind LIKE 'tool%' AS tool FROM lx)""", _EXPORTS)
def A14_typed_logs(spark, sf_dir):
    """Nested log exports, with every name of the format."""
    return _typed(spark, sf_dir, "log")


@query("""SELECT CASE WHEN problem IS NULL THEN sid END AS session_id, CASE WHEN problem IS NULL THEN 'token_usage' ELSE 'error' END AS event_type, agent, ts, NULL::VARCHAR AS turn_id, NULL::VARCHAR AS tool_name, NULL::VARCHAR AS source, NULL::BOOLEAN AS user_approved, NULL::VARCHAR AS status, NULL::VARCHAR AS error_message,
 CASE WHEN problem IS NULL THEN CASE WHEN p = 2 THEN '' WHEN i % 2 = 0 THEN 'g1' ELSE 'm' || (k % 2) END END AS model, CASE WHEN problem IS NULL THEN direction END AS direction, CASE WHEN problem IS NULL THEN CASE p WHEN 1 THEN k ELSE k + 1 END END::BIGINT AS value, NULL::VARCHAR AS cwd, NULL::BIGINT AS prompt_size_bytes, 'metric' AS signal, problem AS identity FROM mx
 UNION ALL SELECT NULL, 'unrecognised', agent, TIMESTAMP '1970-01-01', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'metric', 'metric.name=agent.other.usage' FROM t
 UNION ALL SELECT NULL, 'unrecognised', agent, TIMESTAMP '1970-01-01', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'metric', 'metric.name=' || ['gen_ai.client.token.usage', 'agent.token.usage', 'claude_code.token.usage'][i % 3 + 1] || ';unsupported_data_kind' FROM t WHERE i % 11 = 0""", _EXPORTS)
def A15_typed_metrics(spark, sf_dir):
    """Nested metric exports: sums, gauges, and metrics with neither."""
    return _typed(spark, sf_dir, "metric")


@query("""SELECT CASE WHEN ok THEN sid END AS session_id, CASE WHEN kind IS NULL THEN 'unrecognised' WHEN NOT ok THEN 'error' WHEN kind = 'tool' THEN ['tool_start', 'tool_result'][n] ELSE kind END AS event_type, agent, CASE WHEN kind = 'session_end' OR n = 2 THEN fin ELSE ts END AS ts,
 CASE WHEN tool THEN 't' || (k % 2) END AS turn_id, CASE WHEN tool THEN CASE WHEN i % 2 = 1 THEN 'x' ELSE 'g' END END AS tool_name, CASE WHEN tool THEN 'builtin' END AS source, CASE WHEN tool AND n = 1 THEN false END AS user_approved, CASE WHEN tool AND n = 2 THEN CASE WHEN i % 6 = 0 THEN 'failure' ELSE 'success' END END AS status,
 CASE WHEN tool AND n = 2 AND i % 6 = 0 AND i % 12 <> 0 THEN 'bad' END AS error_message, CASE WHEN ok AND kind = 'session_start' THEN 'm' || (k % 2) END AS model, NULL::VARCHAR AS direction, NULL::BIGINT AS value, NULL::VARCHAR AS cwd, NULL::BIGINT AS prompt_size_bytes, 'trace' AS signal,
 CASE WHEN kind IS NULL THEN 'span.name=' || ['a', 'b', 'llm.toolbox', 'tool.execute', 'session'][i % 5 + 1] WHEN NOT ok THEN 'missing session.id' END AS identity
 FROM (SELECT *, sid IS NOT NULL AND kind IS NOT NULL AS ok, sid IS NOT NULL AND kind = 'tool' AS tool FROM sp), (VALUES (1), (2)) v(n) WHERE n = 1 OR kind = 'tool'""", _EXPORTS)
def A16_typed_spans(spark, sf_dir):
    """Nested span exports: session spans, tool spans by name or operation, and others."""
    return _typed(spark, sf_dir, "trace")


@query("""SELECT DISTINCT user_id::VARCHAR AS session_id, unnest(['mcp__s' || (k % 3) || '__t' || (k % 4), 'mcp__x__' || event_type]) AS name FROM (SELECT *, (props ->> 'k')::INT AS k FROM events)""", "")
def G5_announced_tools(spark, sf_dir):
    return ranks.announced(inputs.notices(spark, sf_dir).select("session_id", S.announced_tools(F.col("text")).alias("loaded_tools")))


@query("""SELECT session_id, model, floor(l_extendedprice)::BIGINT AS input_tokens, floor(l_quantity)::BIGINT AS output_tokens, CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey ELSE 0 END::BIGINT AS cache_read, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey ELSE 0 END::BIGINT AS cache_write
 FROM (SELECT o_orderkey::VARCHAR AS session_id, o_orderpriority AS model, lineitem.* FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 3 <> 0) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_suppkey DESC, l_partkey DESC) = 1""", "")
def E6_last_usage(spark, sf_dir):
    return ranks.last_usage(inputs.shutdowns(spark, sf_dir))


@on_episodes("SELECT session_id, 'out_of_order' AS kind FROM (SELECT session_id, late < lag(late) OVER (PARTITION BY session_id ORDER BY seq) AS b FROM (SELECT *, ts + (event_id::BIGINT % 9) * INTERVAL 9 HOUR AS late FROM ev)) GROUP BY 1 HAVING bool_or(b)")
def F2_out_of_order(e):
    """Events that reach the log up to three days late."""
    late = F.col("ts") + F.make_dt_interval(hours=(F.col("event_id").cast("int") % 9) * 9)
    return audit.out_of_order(e.events.withColumn("ts", late))


@on_episodes("SELECT name, calls, total_ms FROM (" + _BY_TOOL + ") ORDER BY calls > 0 AND name = 'ask_user', CASE WHEN name = 'ask_user' THEN total_ms ELSE calls END DESC, name LIMIT 8")
def C12_tools_by_calls(e):
    """Top-k: the eight tools with most calls; those that wait for the user stand last."""
    return ranks.ordered(ranks.by_tool(e.calls), "calls", 8, blocking_last=True).select("name", "calls", "total_ms")


@on_episodes("SELECT name, calls, ok FROM (" + _BY_TOOL + ") ORDER BY ok / calls DESC, calls DESC, name LIMIT 5")
def G2_tools_by_success(e):
    """Top-k: the five tools with the largest share of successes."""
    return ranks.ordered(ranks.by_tool(e.calls), "success", 5).select("name", "calls", "ok")


@on_episodes("SELECT name, sessions FROM (" + _BY_TOOL + ") ORDER BY sessions DESC, name LIMIT 5")
def G3_tools_by_sessions(e):
    """Top-k: the five tools that most sessions call."""
    return ranks.ordered(ranks.by_tool(e.calls), "sessions", 5).select("name", "sessions")


@query("SELECT tool, max(server) AS server FROM wt GROUP BY 1 HAVING sum(call_count) = 0", WASTE.replace("FULL JOIN cc", "FULL JOIN (SELECT * FROM cc WHERE tool NOT LIKE 'P%') cc"))
def G6_never_called(spark, sf_dir):
    """Loaded tools that no session calls, where the calls of tools with a P are unknown."""
    loaded, _, called, _ = inputs.shared_tools(spark, sf_dir)
    tools = waste.shared_cross_tools(loaded, called.select("grp", "session_id"), called.where("tool not like 'P%'"))
    return waste.never_called(tools.withColumnRenamed("calls", "call_count"), 0)


@query("SELECT id, started_at, path, mtime FROM o WHERE k = 7", _REFS)
def A13_lookup(spark, sf_dir):
    return store.lookup(_orders(spark, sf_dir).drop("o_orderkey"), "7", "id")


@query("SELECT id, started_at FROM o WHERE started_at >= 813600000000 ORDER BY started_at DESC, id LIMIT 200", _REFS)
def E28_dashboard(spark, sf_dir):
    """Top-k: the dashboard's 200 latest sessions of a window of 1,000 days."""
    return store.dashboard(_orders(spark, sf_dir), 900_000_000_000, days=1000).select("id", "started_at")


@query("SELECT id, path FROM o ORDER BY mtime DESC, id LIMIT 1 OFFSET 1", _REFS)
def C3_previous_session(spark, sf_dir):
    """Top-k: the session changed last but one."""
    return store.selected(_orders(spark, sf_dir), "previous").select("id", "path")


@query("SELECT session_id, l_quantity AS quantity FROM (SELECT o_orderkey::VARCHAR AS session_id, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE epoch_ms(o_orderdate) >= 800000000000)", "")
def E17_stored_rows(spark, sf_dir):
    kids = inputs.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("session_id"), F.col("l_quantity").alias("quantity"))
    return store.in_window(kids, _orders(spark, sf_dir), 900_000_000_000, 100_000_000_000)


@query("""SELECT server, tool, count(*) AS sessions, sum(n)::BIGINT AS calls FROM (SELECT coalesce(n, 0) AS n, regexp_extract(name, '^mcp__(.*?)__(.*)$', 1) AS server, regexp_extract(name, '^mcp__(.*?)__(.*)$', 2) AS tool FROM
 (SELECT user_id::VARCHAR AS session_id, 'mcp__s' || (k % 3) || '__t' || (k % 4) AS name FROM k UNION SELECT user_id::VARCHAR, 'mcp__x__' || event_type FROM events)
 FULL JOIN (SELECT session_id, name, count(*) AS n FROM calls WHERE name LIKE 'mcp%' GROUP BY ALL) USING (session_id, name)) GROUP BY 1, 2""")
def E35_announced_waste(spark, sf_dir):
    announced = ranks.announced(inputs.notices(spark, sf_dir).select("session_id", S.announced_tools(F.col("text")).alias("loaded_tools")))
    return waste.cross_tools(waste.announced_waste(announced, Episodes(inputs.events(spark, sf_dir)).calls))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
