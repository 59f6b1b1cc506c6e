"""Per-session ranks and cross-session roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.percentiles import ceiling_rank, rounded_index
from ..functions.scalars import USER_BLOCKING, cache_metrics, saturating_sum, source_kind, source_name


def _count(when: Column) -> Column:
    return F.count_if(when).cast("long")


def tool_rank(calls: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Per session and tool: calls, ok, fail, orphan (with open ones), user_requested, total_ms, p50, p95, max_ms. Sort by total_ms descending, then name."""
    if requested is not None:
        calls = calls.join(requested.withColumn("_asked", F.lit(True)), ["session_id", "start_seq"], "left")
    asked = F.coalesce(F.col("_asked"), F.lit(False)) if requested is not None else F.lit(False)
    by = ["session_id", "name"]
    s = F.col("status")
    agg = calls.groupBy(*by).agg(F.count("*").alias("calls"), _count(s == "success").alias("ok"), _count(s == "failure").alias("fail"), _count(s.isin("orphan", "open_at_end")).alias("orphan"), _count(asked).alias("user_requested"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))
    return agg.join(rounded_index(calls, by, "duration_ms", {"p50": 50, "p95": 95}), by)


def hook_rank(hooks: DataFrame) -> DataFrame:
    """Per session and hook: calls, ok, fail, synthesized, total_ms, p50, p95."""
    by = ["session_id", "name"]
    agg = hooks.groupBy(*by).agg(F.count("*").alias("calls"), _count(F.col("success")).alias("ok"), _count(~F.col("success")).alias("fail"), _count(F.col("synthesized")).alias("synthesized"), F.sum("duration_ms").alias("total_ms"))
    return agg.join(rounded_index(hooks, by, "duration_ms", {"p50": 50, "p95": 95}), by)


def turn_summary(turns: DataFrame, calls: DataFrame, hooks: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    """Turns with their duration and numbers of tool and hook calls, and of skills where those are given."""
    kinds = {"tools": calls, "hooks": hooks} | ({} if skills is None else {"skills": skills})
    out = turns
    for name, rows in kinds.items():
        n = rows.where("turn_seq is not null").groupBy("session_id", "turn_seq").agg(F.count("*").alias(name))
        out = out.join(n, ["session_id", "turn_seq"], "left")
    ms = F.floor((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000)
    return out.select("session_id", "turn_id", "status", "model", "output_tokens", "mode", ms.alias("duration_ms"), *[F.coalesce(name, F.lit(0)).alias(name) for name in kinds])


def turn_detail(calls: DataFrame, arguments: DataFrame, shown: int = 80) -> DataFrame:
    """The calls of each turn, longest first: session_id, turn_id, name, status, duration_ms, source, preview (the first `shown` characters of its arguments, by first_arguments). Choose a turn with where."""
    rows = calls.where("turn_seq is not null").join(arguments, ["session_id", "call_id"], "left")
    out = rows.select("session_id", "turn_id", "name", "status", "duration_ms", source_kind(F.col("name")).alias("source"), F.left("arguments", F.lit(shown)).alias("preview"), "start_seq")
    return out.orderBy("session_id", "turn_id", F.desc("duration_ms"), "start_seq").drop("start_seq")


def by_tool(calls: DataFrame) -> DataFrame:
    """Per tool and source over all sessions, percentiles from the pooled durations."""
    named = calls.withColumns({"source_kind": source_kind(F.col("name")), "source_name": F.coalesce(source_name(F.col("name")), F.lit(""))})
    by = ["name", "source_kind", "source_name"]
    agg = named.groupBy(*by).agg(F.count("*").alias("calls"), _count(F.col("status") == "success").alias("ok"), _count(F.col("status") == "failure").alias("fail"), F.sum("duration_ms").alias("total_ms"), F.count_distinct("session_id").alias("sessions"))
    return agg.join(rounded_index(named, by, "duration_ms", {"p50": 50, "p95": 95}), by)


def by_server(calls: DataFrame, waste_servers: DataFrame) -> DataFrame:
    """Per MCP server: tools called, calls, fails, total_ms, calling sessions; unused loaded tools, fully unused sessions, wasted tokens (waste_servers: rows by session and server, or shared_servers)."""
    mcp = calls.where(source_kind(F.col("name")) == "mcp").withColumn("server", source_name(F.col("name")))
    used = mcp.groupBy("server").agg(F.count_distinct("name").alias("tools"), F.count("*").alias("calls"), _count(F.col("status") == "failure").alias("fail"), F.sum("duration_ms").alias("total_ms"), F.count_distinct("session_id").alias("sessions"))
    if "zero_sessions" in waste_servers.columns:
        lost = waste_servers.select("server", "unused", F.col("zero_sessions").alias("unused_sessions"), F.col("unused_tokens").alias("wasted_tokens"))
    else:
        lost = waste_servers.groupBy("server").agg(F.sum("unused").alias("unused"), _count(F.col("called") == 0).alias("unused_sessions"), F.sum("unused_tokens").alias("wasted_tokens"))
    out = used.join(lost, "server", "full")
    return out.select("server", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tools", "calls", "fail", "total_ms", "sessions", "unused", "unused_sessions", "wasted_tokens")])


def by_day(walls: DataFrame, calls: DataFrame, turns: DataFrame, low: float = 20.0) -> DataFrame:
    """Per UTC day of the session's start: sessions, wall, tool time, tokens, utilisation in percent as a float, and whether it is under `low`."""
    t = calls.groupBy("session_id").agg(F.sum("duration_ms").alias("tool_ms"))
    k = turns.groupBy("session_id").agg(F.sum("output_tokens").alias("tokens"))
    per = walls.join(t, "session_id", "left").join(k, "session_id", "left").withColumn("day", F.to_date("started_at"))
    agg = per.groupBy("day").agg(F.count("*").alias("sessions"), F.sum("wall_ms").alias("wall_ms"), F.coalesce(F.sum("tool_ms"), F.lit(0)).alias("tool_ms"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("output_tokens"))
    return with_utilisation(agg, low)


def with_utilisation(days: DataFrame, low: float = 20.0) -> DataFrame:
    """Days with the share of wall_ms that tool_ms is, in percent, and whether it is under `low`."""
    used = F.when(F.col("wall_ms") > 0, F.least(F.lit(100.0), F.lit(100.0) * F.col("tool_ms") / F.col("wall_ms"))).otherwise(0.0).cast("float")
    return days.withColumn("utilisation", used).withColumn("low", F.col("utilisation") < F.lit(low).cast("float"))


def by_model(walls: DataFrame, turns: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Per model of the session's first turn (sessions where that is null are left out): sessions, turns, tokens, wall; with usage (last_usage) also its sessions' cache_read and cache_write, null where none has usage."""
    per = turns.groupBy("session_id").agg(F.min_by(F.struct("model"), "turn_seq").alias("f"), F.count("*").alias("turns"), F.sum("output_tokens").alias("tokens"))
    named = per.select("session_id", F.col("f.model").alias("model"), "turns", "tokens").where("model is not null").join(walls, "session_id")
    cache = [] if usage is None else ["cache_read", "cache_write"]
    if cache:
        sums = usage.groupBy("session_id").agg(*[saturating_sum(F.col(c)).alias(c) for c in cache])
        named = named.join(sums, "session_id", "left")
    return named.groupBy("model").agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("output_tokens"), F.sum("wall_ms").alias("wall_ms"), *[saturating_sum(F.col(c)).alias(c) for c in cache])


def header(walls: DataFrame, by: str | None = None, since: str | None = None, failed: int | None = None) -> DataFrame:
    """One row with the number of sessions and their total wall time; and what the roll-up's key and window are, and how many sessions could not be read, where they are given. If all failed, that is an error."""
    out = walls.agg(F.count("*").alias("sessions"), F.coalesce(F.sum("wall_ms"), F.lit(0)).alias("total_wall_ms"))
    if failed and not out.first()["sessions"]:
        raise ValueError(f"all {failed} sessions failed")
    given = {"by": by, "since": since, "failed": failed}
    return out.withColumns({k: F.lit(v) for k, v in given.items() if v is not None}) if any(v is not None for v in given.values()) else out


def by_mode(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """Per session and mode: turns, duration, tokens, tool calls."""
    n = calls.where("turn_seq is not null").groupBy("session_id", "turn_seq").agg(F.count("*").alias("c"))
    ms = F.floor((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000)
    rows = turns.join(n, ["session_id", "turn_seq"], "left").withColumn("ms", ms)
    return rows.groupBy("session_id", F.coalesce("mode", F.lit("—")).alias("mode")).agg(F.count("*").alias("turns"), F.coalesce(F.sum("ms"), F.lit(0)).alias("duration_ms"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.coalesce(F.sum("c"), F.lit(0)).alias("tool_calls"))


def session_list(turns: DataFrame, walls: DataFrame, usage: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Per session: start, first non-null model, turns, tokens, span from the first to the last turn's start; with usage (last_usage) the honest share of cache hits in percent, null if nothing was read or written; with files (session_id, size) the log's bytes."""
    per = turns.groupBy("session_id").agg(F.min_by("model", F.when(F.col("model").isNotNull(), F.col("turn_seq"))).alias("model"), F.count("*").alias("turns"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"), F.floor((F.unix_micros(F.max("started_at")) - F.unix_micros(F.min("started_at"))) / 1000).alias("span_ms"))
    out = walls.select("session_id", "started_at").join(per, "session_id", "left").withColumns({"turns": F.coalesce("turns", F.lit(0)), "output_tokens": F.coalesce("output_tokens", F.lit(0))})
    if usage is not None:
        rates = model_usage(usage, ["session_id"]).select("session_id", (100 * F.col("honest")).alias("cache_pct"))
        out = out.join(rates, "session_id", "left")
    return out if files is None else out.join(files.select("session_id", F.col("size").alias("bytes")), "session_id", "left")


def flame_scale(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """per session the ceil-ranked 95th percentile of completed turns without a user-blocking call; else their longest turn; at least 1."""
    blocking = calls.where(F.col("name").isin(*USER_BLOCKING)).select("session_id", "turn_seq").distinct().withColumn("b", F.lit(True))
    ms = F.floor((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1000)
    rows = turns.where("status = 'completed'").withColumn("ms", ms).join(blocking, ["session_id", "turn_seq"], "left")
    p = ceiling_rank(rows.where("b is null"), ["session_id"], "ms", {"p95": 95})
    top = turns.withColumn("ms", ms).groupBy("session_id").agg(F.max("ms").alias("top"))
    return top.join(p, "session_id", "left").select("session_id", F.greatest(F.lit(1), F.coalesce("p95", "top", F.lit(1))).alias("scale_ms"))


def recent_calls(calls: DataFrame, n: int = 5) -> DataFrame:
    """the last n calls of each tool in each session."""
    latest = Window.partitionBy("session_id", "name").orderBy(F.col("call_index").desc())
    return calls.withColumn("r", F.row_number().over(latest)).where(F.col("r") <= n).select("session_id", "name", "call_index", "status", "duration_ms")


def percent_columns(rank: DataFrame) -> DataFrame:
    """A rank with the whole percent of calls that were ok and of the session's time; null when the total is 0."""
    whole = F.sum("total_ms").over(Window.partitionBy("session_id"))
    return rank.withColumn("ok_pct", F.when(F.col("calls") > 0, F.floor(100 * F.col("ok") / F.col("calls")))).withColumn("time_pct", F.when(whole > 0, F.floor(100 * F.col("total_ms") / whole)))


def pending(calls: DataFrame, now: Column, blocking_ms: int = 30_000, other_ms: int = 300_000) -> DataFrame:
    """Calls still open for 30 s (user-blocking tools) or 5 minutes at `now`; blocking first, then name, then start."""
    blocking = F.col("name").isin(*USER_BLOCKING)
    age = F.floor((F.unix_micros(now) - F.unix_micros("started_at")) / 1000)
    rows = calls.where("status = 'open_at_end'").withColumns({"blocking": blocking, "age_ms": age})
    return rows.where(F.col("age_ms") >= F.when(blocking, blocking_ms).otherwise(other_ms)).select("session_id", "name", "start_seq", "blocking", "age_ms").orderBy(F.desc("blocking"), "name", "start_seq")


def turn_class(turns: DataFrame, calls: DataFrame, waiting: DataFrame) -> DataFrame:
    """Each turn as aborted, pending, open, no_tools or normal."""
    w = waiting.join(calls.select("session_id", "start_seq", "turn_seq"), ["session_id", "start_seq"]).select("session_id", "turn_seq").distinct().withColumn("p", F.lit(True))
    n = calls.select("session_id", "turn_seq").where("turn_seq is not null").distinct().withColumn("t", F.lit(True))
    rows = turns.join(w, ["session_id", "turn_seq"], "left").join(n, ["session_id", "turn_seq"], "left")
    kind = F.when(F.col("status") == "aborted", "aborted").when(F.col("p"), "pending").when(F.col("status") == "open", "open").when(F.col("t").isNull(), "no_tools").otherwise("normal")
    return rows.select("session_id", "turn_id", kind.alias("class"))


def model_usage(rows: DataFrame, by: list[str]) -> DataFrame:
    """Summed counters (input_tokens, output_tokens, cache_read, cache_write), their total and cache metrics per group."""
    counters = ("input_tokens", "output_tokens", "cache_read", "cache_write")
    agg = rows.groupBy(*by).agg(*[saturating_sum(F.col(c)).alias(c) for c in counters])
    m = cache_metrics(F.col("input_tokens"), F.col("cache_read"), F.col("cache_write"))
    return agg.withColumn("total", sum((F.col(c) for c in counters[1:]), F.col(counters[0]))).withColumn("m", m).select(*by, *counters, "total", "m.*")


def dominant_model(usage: DataFrame) -> DataFrame:
    """Per session the model with the most tokens, ties to the smaller name."""
    best = Window.partitionBy("session_id").orderBy(F.desc("total"), "model")
    return usage.withColumn("r", F.row_number().over(best)).where("r = 1").select("session_id", "model", "total")


def model_table(usage: DataFrame) -> DataFrame:
    """Rows a model and one total row (model null)."""
    counters = ("input_tokens", "output_tokens", "cache_read", "cache_write")
    rolled = usage.rollup("model").agg(*[F.sum(c).alias(c) for c in counters])
    m = cache_metrics(F.col("input_tokens"), F.col("cache_read"), F.col("cache_write"))
    return rolled.withColumn("net_saved", m["net"])


#: The columns that a rank or roll-up is sorted by, all from the largest; names break ties.
SORTS = {"total": ("total_ms",), "calls": ("calls",), "success": ("_ratio", "calls"), "p50": ("p50",), "sessions": ("sessions",)}


def ordered(rows: DataFrame, key: str = "total", limit: int = 0, by: str = "name", blocking_last: bool = False) -> DataFrame:
    """A rank or roll-up sorted by a key of SORTS, then by name; the first `limit` rows, or all for 0. A roll-up by day stays in order of days.

    blocking_last puts tools that wait for the user behind all others, sorted by total time whatever the key.
    """
    if by == "day":
        out = rows.orderBy("day")
    else:
        keys = [F.when(F.col("calls") > 0, F.col("ok") / F.col("calls")).otherwise(0.0) if c == "_ratio" else F.col(c) for c in SORTS[key]]
        if blocking_last:
            waits = F.col(by).isin(*USER_BLOCKING)
            keys = [waits.asc(), *[F.when(waits, F.col("total_ms")).otherwise(k).desc() for k in keys]]
        else:
            keys = [k.desc() for k in keys]
        out = rows.orderBy(*keys, by)
    return out.limit(limit) if limit else out


def last_usage(events: DataFrame) -> DataFrame:
    """session_id, model and the four counters of the last event that holds usage (empty maps count as none), missing counters being 0."""
    full = events.where(F.coalesce(F.size("model_metrics"), F.lit(0)) > 0)
    last = full.groupBy("session_id").agg(F.max_by("model_metrics", "seq").alias("m")).select("session_id", F.explode("m").alias("model", "u"))
    zero = lambda c: F.coalesce(F.col(f"u.{c}"), F.lit(0).cast("long"))
    return last.select("session_id", "model", zero("input").alias("input_tokens"), zero("output").alias("output_tokens"), zero("cache_read").alias("cache_read"), zero("cache_write").alias("cache_write"))


def session_totals(sessions: DataFrame, usage: DataFrame) -> DataFrame:
    """Sessions with the sums of last_usage's counters over models; null for a session without usage."""
    counters = ("input_tokens", "output_tokens", "cache_read", "cache_write")
    sums = usage.groupBy("session_id").agg(*[saturating_sum(F.col(c)).alias(f"total_{c}") for c in counters])
    return sessions.join(sums, "session_id", "left")


def announced(events: DataFrame) -> DataFrame:
    """session_id, name: tools that any event of a session announces, once each."""
    return events.select("session_id", F.explode("loaded_tools").alias("name")).distinct()
