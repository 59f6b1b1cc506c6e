"""Episodes from events: turns, tool calls, hook calls, skills, mode segments, aborts, warnings.

Starts and ends pair like a stack. With pushes as +1 and pops as -1, a running sum less its running minimum is the
stack's depth, and a start and its end are neighbours among the rows of one depth. So pairing is windows over one sort by
session; no row is matched with another by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import millis, mode_of

SKILL_WINDOW = 49
ORPHAN = "<orphan>"


def by_session():
    return Window.partitionBy("session_id").orderBy("seq")


def so_far():
    return by_session().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before():
    return by_session().rowsBetween(Window.unboundedPreceding, -1)


def stack_levels(events: DataFrame, push: Column, pop: Column, prefix: str) -> DataFrame:
    """adds {prefix}_level (depth of a start, or of the start that an end closes) and {prefix}_orphan (an end on an empty stack)."""
    s, low = f"_{prefix}_s", f"_{prefix}_low"
    rows = events.withColumn(s, F.sum(F.when(push, 1).when(pop, -1).otherwise(0)).over(so_far()))
    rows = rows.withColumn(low, F.least(F.lit(0), F.coalesce(F.min(s).over(before()), F.lit(0))))
    orphan = pop & (F.col(s) < F.col(low))
    depth = F.col(s) - F.least(F.col(low), F.col(s))
    level = F.when(push, depth).when(pop & ~orphan, depth + 1)
    return rows.withColumn(f"{prefix}_orphan", orphan).withColumn(f"{prefix}_level", level).drop(s, low)


def routed(events: DataFrame) -> DataFrame:
    """Events with stack levels of tools and hooks, abort_route (tool, hook, turn, session) and the turn that was open before each event (open_turn_seq, open_turn_id, open_turn_ts)."""
    kind = F.col("kind")
    rows = stack_levels(events, kind == "tool_start", kind.isin("tool_complete", "abort"), "tool")
    past_tools = (kind == "abort") & F.col("tool_orphan")
    rows = stack_levels(rows, kind == "hook_start", (kind == "hook_end") | past_tools, "hook")
    past_hooks = past_tools & F.col("hook_orphan")
    slot = F.when(kind.isin("turn_start", "turn_end") | past_hooks, F.struct((kind == "turn_start").alias("open"), F.col("seq"), F.col("event_id"), F.col("ts")))
    rows = rows.withColumn("_slot", F.last(slot, ignorenulls=True).over(before()))
    is_open = F.coalesce(F.col("_slot.open"), F.lit(False))
    rows = rows.withColumn("open_turn_seq", F.when(is_open, F.col("_slot.seq"))).withColumn("open_turn_id", F.when(is_open, F.col("_slot.event_id"))).withColumn("open_turn_ts", F.when(is_open, F.col("_slot.ts")))
    route = F.when(kind != "abort", None).when(~F.col("tool_orphan"), "tool").when(~F.col("hook_orphan"), "hook").when(is_open, "turn").otherwise("session")
    rows = rows.withColumn("abort_route", route).withColumn("mode_now", F.coalesce(F.last(F.when(kind == "mode_changed", mode_of(F.col("mode"))), ignorenulls=True).over(so_far()), F.lit("interactive")))
    whole = Window.partitionBy("session_id")
    return rows.drop("_slot").withColumn("last_seq", F.max("seq").over(whole)).withColumn("last_ts", F.max_by("ts", "seq").over(whole))


def _calls(rows: DataFrame, prefix: str, start: str, end: str) -> DataFrame:
    level = F.col(f"{prefix}_level")
    kept = rows.where(level.isNotNull() | (F.col(f"{prefix}_orphan") & (F.col("kind") == end)))
    pair = Window.partitionBy("session_id", f"{prefix}_level").orderBy("seq")
    closing = F.lead(F.struct("kind", "seq", "ts", "success", "error_message", "call_id")).over(pair)
    return kept.withColumn("end", F.when(F.col("kind") == start, closing)).where((F.col("kind") == start) | F.col(f"{prefix}_orphan"))


def tool_calls(rows: DataFrame) -> DataFrame:
    """One row a tool call or orphan completion, from routed events. A call that an abort closes failed with "aborted"; a call still open ends at the session's last event."""
    c = _calls(rows, "tool", "tool_start", "tool_complete")
    orphan, closed = F.col("kind") == "tool_complete", F.col("end.seq").isNotNull()
    aborted = F.col("end.kind") == "abort"
    status = F.when(orphan, "orphan").when(~closed, "open_at_end").when(aborted, "failure").when(F.coalesce(F.col("end.success"), F.lit(True)), "success").otherwise("failure")
    ended = F.when(orphan, F.col("ts")).otherwise(F.greatest(F.col("ts"), F.coalesce("end.ts", "last_ts")))
    out = c.select(
        "session_id", F.when(orphan, ORPHAN).otherwise(F.col("name")).alias("name"), F.col("seq").alias("start_seq"), F.when(orphan, F.col("seq")).otherwise(F.col("end.seq")).alias("commit_seq"),
        F.col("ts").alias("started_at"), ended.alias("ended_at"), status.alias("status"), F.when(aborted, "aborted").otherwise(F.when(status == "failure", F.col("end.error_message"))).alias("error_message"),
        F.coalesce(F.when(orphan, F.col("call_id")), F.when(~aborted, F.col("end.call_id")), F.col("call_id")).alias("call_id"), F.when(~orphan, F.col("call_id")).alias("start_call_id"), F.col("open_turn_seq").alias("turn_seq"), F.col("open_turn_id").alias("turn_id"), "last_seq",
    )
    order = Window.partitionBy("session_id", "name").orderBy(F.col("commit_seq").asc_nulls_last(), "start_seq")
    return out.withColumn("duration_ms", millis(F.col("started_at"), F.col("ended_at"))).withColumn("call_index", (F.row_number().over(order) - 1).cast("long"))


def hook_calls(rows: DataFrame) -> DataFrame:
    """D3: one row a hook call or orphan end; missing success and open hooks count as success, aborted ones as failure, orphan ends as synthesized."""
    c = _calls(rows, "hook", "hook_start", "hook_end")
    orphan, aborted = F.col("kind") == "hook_end", F.col("end.kind") == "abort"
    ok = F.when(orphan, F.coalesce("success", F.lit(True))).when(aborted, F.lit(False)).otherwise(F.coalesce("end.success", F.lit(True)))
    ended = F.when(orphan, F.col("ts")).otherwise(F.greatest(F.col("ts"), F.coalesce("end.ts", "last_ts")))
    out = c.select("session_id", "name", F.col("seq").alias("start_seq"), F.when(orphan, F.col("seq")).otherwise(F.col("end.seq")).alias("commit_seq"), F.col("ts").alias("started_at"), ended.alias("ended_at"), ok.alias("success"), orphan.alias("synthesized"), F.col("open_turn_seq").alias("turn_seq"))
    return out.withColumn("duration_ms", millis(F.col("started_at"), F.col("ended_at")))


def turns(rows: DataFrame) -> DataFrame:
    """One row a turn start, with the last model, summed tokens (null without messages) and mode at start; and one row synthesized-<id> for a turn end without an open turn."""
    kind = F.col("kind")
    inner = rows.where(F.col("open_turn_seq").isNotNull() & (kind.isin("assistant_message", "turn_end") | (F.col("abort_route") == "turn")))
    ends = inner.groupBy("session_id", F.col("open_turn_seq").alias("turn_seq")).agg(
        F.max_by("model", F.when((kind == "assistant_message") & F.col("model").isNotNull(), F.col("seq"))).alias("model"), F.sum(F.when(kind == "assistant_message", F.col("output_tokens"))).alias("output_tokens"),
        F.max(F.when(kind == "turn_end", F.col("ts"))).alias("end_ts"), F.max(F.when(kind == "abort", F.col("ts"))).alias("abort_at"),
    )
    starts = rows.where(kind == "turn_start").select("session_id", F.col("seq").alias("turn_seq"), F.col("event_id").alias("turn_id"), F.col("ts").alias("started_at"), F.col("mode_now").alias("mode"))
    status = F.when(F.col("abort_at").isNotNull(), "aborted").when(F.col("end_ts").isNotNull(), "completed").otherwise("open")
    ended = F.when(F.coalesce("abort_at", "end_ts").isNotNull(), F.greatest("started_at", F.coalesce("abort_at", "end_ts")))
    known = starts.join(ends, ["session_id", "turn_seq"], "left").select("session_id", "turn_seq", "turn_id", "started_at", ended.alias("ended_at"), status.alias("status"), "model", "output_tokens", "mode", F.when(status == "aborted", "abort").alias("abort_reason"))
    lone = rows.where((kind == "turn_end") & F.col("open_turn_seq").isNull())
    made = lone.select("session_id", F.col("seq").alias("turn_seq"), F.concat(F.lit("synthesized-"), "event_id").alias("turn_id"), F.col("ts").alias("started_at"), F.col("ts").alias("ended_at"), F.lit("completed").alias("status"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("long").alias("output_tokens"), F.col("mode_now").alias("mode"), F.lit(None).cast("string").alias("abort_reason"))
    return known.unionByName(made)


def mode_segments(rows: DataFrame) -> DataFrame:
    """F8: one row a mode change; it ends at the next one, else at the last model change after it, else at the session's last event."""
    changes = rows.where(F.col("kind").isin("mode_changed", "model_change"))
    after = by_session().rowsBetween(Window.currentRow, Window.unboundedFollowing)
    model_end = F.last(F.when(F.col("kind") == "model_change", F.col("ts")), ignorenulls=True).over(after)
    next_mode = F.first(F.when(F.col("kind") == "mode_changed", F.col("ts")), ignorenulls=True).over(by_session().rowsBetween(1, Window.unboundedFollowing))
    seg = changes.withColumn("m", model_end).withColumn("nx", next_mode).where(F.col("kind") == "mode_changed")
    return seg.select("session_id", "seq", mode_of(F.col("mode")).alias("mode"), F.col("ts").alias("started_at"), F.greatest("ts", F.coalesce("nx", "m", "last_ts")).alias("ended_at"))


def skill_triggered(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """(skill, call) for tool calls that commit within 49 events after a skill; calls closed at the end of a session count if the skill is among its last 48 events. Buckets of the window's length keep the join to neighbours."""
    span = SKILL_WINDOW
    skills = rows.where(F.col("kind") == "skill_invoked").select("session_id", F.col("seq").alias("skill_seq"), F.col("name").alias("skill"), "last_seq")
    closed = calls.where("commit_seq is not null").select("session_id", "name", "call_index", "commit_seq", F.explode(F.array(F.floor(F.col("commit_seq") / span), F.floor(F.col("commit_seq") / span) - 1)).alias("b"))
    near = skills.withColumn("b", F.floor(F.col("skill_seq") / span)).join(closed, ["session_id", "b"]).where((F.col("commit_seq") > F.col("skill_seq")) & (F.col("commit_seq") <= F.col("skill_seq") + span))
    late = skills.where(F.col("last_seq") - F.col("skill_seq") <= span - 1).join(calls.where("commit_seq is null").select("session_id", "name", "call_index"), "session_id")
    cols = ["session_id", "skill", "skill_seq", "name", "call_index"]
    return near.select(*cols).unionByName(late.select(*cols))


def first_arguments(rows: DataFrame) -> DataFrame:
    """session_id, call_id, arguments: a call's arguments by its first request."""
    asked = rows.select("session_id", "seq", F.posexplode("tool_requests").alias("p", "r"))
    return asked.groupBy("session_id", F.col("r.call_id").alias("call_id")).agg(F.min_by("r.arguments", F.struct("seq", "p")).alias("arguments"))


def user_requested(rows: DataFrame, calls: DataFrame) -> DataFrame:
    """(session_id, start_seq) of calls that a user asked for: of the calls that started with the mark's id the latest that is open then, else the next start with it; for a mark without an id the latest open call of all.

    An as-of match without a join of marks and calls: marks, starts and ends of one id are ordered together. Starts and ends nest, so
    the open call at a mark is the last start before it on the level that the running depth has there.
    """
    any_id = F.lit("*")
    marks = rows.where("kind = 'tool_user_requested'").select("session_id", F.coalesce(F.concat(F.lit("="), "call_id"), any_id).alias("key"), F.lit(2).alias("what"), "seq", F.lit(None).cast("long").alias("start"))
    starts = calls.where("status <> 'orphan'").select("session_id", F.explode(F.array_compact(F.array(F.concat(F.lit("="), "start_call_id"), any_id))).alias("key"), "start_seq", "commit_seq").join(marks.select("session_id", "key").distinct(), ["session_id", "key"], "left_semi")
    point = lambda what, seq: F.struct(F.lit(what).alias("what"), seq.alias("seq"), F.when(F.lit(what == 1), F.col("start_seq")).alias("start"))
    points = starts.select("session_id", "key", F.explode(F.array(point(1, F.col("start_seq")), point(0, F.col("commit_seq")))).alias("p")).select("session_id", "key", "p.*").where("seq is not null")
    order = Window.partitionBy("session_id", "key").orderBy("seq", "what")
    step = F.when(F.col("what") == 1, 1).when(F.col("what") == 0, -1).otherwise(0)
    depth = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = F.first("start", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    leveled = points.unionByName(marks.select("session_id", "key", "what", "seq", "start")).withColumns({"depth": depth, "later": later}).where("what > 0")
    on_level = Window.partitionBy("session_id", "key", "depth").orderBy("seq", "what").rowsBetween(Window.unboundedPreceding, -1)
    found = leveled.withColumn("open", F.last("start", ignorenulls=True).over(on_level)).where("what = 2")
    picked = F.when(F.col("depth") > 0, F.col("open")).when(F.col("key") != any_id, F.col("later"))
    return found.select("session_id", picked.alias("start_seq")).where("start_seq is not null").distinct()


def warnings(rows: DataFrame) -> DataFrame:
    """session_id, kind, ref, at for timestamps that go back, orphan ends, calls left open and session-level aborts."""
    back = F.lag("ts").over(by_session())
    marked = rows.withColumn("_back", F.col("ts") < back)
    kind = F.col("kind")
    found = F.filter(
        F.array(
            F.when(F.col("_back"), F.lit("non_monotonic")), F.when((kind == "tool_complete") & F.col("tool_orphan"), F.lit("orphan_tool")), F.when((kind == "hook_end") & F.col("hook_orphan"), F.lit("orphan_hook")),
            F.when((kind == "turn_end") & F.col("open_turn_seq").isNull(), F.lit("orphan_turn_end")), F.when(F.col("abort_route") == "session", F.lit("session_abort")),
        ),
        lambda x: x.isNotNull(),
    )
    return marked.select("session_id", "event_id", "ts", F.explode(found).alias("kind")).select("session_id", "kind", F.col("event_id").alias("ref"), F.col("ts").alias("at"))


def session_wall(rows: DataFrame) -> DataFrame:
    """session_id, started_at, wall_ms: from the first event to the latest end of a turn, tool, hook, skill or mode segment.

    Every end is the time of some routed event, or the session's last one for what is open then, so one aggregate by session
    finds the latest: starts count as ends of calls do, since no call ends before its start; a turn's start counts once it ends.
    """
    kind, route, ts = F.col("kind"), F.coalesce("abort_route", F.lit("")), F.col("ts")
    marks = kind.isin("tool_start", "tool_complete", "hook_start", "hook_end", "skill_invoked", "mode_changed") | route.isin("tool", "hook")
    at = F.when((kind == "turn_end") | (route == "turn"), F.greatest("ts", "open_turn_ts")).when(marks, ts)
    left = lambda start, end, popped: F.count_if(kind == start) > F.count_if(popped | (kind == end) & ~F.col(f"{start[:4]}_orphan"))
    when = lambda k, c: F.when(kind == k, c)
    each = rows.groupBy("session_id").agg(
        F.min_by("ts", "seq").alias("started_at"), F.max(at).alias("mark"), F.max("last_ts").alias("last_ts"), (left("tool_start", "tool_complete", route == "tool") | left("hook_start", "hook_end", route == "hook")).alias("open"),
        F.max(when("mode_changed", F.col("seq"))).alias("mode"), F.max(when("model_change", F.col("seq"))).alias("model"), F.max_by("ts", when("model_change", F.col("seq"))).alias("model_ts"),
    )
    mode_end = F.when(F.col("mode").isNotNull(), F.when(F.col("model") > F.col("mode"), F.col("model_ts")).otherwise(F.col("last_ts")))
    last = F.greatest("mark", F.when(F.col("open"), F.col("last_ts")), mode_end)
    return each.select("session_id", "started_at", millis(F.col("started_at"), F.coalesce(last, F.col("started_at"))).alias("wall_ms"))
