"""Live telemetry: session state with idle and size limits over typed events, and roll-ups."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..functions import scalars as S
from ..functions.percentiles import ceiling_rank
from ..operators.ranks import pending
from .exports import TYPED

#: Limits of a live session.
IDLE_MS, MOST_BYTES, MOST_EVENTS = 300_000, 16 << 20, 100_000
#: How long a call may be open before the user is told: one that waits for the user, and any other.
BLOCKING_MS, OTHER_MS = 30_000, 300_000
COLUMNS = [c.split()[0] for c in TYPED.split(", ")]
WHOLE = {c.split()[0] for c in TYPED.split(", ") if c.endswith("bigint")}
ALERTS = "session_id string, tool_name string, turn_id string, started_at timestamp, blocking boolean, waited_ms bigint"


def plain(column: str, x):
    """A value of a pandas column as state takes it: missing ones as None."""
    if x is None or x is pd.NaT or x != x:
        return None
    return int(x) if column in WHOLE else x.to_pydatetime() if column == "ts" else x


def split_records(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed events that can be kept, and those that are dropped: records without a session, with bad values, or with names that nobody knows."""
    bad = F.col("session_id").isNull() | F.coalesce(F.col("event_type").isin("error", "unrecognised"), F.lit(True))
    return typed.where(~bad), typed.where(bad)


def dropped_counts(dropped: DataFrame) -> DataFrame:
    """event_type, agent, records of what was dropped; for a table, or for a stream in update mode."""
    return dropped.groupBy("event_type", "agent").agg(F.count("*").alias("records"))


def paired(typed: DataFrame) -> DataFrame:
    """Tool results with the time since their start: within a session, tool and turn a result belongs to the event right before it if that is a start, else it took 0 ms.

    A start that nothing follows is open when its session ends: it becomes a result of status `open`, with the time up to
    the session's end, or without one to its last event.
    """
    w = Window.partitionBy("session_id", "tool_name", "turn_id").orderBy("ts", F.col("event_type") == "tool_result")
    ends = typed.groupBy("session_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "session_end", F.col("ts"))), F.max("ts")).alias("end"))
    rows = typed.where(F.col("event_type").isin("tool_start", "tool_result")).withColumns({"p": F.lag(F.struct("event_type", "ts")).over(w), "is_last": F.lead("ts").over(w).isNull()})
    done, is_open = F.col("event_type") == "tool_result", (F.col("event_type") == "tool_start") & F.col("is_last")
    rows = rows.where(done | is_open).join(ends, "session_id")
    at = F.when(done, F.col("ts")).otherwise(F.col("end"))
    ms = F.when(is_open, S.millis(F.col("ts"), F.col("end"))).when(F.col("p.event_type") == "tool_start", S.millis(F.col("p.ts"), F.col("ts"))).otherwise(0).cast("long")
    return rows.select("session_id", "tool_name", "turn_id", at.alias("ts"), F.when(is_open, "open").otherwise(F.col("status")).alias("status"), ms.alias("duration_ms"))


def session_tools(typed: DataFrame) -> DataFrame:
    """Per session and tool the calls, ok, fail, orphan (open ones), total, longest and nearest-rank percentiles of the time; sources are always builtin here."""
    by, status = ["session_id", "tool_name"], F.col("status")
    calls = paired(typed)
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False))).cast("long")
    agg = calls.groupBy(*by).agg(F.count("*").alias("calls"), n(status == "success").alias("ok"), n(status == "failure").alias("fail"), n(status == "open").alias("orphan"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"))
    return agg.join(ceiling_rank(calls, by, "duration_ms", {"p50": 50, "p95": 95}), by).withColumn("source", F.lit("builtin"))


def session_usage(typed: DataFrame) -> DataFrame:
    """Per session and model the four token directions side by side, sums stopping at the largest long; a session without usage has a row of zeros for the model that it started with, if it named one."""
    ways = ("input", "output", "cache_read", "cache_creation")
    used = F.col("event_type") == "token_usage"
    sums = [F.coalesce(S.saturating_sum(F.when(F.col("direction") == w, F.col("value"))), F.lit(0)).alias(w) for w in ways]
    usage = typed.where(used).groupBy("session_id", "model").agg(*sums)
    start = F.max_by("model", F.when(F.col("event_type") == "session_start", F.col("ts")))
    none = typed.groupBy("session_id").agg(F.bool_or(used).alias("any"), start.alias("model")).where("not any and model is not null")
    return usage.unionByName(none.select("session_id", "model", *[F.lit(0).cast("long").alias(w) for w in ways]))


def session_heads(typed: DataFrame, now: Column) -> DataFrame:
    """Per session its agent and start by its start event (of several the last one's agent and the first one's time), else claude and now; and prompts."""
    started = F.col("event_type") == "session_start"
    agg = typed.groupBy("session_id").agg(F.max_by("agent", F.when(started, F.col("ts"))).alias("agent"), F.min(F.when(started, F.col("ts"))).alias("started_at"), F.count_if(F.col("event_type") == "prompt").cast("long").alias("prompts"))
    return agg.select("session_id", F.coalesce("agent", F.lit("claude")).alias("agent"), F.coalesce("started_at", now).alias("started_at"), "prompts")


class Sessions(StatefulProcessor):
    """A live session's events, kept until it closes: on its end, on a limit (MOST_EVENTS, MOST_BYTES: so state is bounded), or when nothing has arrived for IDLE_MS.

    It then gives its events in order of time (G8), and for each call that is open a result of status `open` at the session's end, or
    without one at its last event. A later event opens it anew (I6); see stored_events for what becomes of both parts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", TYPED)
        self.seen = handle.getValueState("seen", "n bigint, bytes bigint, timer bigint")
        self.closings = handle.getValueState("closings", "n bigint", ttlDurationMs=86_400_000)

    def _close(self, reason: str) -> pd.DataFrame:
        rows = pd.DataFrame(list(self.events.get()), columns=COLUMNS)
        if (timer := self.seen.get()[2]) > 0:
            self.handle.deleteTimer(timer)
        self.seen.clear()
        self.events.clear()
        rows["ts"] = pd.to_datetime(rows["ts"])
        rows = rows.sort_values("ts", kind="stable", na_position="first")
        ended = rows.loc[rows["event_type"] == "session_end", "ts"]
        at = ended.max() if len(ended) else rows["ts"].max()
        calls = rows[rows["event_type"].isin(["tool_start", "tool_result"])].fillna({"turn_id": "", "tool_name": ""})
        last = calls.sort_values(["ts", "event_type"], key=lambda c: c if c.name == "ts" else c == "tool_result", kind="stable").groupby(["tool_name", "turn_id"], sort=True).tail(1)
        left = rows.loc[last.index[last["event_type"] == "tool_start"]].assign(event_type="tool_result", status="open", ts=at)
        number = (self.closings.get()[0] if self.closings.exists() else 0) + 1
        self.closings.update((number,))
        return pd.concat([rows, left]).assign(reason=reason, closing=number)[COLUMNS + ["reason", "closing"]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, size, timer = self.seen.get() if self.seen.exists() else (0, 0, -1)
        ended = False
        for pdf in rows:
            pdf = pdf[COLUMNS]
            n, ended = n + len(pdf), ended or bool((pdf["event_type"] == "session_end").any())
            size += 64 * len(pdf) + int(sum(pdf[c].str.len().sum() for c in ("tool_name", "error_message", "model") if pdf[c].notna().any()))
            self.events.appendList([tuple(plain(c, x) for c, x in zip(COLUMNS, r, strict=True)) for r in pdf.itertuples(index=False, name=None)])
        if timer > 0:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + IDLE_MS
        self.seen.update((n, size, timer))
        self.handle.registerTimer(timer)
        reason = "end" if ended else "events" if n > MOST_EVENTS else "bytes" if size > MOST_BYTES else ""
        if reason:
            yield self._close(reason)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.seen.exists():
            n, size, _ = self.seen.get()
            self.seen.update((n, size, -1))
            yield self._close("idle")

    def close(self) -> None:
        pass


def closed_sessions(typed: DataFrame) -> DataFrame:
    """The events of each session that closes, with the reason, from a stream of typed events; records that split_records drops are left out."""
    return split_records(typed)[0].groupBy("session_id").transformWithStateInPandas(Sessions(), TYPED + ", reason string, closing bigint", "append", "processingTime")


def persist(closed: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes closed sessions to a store that grows by one folder a batch; a batch that runs again replaces its own folder, so nothing counts twice. Folders bear the query's id, which its checkpoint keeps: a new or lost checkpoint begins folders of its own and replaces none."""

    def flush(batch: DataFrame, number: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "run"
        batch.write.mode("overwrite").parquet(f"{path}/run={run}/batch={number}")

    return closed.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)


class WaitingCalls(StatefulProcessor):
    """Tells of a live session's call once it has been open for BLOCKING_MS (tools that wait for the user) or OTHER_MS after it arrived. A timer a call; its result, a later start of the same call, or the session's end takes the timer back. The session stays open, and a call is told of once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # a session that never ends is forgotten after a day
        self.open = handle.getMapState("open", "tool string, turn string", "started timestamp, arrived bigint, due bigint", ttlDurationMs=86_400_000)

    def _forget(self, call: tuple) -> None:
        if not self.open.containsKey(call):
            return
        due = self.open.getValue(call)[2]
        self.open.removeKey(call)
        if due > 0 and not any(v[2] == due for _, v in self.open.iterator()):
            self.handle.deleteTimer(due)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        seen = pd.concat([r[["event_type", "tool_name", "turn_id", "ts"]] for r in rows])
        seen["order"] = seen["event_type"] == "tool_result"
        for kind, tool, turn, ts, _ in seen.sort_values(["ts", "order"], kind="stable", na_position="first").itertuples(index=False, name=None):
            call = (plain("tool_name", tool) or "", plain("turn_id", turn) or "")
            if kind in ("tool_start", "tool_result"):
                self._forget(call)
            if kind == "tool_start":
                due = now + (BLOCKING_MS if call[0] in S.USER_BLOCKING else OTHER_MS)
                self.open.updateValue(call, (plain("ts", ts), now, due))
                self.handle.registerTimer(due)
        if (seen["event_type"] == "session_end").any():
            for call in [k for k, _ in self.open.iterator()]:
                self._forget(call)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, at = timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs()
        told = [(k, v) for k, v in self.open.iterator() if 0 < v[2] <= at]
        for call, (started, arrived, _) in told:
            self.open.updateValue(call, (started, arrived, -1))
        if told:
            yield pd.DataFrame([(key[0], k[0], k[1], started, k[0] in S.USER_BLOCKING, now - arrived) for k, (started, arrived, _) in told], columns=[c.split()[0] for c in ALERTS.split(", ")])

    def close(self) -> None:
        pass


def live_alerts(typed: DataFrame) -> DataFrame:
    """session_id, tool_name, turn_id, started_at, blocking, waited_ms of calls of live sessions that wait too long, from a stream of typed events."""
    return split_records(typed)[0].groupBy("session_id").transformWithStateInPandas(WaitingCalls(), ALERTS, "append", "processingTime")


class DropCounts(StreamingQueryListener):
    """The counts that observed() attaches to running queries, added up over their batches: {name: {signal: {dropped, kept}}}."""

    def __init__(self):
        self.counts: dict[str, dict[str, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            held = self.counts.setdefault(name, {})
            for k, v in row.asDict().items():
                held[k] = held.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(typed: DataFrame, name: str) -> DataFrame:
    """Typed events, counted as they pass: per signal those that are kept (kept_log, ...) and those that split_records drops (dropped_log, ...). A running stream reports them by batch; see DropCounts."""
    bad = F.col("session_id").isNull() | F.coalesce(F.col("event_type").isin("error", "unrecognised"), F.lit(True))
    of = lambda signal, c: F.count_if(F.coalesce(F.col("signal") == signal, F.lit(False)) & c)
    counts = [of(x, c).alias(f"{what}_{x}") for x in ("log", "metric", "trace", "unknown") for what, c in (("kept", ~bad), ("dropped", bad))]
    return typed.observe(name, *counts)


def error_sink(typed: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Writes what split_records drops to Parquet, a folder a signal."""
    return split_records(typed)[1].writeStream.partitionBy("signal").option("path", path).option("checkpointLocation", checkpoint).format("parquet")


def stored_events(stored: DataFrame, late: str = "merge") -> DataFrame:
    """The events of a store that persist wrote (with its column batch; closing numbers a session's closings). Of a session that closed, and opened again by late events, `merge` takes all its parts (and drops results that an earlier close made up), `replace` the last one only."""
    if late == "replace":
        latest = Window.partitionBy("session_id")
        return stored.withColumn("_last", F.max(F.struct("batch", "closing")).over(latest)).where(F.struct("batch", "closing") == F.col("_last")).drop("_last")
    if late != "merge":
        raise ValueError(f"late must be merge or replace, not {late!r}")
    return stored.where(~F.coalesce((F.col("event_type") == "tool_result") & (F.col("status") == "open"), F.lit(False)))


def idle_windows(typed: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """The same grouping by event time: native session windows with a watermark."""
    return typed.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "tool_result").alias("tools")).select("session_id", "w.start", "w.end", "events", "tools")


def waiting_calls(typed: DataFrame, now: Column) -> DataFrame:
    """Calls of sessions without an end that wait long enough to tell the user, from their stored or collected events; see ranks.pending."""
    w = Window.partitionBy("session_id", "tool_name", "turn_id").orderBy("ts", F.col("event_type") == "tool_result")
    ended = typed.where("event_type = 'session_end'").select("session_id").distinct()
    rows = typed.where(F.col("event_type").isin("tool_start", "tool_result")).withColumn("n", F.lead("ts").over(w))
    left = rows.where("event_type = 'tool_start' and n is null").join(ended, "session_id", "left_anti")
    return pending(left.select("session_id", F.col("tool_name").alias("name"), F.unix_micros("ts").alias("start_seq"), F.col("ts").alias("started_at"), F.lit("open_at_end").alias("status")), now)
