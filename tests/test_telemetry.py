"""Telemetry: records to typed events, roll-ups, live sessions, late events and the store of closed sessions."""

import json
import time
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.streaming import telemetry

T0 = datetime(2024, 1, 1)
FIELDS = telemetry.COLUMNS


def event(session, kind, at, **more):
    return tuple({"session_id": session, "event_type": kind, "agent": "codex", "ts": T0 + timedelta(seconds=at), **more}.get(c) for c in FIELDS)


def typed(spark, rows):
    return spark.createDataFrame(rows, telemetry.TYPED)


ROWS = [
    event("a", "session_start", 0, model="m1"), event("a", "tool_start", 1, tool_name="x", turn_id="1"), event("a", "tool_result", 3, tool_name="x", turn_id="1", status="success"), event("a", "tool_result", 4, tool_name="x", turn_id="2", status="failure"),
    event("a", "tool_start", 5, tool_name="y", turn_id="1"), event("a", "prompt", 6), event("a", "session_end", 9),
    event("b", "tool_start", 1, tool_name="x"), event("b", "token_usage", 2, model="m", direction="input", value=5), event("b", "token_usage", 8, model="m", direction="cache_read", value=7),
]


def test_rollup_of_a_session(spark):
    df = typed(spark, ROWS)
    tools = {(r["session_id"], r["tool_name"]): r for r in telemetry.session_tools(df).collect()}
    x = tools["a", "x"]
    assert (x["calls"], x["ok"], x["fail"], x["orphan"], x["total_ms"], x["max_ms"], x["p50"], x["p95"], x["source"]) == (2, 1, 1, 0, 2000, 2000, 0, 2000, "builtin")
    assert (tools["a", "y"]["orphan"], tools["a", "y"]["total_ms"], tools["b", "x"]["orphan"], tools["b", "x"]["total_ms"]) == (1, 4000, 1, 7000)
    usage = {(r["session_id"], r["model"]): tuple(r)[2:] for r in telemetry.session_usage(df).collect()}
    assert usage == {("a", "m1"): (0, 0, 0, 0), ("b", "m"): (5, 0, 7, 0)}
    now = datetime(2025, 1, 1)
    assert {tuple(r) for r in telemetry.session_heads(df, F.lit(now)).collect()} == {("a", "codex", T0, 1), ("b", "claude", now, 0)}


def test_bad_records_are_counted(spark):
    good, bad = telemetry.split_records(typed(spark, [*ROWS, event(None, "tool_start", 0), event("a", "error", 0), event("a", "unrecognised", 0), event("a", None, 0)]))
    assert good.count() == len(ROWS) and {(r[0], r[2]) for r in telemetry.dropped_counts(bad).collect()} == {("tool_start", 1), ("error", 1), ("unrecognised", 1), (None, 1)}


def test_waiting_calls(spark):
    rows = [event("w", "tool_start", 0, tool_name="ask_user"), event("w", "tool_start", 0, tool_name="slow"), *ROWS]
    got = telemetry.waiting_calls(typed(spark, rows), F.lit(T0 + timedelta(seconds=60))).collect()
    assert [(r["session_id"], r["name"], r["blocking"]) for r in got] == [("w", "ask_user", True)]


def write_batch(folder, number, rows):
    lines = [json.dumps({c: v.isoformat() if isinstance(v, datetime) else v for c, v in zip(FIELDS, r, strict=True) if v is not None}) for r in rows]
    (folder / f"{number}.json").write_text("\n".join(lines))


def test_live_sessions_close_persist_and_open_again(spark, tmp_path, monkeypatch):
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        source, store = tmp_path / "in", str(tmp_path / "store")
        source.mkdir()

        def run(parts):
            """Until the store has so many closings; while idle timers are set, a stream does not end by itself."""
            stream = spark.readStream.schema(telemetry.TYPED).json(str(source))
            query = telemetry.persist(telemetry.closed_sessions(stream), store, str(tmp_path / "cp")).trigger(processingTime="1 second").start()
            try:
                for _ in range(60):
                    query.awaitTermination(2)
                    if (tmp_path / "store").exists() and len({r[0] for r in spark.read.schema(telemetry.TYPED + ", reason string, closing long, run string, batch long").parquet(store).select("batch").distinct().collect()}) == parts:
                        return
                raise AssertionError(f"no session closed: {query.lastProgress}")
            finally:
                query.stop()

        write_batch(source, 1, [r for r in reversed(ROWS) if r[0] == "a"] + [event("b", "tool_start", 1, tool_name="x"), event("b", "error", 1)])
        run(1)
        stored = spark.read.parquet(store)
        rows = sorted(stored.collect(), key=lambda r: r["ts"])
        assert {r["session_id"] for r in rows} == {"a"} and {r["reason"] for r in rows} == {"end"}
        made = [r for r in rows if r["status"] == "open"]
        assert len(rows) == 8 and [(r["tool_name"], r["ts"]) for r in made] == [("y", T0 + timedelta(seconds=9))]
        write_batch(source, 2, [event("a", "tool_result", 7, tool_name="y", turn_id="1", status="success"), event("a", "session_end", 20)])
        run(2)
        stored = spark.read.parquet(store)
        late = {way: {r["tool_name"]: r for r in telemetry.session_tools(telemetry.stored_events(stored, way)).collect()} for way in ("merge", "replace")}
        assert (late["merge"]["y"]["ok"], late["merge"]["y"]["orphan"], late["merge"]["y"]["total_ms"]) == (1, 0, 2000) and late["merge"]["x"]["calls"] == 2
        assert set(late["replace"]) == {"y"} and late["replace"]["y"]["total_ms"] == 0
        assert {r["closing"] for r in stored.collect()} == {1, 2} and stored.select("run").distinct().count() == 1
        with pytest.raises(ValueError):
            telemetry.stored_events(stored, "other")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Clock:
    """Stands for Spark's state and timers: a map state, and a processing time that the test sets."""

    def __init__(self):
        self.now, self.timers, self.state = 0, set(), {}

    # the handle
    def getMapState(self, *_, **__):
        return self

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    # the map
    def containsKey(self, key):
        return key in self.state

    def getValue(self, key):
        return self.state[key]

    def updateValue(self, key, value):
        self.state[key] = value

    def removeKey(self, key):
        del self.state[key]

    def iterator(self):
        return iter(list(self.state.items()))

    # the timer values
    def getCurrentProcessingTimeInMs(self):
        return self.now

    def getExpiryTimeInMs(self):
        return self.now


def test_alerts_by_a_clock():
    clock, calls = Clock(), telemetry.WaitingCalls()
    calls.init(clock)

    def arrive(at, *rows):
        clock.now = at
        return list(calls.handleInputRows(("s",), iter([pd.DataFrame([event("s", *r[:2], **r[2]) for r in rows], columns=FIELDS)]), clock))

    def pass_until(at):
        told = []
        for due in sorted(t for t in clock.timers if t <= at):
            clock.now = due
            clock.timers.discard(due)
            told += [tuple(r) for df in calls.handleExpiredTimer(("s",), clock, clock) for r in df[["tool_name", "turn_id", "blocking", "waited_ms"]].itertuples(index=False)]
        return told

    assert arrive(0, ("tool_start", 0, {"tool_name": "ask_user"}), ("tool_start", 0, {"tool_name": "slow", "turn_id": "1"}), ("tool_start", 1, {"tool_name": "quick"}), ("tool_result", 2, {"tool_name": "quick"})) == []
    assert clock.timers == {30_000, 300_000}
    assert pass_until(29_999) == [] and pass_until(30_000) == [("ask_user", "", True, 30_000)]
    arrive(40_000, ("tool_start", 40, {"tool_name": "ask_user"}))  # a later start replaces the first
    assert clock.timers == {70_000, 300_000}
    arrive(50_000, ("tool_result", 50, {"tool_name": "ask_user"}))  # the result takes the timer back
    assert clock.timers == {300_000} and pass_until(200_000) == []
    assert pass_until(300_000) == [("slow", "1", False, 300_000)] and pass_until(10**9) == [] and len(clock.state) == 1
    arrive(400_000, ("tool_start", 400, {"tool_name": "a"}), ("tool_start", 400, {"tool_name": "b"}))
    arrive(400_001, ("tool_result", 401, {"tool_name": "a"}))
    assert clock.timers == {700_000}  # b still waits for the same timer
    arrive(400_002, ("session_end", 402, {}))
    assert clock.timers == set() and clock.state == {}


@pytest.fixture
def stateful(spark):
    conf = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def test_alerts_on_a_stream(stateful, tmp_path, monkeypatch):
    spark, source = stateful, tmp_path / "in"
    monkeypatch.setattr(telemetry, "BLOCKING_MS", 1_500)
    source.mkdir()
    write_batch(source, 1, [event("w", "tool_start", 0, tool_name="ask_user"), event("w", "tool_start", 0, tool_name="slow"), event("v", "tool_start", 0, tool_name="ask_user"), event("v", "tool_result", 1, tool_name="ask_user", status="success")])
    query = telemetry.live_alerts(spark.readStream.schema(telemetry.TYPED).json(str(source))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            query.awaitTermination(2)
            rows = spark.read.schema(telemetry.ALERTS).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out").exists() else []
            if rows:
                break
        assert [(r["session_id"], r["tool_name"], r["blocking"]) for r in rows] == [("w", "ask_user", True)] and rows[0]["waited_ms"] >= 1_500
    finally:
        query.stop()


def test_counts_of_a_running_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [event("a", "prompt", 0, signal="log"), event("a", "token_usage", 0, signal="metric"), event(None, "error", 0, signal="metric", identity="x"), event(None, "unrecognised", 0, signal="trace", identity="y")]
    listener = telemetry.DropCounts()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(telemetry.TYPED).json(str(source)).transform(telemetry.observed, "telemetry")
        query = telemetry.error_sink(stream, str(tmp_path / "bad"), str(tmp_path / "cp")).start()
        try:
            for n in range(2):
                write_batch(source, n, rows)
                query.processAllAvailable()
            for _ in range(50):
                if listener.counts.get("telemetry", {}).get("dropped_trace") == 2:
                    break
                time.sleep(0.2)
        finally:
            query.stop()
    finally:
        spark.streams.removeListener(listener)
    assert {k: v for k, v in listener.counts["telemetry"].items() if v} == {"kept_log": 2, "kept_metric": 2, "dropped_metric": 2, "dropped_trace": 2}
    kept = spark.read.parquet(str(tmp_path / "bad"))
    assert {(r["signal"], r["n"]) for r in kept.groupBy("signal").agg(F.count("*").alias("n")).collect()} == {("metric", 2), ("trace", 2)}
    assert telemetry.dropped_counts(kept).agg(F.sum("records")).first()[0] == 4
