"""The store on disk: replacement by id, touched partitions, pruning, re-runs."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanloom.sources import sessionstore
from spanloom.sources.sessionstore import DAY_MS, SESSIONS, TOOLS, TURNS, SessionStore

NOW = 1_700_000_000_000


def session(i, started, model="m"):
    return (i, "copilot", model, started, None, f"/s/{i}", 1, 1, 2, None, None, 1, None, "{}")


def batch(spark, sessions, tools=(), turns=()):
    return (spark.createDataFrame([session(*s) for s in sessions], SESSIONS), spark.createDataFrame([(s, t, "builtin", n, 5, None, None) for s, t, n in tools], TOOLS), spark.createDataFrame([(s, i, None, k, None, None, "m") for s, i, k in turns], TURNS))


@pytest.fixture
def store(spark, tmp_path):
    return SessionStore(spark, str(tmp_path / "store"), parts=8)


def tools_of(store):
    return {(r["session_id"], r["tool_name"], r["call_count"]) for r in store.table("tools_loaded").collect()}


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_an_empty_store(store):
    assert store.table("sessions").count() == 0 and store.prune(NOW, DAY_MS) == 0
    assert store.stats().first().asDict() == {"sessions": 0, "tools_loaded": 0, "turn_buckets": 0, "oldest_started_ms": None, "newest_started_ms": None, "size_bytes": 0}


def test_sessions_and_children_are_replaced(spark, store):
    assert store.upsert(*batch(spark, [("a", NOW), ("b", NOW)], [("a", "x", 1), ("a", "y", 1), ("b", "x", 1)], [("a", 0, 1), ("a", 1, 2)]), at_ms=1) == 2
    assert store.upsert(*batch(spark, [("a", NOW, "m2")], [("a", "z", 9)]), at_ms=2) == 1
    assert tools_of(store) == {("a", "z", 9), ("b", "x", 1)} and store.table("turn_buckets").count() == 0
    assert {(r["id"], r["dominant_model"], r["ingested_at"]) for r in store.table("sessions").collect()} == {("a", "m2", 2), ("b", "m", 1)}
    assert [r["id"] for r in store.lookup("b").collect()] == ["b"] and store.lookup("zz").count() == 0


def test_only_touched_partitions_are_rewritten(spark, store):
    ids = [f"s{i}" for i in range(40)]
    store.upsert(*batch(spark, [(i, NOW - (n % 3) * DAY_MS) for n, i in enumerate(ids)], [(i, "x", 1) for i in ids]), at_ms=1)
    before = files(store.path)
    store.upsert(*batch(spark, [("s0", NOW)], [("s0", "y", 1)]), at_ms=2)
    after = files(store.path)
    part = spark.range(1).select(store._part(F.lit("s0"))).first()[0]
    touched = {p for p in before if p not in after or after[p] != before[p]} | set(after) - set(before)
    assert touched and all(f"/part={part}/day=2023-11-14/" in p for p in touched)
    assert len(tools_of(store)) == 40 and ("s0", "y", 1) in tools_of(store)


def test_a_session_that_moves_to_another_day_leaves_nothing_behind(spark, store):
    store.upsert(*batch(spark, [("a", NOW)], [("a", "x", 1)]), at_ms=1)
    store.upsert(*batch(spark, [("a", NOW - 5 * DAY_MS)], [("a", "x", 2)]), at_ms=2)
    assert tools_of(store) == {("a", "x", 2)} and store.table("sessions").count() == 1
    assert {d for d in os.listdir(next(Path(store.path, "sessions").glob("part=*")))} == {"day=2023-11-09"}


def test_a_batch_that_runs_again_changes_nothing(spark, store):
    made = batch(spark, [("a", NOW), ("b", None), ("a", NOW - 1), (None, NOW)], [("a", "x", 1), ("b", "x", 1), ("zz", "x", 1)])
    assert store.upsert(*made, at_ms=1) == 2
    first = sorted(map(str, store.table("sessions").collect())), tools_of(store)
    store.upsert(*made, at_ms=1)
    assert (sorted(map(str, store.table("sessions").collect())), tools_of(store)) == first and tools_of(store) == {("a", "x", 1), ("b", "x", 1)}
    assert store.upsert(*batch(spark, []), at_ms=3) == 0


def test_episodes_are_kept_until_the_session_is_replaced(spark, store):
    store.upsert(*batch(spark, [("a", NOW), ("b", NOW)]), at_ms=1)
    eps = spark.createDataFrame([("a", '{"turns": 1}'), ("zz", "{}")], "session_id string, episodes_json string")
    assert store.upsert_episodes(eps, at_ms=2) == 1
    held = lambda: {r["session_id"]: r["episodes_json"] for r in store.table("episodes").collect()}
    assert held() == {"a": '{"turns": 1}', "b": "{}"}
    store.upsert(*batch(spark, [("a", NOW)]), at_ms=3)
    assert held() == {"a": "{}", "b": "{}"}


def test_prune_counts_and_cascades(spark, store):
    rows = [("old", NOW - 60 * DAY_MS), ("edge-old", NOW - 30 * DAY_MS - 1), ("edge-new", NOW - 30 * DAY_MS), ("new", NOW), ("none", None)]
    store.upsert(*batch(spark, rows, [(r[0], "x", 1) for r in rows], [(r[0], 0, 1) for r in rows]), at_ms=1)
    assert store.prune(NOW, 30 * DAY_MS, dry_run=True) == 2 and store.table("sessions").count() == 5
    before = files(store.path)
    assert store.prune(NOW, 30 * DAY_MS) == 2
    left = {"edge-new", "new", "none"}
    assert {r["id"] for r in store.table("sessions").collect()} == left
    assert {r["session_id"] for t in ("tools_loaded", "turn_buckets", "episodes") for r in store.table(t).collect()} == left
    untouched = {p: t for p, t in files(store.path).items() if "day=2023-10-15" not in p}
    assert untouched and all(before[p] == t for p, t in untouched.items())
    assert {r["id"] for r in store.newer(NOW, 30 * DAY_MS).collect()} == {"edge-new", "new"} and store.stats().first()["size_bytes"] > 0


def test_a_stream_writes_through_the_store(spark, store, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def split(rows):
        made = batch(spark, [])
        s = rows.selectExpr("id", "'copilot' agent", "'m' dominant_model", "started_at", "cast(null as bigint) duration_ms", "'/p' raw_path", "1L raw_mtime", *[f"cast(null as bigint) {c}" for c in ("total_input_tokens", "total_output_tokens", "total_cache_read", "total_cache_creation")], "1L schema_version", "cast(null as bigint) ingested_at", "'{}' analysis_report_json")
        return s, rows.selectExpr("id session_id", "'x' tool_name", "'builtin' source", "n call_count", "0L total_duration_ms", "cast(null as bigint) tokens", "cast(null as string) token_source"), made[2]

    for n, text in enumerate(('{"id": "a", "started_at": 1, "n": 1}\n{"id": "b", "started_at": 2, "n": 1}', '{"id": "a", "started_at": 1, "n": 7}')):
        (source / f"{n}.json").write_text(text)
        query = spark.readStream.schema("id string, started_at long, n long").json(str(source)).writeStream.foreachBatch(store.sink(split, lambda: 5)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert tools_of(store) == {("a", "x", 7), ("b", "x", 1)}


def test_days_of_starts(spark):
    rows = spark.createDataFrame([(0,), (DAY_MS - 1,), (-1,), (None,)], "at long").select(sessionstore.day_of(F.col("at"))).collect()
    assert [r[0] for r in rows] == ["1970-01-01", "1970-01-01", "1969-12-31", "none"] and sessionstore._day_text(-1) == "1969-12-31"
