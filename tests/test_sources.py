import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import audit
from spanloom.sources import jsonl, store


def event(kind, i, **data):
    return json.dumps({"type": kind, "id": f"e{i}", "timestamp": f"2024-01-01T00:00:{i:02d}Z", "data": data})


def test_log_lines_become_events_and_warnings(spark, tmp_path):
    folder = tmp_path / "abc"
    folder.mkdir()
    start = event("session.start", 0, sessionId="S", version=1, producer="p", copilotVersion="1.0", startTime="2024-01-01T00:00:00Z", context={"cwd": "/w"}, alreadyInUse=False)
    notice = "<tools_changed_notice>New tools available: mcp__a__b, plain</tools_changed_notice>"
    text = [start, "", "no json", event("user.message", 3, content="x", interactionId="i", transformedContent=notice), event("tool.execution_start", 4, toolCallId="c", toolName="mcp__a__b", arguments={}), event("tool.execution_complete", 5, success=True), event("odd.thing", 6)]
    (folder / "events.jsonl").write_text("\n".join(text) + '\n{"type": "abort", "da')
    events, warnings = jsonl.decode(jsonl.lines(spark, str(tmp_path / "*/events.jsonl")), live=F.lit(True))
    got = {r["seq"]: r for r in events.collect()}
    assert [(got[s]["kind"]) for s in sorted(got)] == ["session_start", "user_message", "tool_start", "unknown"]
    assert got[3]["loaded_tools"] == ["mcp__a__b"] and got[4]["name"] == "mcp__a__b" and got[6]["event_id"] == ""
    assert sorted(r["line_no"] for r in warnings.collect()) == [2, 5]
    assert [r["session_id"] for r in jsonl.sessions(events).collect()] == ["S"]


def test_fields_that_nested_parts_must_have(spark, tmp_path):
    message = {"messageId": "m", "model": "x", "content": "", "interactionId": "i", "outputTokens": 1}
    full = {"toolCallId": "c", "name": "bash", "arguments": {"a": 1}, "type": "function"}
    text = [event("assistant.message", 0, **message), event("assistant.message", 1, **message, toolRequests=[full]), event("assistant.message", 2, **message, toolRequests=[full, {k: v for k, v in full.items() if k != "type"}]), event("assistant.message", 3, **message, toolRequests="none"),
            event("tool.execution_complete", 4, toolCallId="c", success=False, error={"message": "m"}), event("tool.execution_complete", 5, toolCallId="c", success=False, error={"code": "1"}), event("assistant.message", 6, **message, toolRequests=[])]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "events.jsonl").write_text("\n".join(text))
    events, warnings = jsonl.decode(jsonl.lines(spark, str(tmp_path / "*/events.jsonl")))
    assert sorted(r["line_no"] for r in warnings.collect()) == [2, 3, 5] and sorted(r["seq"] for r in events.collect()) == [0, 1, 4, 6]
    assert [r["arguments"] for r in events.where("seq = 1").selectExpr("inline(tool_requests)").collect()] == ['{"a":1}']


def test_windows():
    assert jsonl.since_seconds("2h") == 7200 and jsonl.since_seconds("all") is None
    with pytest.raises(ValueError):
        jsonl.since_seconds("soon")


def test_unknown_agents_are_refused():
    with pytest.raises(ValueError):
        jsonl.decoder("other")


def test_tool_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"mcpServers": {"a": {}}, "servers": {"b": {"tools": ["x", "y"]}}}))
    assert {tuple(r) for r in jsonl.server_config(spark, str(tmp_path / "c.json")).collect()} == {("a", None), ("b", "x"), ("b", "y")}


def test_session_selectors(spark):
    ids = [f"00000000-0000-0000-0000-00000000000{i}" for i in range(3)]
    refs = spark.createDataFrame([(x, f"/s/{x}/events.jsonl", i) for i, x in enumerate(ids)], "id string, path string, mtime long")
    pick = lambda s: [r["id"] for r in store.selected(refs, s).collect()]
    assert pick("latest") == [ids[2]] and pick("previous") == [ids[1]] and pick(ids[0]) == [ids[0]] and pick(f"/s/{ids[1]}/") == [ids[1]] and pick("/none") == []
    with pytest.raises(ValueError):
        pick("soon")
    assert [r[0] for r in spark.createDataFrame([("claude",), ("odd",), (None,)], "a string").select(store.agent_of(F.col("a"))).collect()] == ["claude", "copilot", "copilot"]


def test_ingest_counts_failures_and_fails_only_if_nothing_succeeds(spark):
    old = spark.createDataFrame([("a", 1, "f0")], "id string, ingested_at long, file_path string")
    new = spark.createDataFrame([("a", 2, "f1"), ("b", 2, "f2")], "id string, ingested_at long, file_path string")
    bad = spark.createDataFrame([("f1",), ("f3",), ("f3",)], "file_path string")
    assert tuple(store.outcome(new, bad).first()) == (2, 1)
    assert {tuple(r)[:2] for r in store.ingest(old, new, bad).collect()} == {("a", 2), ("b", 2)}
    with pytest.raises(ValueError):
        store.ingest(old, new.limit(0), bad)


def test_raw_lines_and_their_events(spark):
    raw = spark.createDataFrame([("/x/s1/events.jsonl", 0, "{}"), ("/x/s1/events.jsonl", 1, "no"), ("/x/s2/events.jsonl", 0, '{"a": 1}'), ("/x/s2/events.jsonl", 1, "[1]")], "file_path string, line_no long, line string")
    assert {(r["session_id"], r["line_no"]) for r in audit.raw_lines(raw).collect()} == {("s1", 1), ("s2", 1)}
    assert [r["session_id"] for r in audit.raw_lines(raw, ids=("s2",)).collect()] == ["s2"] and [r["session_id"] for r in audit.raw_lines(raw, limit=1).collect()] == ["s1"]
    events = spark.createDataFrame([("/x/s2/events.jsonl", 0, "abort")], "file_path string, seq long, kind string")
    assert [(r["session_id"], r["kind"]) for r in audit.aligned(audit.raw_lines(raw), events).collect()] == [("s2", "abort")]


def test_windows_of_the_store(spark):
    sessions = spark.createDataFrame([("a", 100), ("b", 900), ("c", None)], "id string, started_at long")
    kids = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "session_id string, n long")
    assert {r["n"] for r in store.in_window(kids, sessions, 1000, 200).collect()} == {2} and {r["n"] for r in store.in_window(kids, sessions, 1000, None).collect()} == {1, 2}
    assert [r["id"] for r in store.dashboard(sessions, 1000, most=1).collect()] == ["b"] and store.lookup(kids, "b").count() == 1 and store.lookup(kids, "z").count() == 0
