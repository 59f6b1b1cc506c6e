"""Audits, marks of users, report columns and shapes, and sources that need no log."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators import audit, episodes, ranks
from spanloom.operators.bundle import Episodes
from spanloom.sources import jsonl, reports, store

T0 = datetime(2024, 1, 1)


def cut(value, most=60):
    if isinstance(value, str):
        return value if len(value) <= most else value[:most] + "..."
    if isinstance(value, list):
        return [cut(x, most) for x in value]
    return {k: cut(v, most) for k, v in value.items()} if isinstance(value, dict) else value


def test_long_values_are_cut_and_keys_stay(spark):
    values = [{"a": "x" * 61, "b": "y" * 60, "k" * 80: "z" * 100, "n": list(range(60)), "deep": [{"q": "w" * 70}, "s"], "e": '"' * 61}, ["v" * 200], "u" * 90, {}, {"a": ""}]
    rows = spark.createDataFrame([(json.dumps(v),) for v in values], "x string")
    assert [json.loads(r[0]) for r in rows.select(S.shorten(F.col("x"))).collect()] == [cut(v) for v in values]
    long = spark.createDataFrame([(json.dumps({"a": ["s"] * 20_000, "b": "t" * 100}),)], "x string").select(S.shorten(F.col("x"))).first()[0]
    assert json.loads(long)["b"] == "t" * 60 + "..."


EVENTS = "session_id string, seq long, event_id string, ts timestamp, kind string, name string, call_id string, model string, output_tokens long, mode string, success boolean, error_message string"


def log(spark, sessions):
    rows = [(s, n, f"{s}-{n}", T0 + timedelta(seconds=n), kind, name, call, None, None, None, True, None) for s, events in sessions.items() for n, (kind, name, call) in enumerate(events)]
    return spark.createDataFrame(rows, EVENTS)


def asked(events):
    """A stack machine: starts of calls that a user asked for."""
    stack, pending, found = [], set(), set()
    for n, (kind, _, call) in enumerate(events):
        if kind == "tool_start":
            if call in pending:
                pending.discard(call)
                found.add(n)
            stack.append((n, call))
        elif kind in ("tool_complete", "abort") and stack:
            stack.pop()
        elif kind == "tool_user_requested":
            open_ = [s for s, c in stack if c == call] if call is not None else [s for s, _ in stack]
            if open_:
                found.add(open_[-1])
            elif call is not None:
                pending.add(call)
    return found


def test_marks_of_users_equal_a_stack_machine(spark):
    rng = random.Random(2)
    kinds = ["tool_start", "tool_start", "tool_complete", "tool_user_requested", "abort"]
    sessions = {f"s{i}": [(rng.choices(kinds, (4, 4, 5, 4, 1))[0], "bash", rng.choice(["a", "b", "c", None])) for _ in range(60)] for i in range(25)}
    e = Episodes(log(spark, sessions))
    got = {tuple(r) for r in episodes.user_requested(e.rows, e.calls).collect()}
    assert got == {(s, n) for s, events in sessions.items() for n in asked(events)} and len(got) > 100
    assert sum(r["user_requested"] for r in ranks.tool_rank(e.calls, episodes.user_requested(e.rows, e.calls)).collect()) == len(got)


def test_firsts_of_groups(spark):
    rows = spark.range(1000).selectExpr("id % 3 g", "(id * 7919) % 1000 x")
    got = audit.first_k(rows, ["g"], ["x"], 3)
    want = {(g, x) for g in range(3) for x in sorted(i * 7919 % 1000 for i in range(1000) if i % 3 == g)[:3]}
    assert {(r["g"], r["x"]) for r in got.collect()} == want
    assert got._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_a_whole_audit(spark, tmp_path):
    def line(kind, i, **data):
        return json.dumps({"type": kind, "id": f"e{i}", "timestamp": f"2024-01-01T00:00:{i:02d}Z", "data": data})

    start = {"sessionId": "S", "version": 1, "producer": "p", "startTime": "2024-01-01T00:00:00Z", "context": {"cwd": "/w"}, "alreadyInUse": False}
    for n in range(3):
        (tmp_path / f"f{n}").mkdir()
        text = [line("session.start", 0, copilotVersion=f"1.{n % 2}", **start), "no json", line("odd.thing", 2, text="x" * 70), line("abort", 3), line("odd.thing", 4), line("assistant.turn_start", 5, turnId="t"), "[]"]
        (tmp_path / f"f{n}" / "events.jsonl").write_text("\n".join(text))
    lines = jsonl.lines(spark, str(tmp_path / "*/events.jsonl"))
    events, warnings = jsonl.decode(lines)
    made = {k: v.collect() for k, v in audit.classify(audit.raw_lines(lines), events, warnings, jsonl.sessions(events)).items()}
    assert made["head"][0].asDict() == {"sessions": 3, "events": 12} and {tuple(r) for r in made["versions"]} == {("1.0", 2), ("1.1", 1)}
    [odd] = made["unknown"]
    assert (odd["type"], odd["n"], odd["example_session"]) == ("odd.thing", 6, "f0") and [json.loads(x)["data"] for x in odd["samples"]] == [{"text": "x" * 60 + "..."}, {}]
    assert [(r["kind"], r["n"], r["locations"]) for r in made["warnings"]] == [("json", 9, ["f0:line 1", "f0:line 3", "f0:line 6"])]
    assert {r["kind"]: r["n"] for r in made["kinds"]} == {"session_start": 3, "unknown": 6, "turn_start": 3} and {r["pair"]: r["class"] for r in made["balance"]} == {"turn": "severe"}


def test_columns_of_reports(spark):
    sessions = {"a": [("turn_start", None, None), ("skill_invoked", "s", None), ("tool_start", "bash", "c"), ("tool_complete", None, "c"), ("turn_end", None, None)], "b": [("turn_start", None, None)]}
    e = Episodes(log(spark, sessions))
    usage = spark.createDataFrame([("a", "m", 10, 5, 30, 10), ("a", "n", 0, 0, 0, 0)], "session_id string, model string, input_tokens long, output_tokens long, cache_read long, cache_write long")
    files = spark.createDataFrame([("b", 77)], "session_id string, size long")
    got = {r["session_id"]: (r["cache_pct"], r["bytes"]) for r in ranks.session_list(e.turns, e.walls, usage, files).collect()}
    assert got == {"a": (75.0, None), "b": (None, 77)}
    assert {r["session_id"]: r["skills"] for r in ranks.turn_summary(e.turns, e.calls, e.hooks, e.skills).collect()} == {"a": 1, "b": 0}
    named = e.turns.withColumn("model", F.lit("m"))
    assert [(r["sessions"], r["cache_read"], r["cache_write"]) for r in ranks.by_model(e.walls, named, usage).collect()] == [(2, 30, 10)]
    assert ranks.header(e.walls, by="tool", since="7d", failed=1).first().asDict() == {"sessions": 2, "total_wall_ms": 4000, "by": "tool", "since": "7d", "failed": 1}
    with pytest.raises(ValueError):
        ranks.header(e.walls.limit(0), failed=2)
    args = spark.createDataFrame([("a", "c", "y" * 100)], "session_id string, call_id string, arguments string")
    assert [r["preview"] for r in ranks.turn_detail(e.calls, args).collect()] == ["y" * 80]


def test_tool_descriptions(spark, tmp_path):
    one = tmp_path / "one.json"
    one.write_text(json.dumps({"gh": [{"name": "x", "description": "old"}, {"name": "x", "description": "new"}, {"description": "no name"}], "fs": []}))
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"tools": [{"name": "p", "description": "P"}]}))
    (folder / "b.json").write_text(json.dumps([{"name": "q"}]))
    (folder / "c.json").write_text("broken")
    got = lambda path: {tuple(r) for r in jsonl.tool_descriptions(spark, str(path)).collect()}
    assert got(one) == {("gh", "x", "new")} and got(folder) == {("a", "p", "P"), ("b", "q", None)}


def test_live_folders(spark, tmp_path):
    for name, file in (("a", "inuse.1.lock"), ("b", "inuse.txt"), ("c", "events.jsonl")):
        (tmp_path / name).mkdir()
        (tmp_path / name / file).write_text("")
    assert [r[0] for r in jsonl.live_folders(spark, str(tmp_path)).collect()] == ["a"]


def test_stored_rows_come_first(spark):
    mine = spark.createDataFrame([("a", 1)], "session_id string, n long")
    files = spark.createDataFrame([("a", 2), ("b", 3)], "session_id string, n long")
    assert {tuple(r) for r in store.fall_through(mine, files).collect()} == {("a", 1), ("b", 3)}


def test_lines_of_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.005, None), ("b", 20.0, 3)], "name string, rate double, n long").coalesce(1)
    assert [json.loads(r[0]) for r in store.report_lines(rows).collect()] == [{"name": "a", "rate": 1.005, "n": None}, {"name": "b", "rate": 20.0, "n": 3}]
    store.write_csv(rows, str(tmp_path / "csv"))
    [file] = (tmp_path / "csv").glob("*.csv")
    assert file.read_text().splitlines()[0] == "name,rate,n" and file.read_text().splitlines()[2] == "b,20.00,3"


def test_csv_headers_and_documents(spark, tmp_path):
    tools = spark.createDataFrame([("mcp__a__b", "mcp", "a", 2, 1, 1, 30, 2, 10, 20), ("bash", "builtin", "", 1, 1, 0, 5, 1, 5, 5)], "name string, source_kind string, source_name string, calls long, ok long, fail long, total_ms long, sessions long, p50 long, p95 long").coalesce(1)
    reports.write_csv(tools, "tool", str(tmp_path / "t"))
    [file] = (tmp_path / "t").glob("*.csv")
    assert file.read_text().splitlines() == ["name,source,call_count,success_count,failure_count,total_duration_ms,p50_ms,p95_ms,session_count", "mcp__a__b,mcp:a,2,1,1,30,10,20,2", "bash,builtin,1,1,0,5,5,5,1"]
    days = spark.createDataFrame([("2024-01-01", 1, 10, 4, 7, 40.0, False, 10, 30), ("2024-01-02", 1, 0, 0, 0, 0.0, True, None, None)], "day string, sessions long, wall_ms long, tool_ms long, output_tokens long, utilisation float, low boolean, cache_write long, cache_read long").coalesce(1)
    assert [tuple(r) for r in reports.csv_rows(days, "day").collect()] == [("2024-01-01", "1", "10", "4", "7", "40.00", "false", "10", "30", "75.00", "25"), ("2024-01-02", "1", "0", "0", "0", "0.00", "true", "0", "0", "", "")]
    models = spark.createDataFrame([("m", 1, 2, 3, 4)], "model string, sessions long, turns long, output_tokens long, wall_ms long")
    assert reports.csv_rows(models, "model").columns[-4:] == ["cache_creation", "cache_read", "hit_pct_honest", "saved_net"]
    with pytest.raises(ValueError):
        reports.csv_rows(models, "hour")
    header = spark.createDataFrame([(3, 9, "tool", "7d")], "sessions long, total_wall_ms long, by string, since string")
    [doc] = reports.rollup_json(tools, "tool", header).collect()
    doc = json.loads(doc["value"])
    assert doc["by"] == "tool" and {k: v for k, v in doc["data"].items() if k != "buckets"} == {"sessions": 3, "total_wall_ms": 9, "since": "7d"}
    assert [b["name"] for b in doc["data"]["buckets"]] == ["mcp__a__b", "bash"] and doc["data"]["buckets"][0]["source"] == "mcp:a"


def test_parts_of_stored_reports(spark):
    stored = spark.createDataFrame([('{"meta": {"id": "x"}, "n": 1, "s": "a\\"b", "l": [1, null], "z": null}',), ("[1, 2]",), ('"t"',), (None,)], "analysis_report_json string").coalesce(1)
    got = [json.loads(r[0]) for r in reports.report_parts(stored).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [{"meta": {"id": "x"}}, {"n": 1}, {"s": 'a"b'}, {"l": [1, None]}, {"z": None}, {"value": [1, 2]}, {"value": "t"}]))
