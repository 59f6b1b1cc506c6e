"""Nested telemetry exports to typed events: names, typed values, fall-backs and errors."""

import json
from datetime import datetime

import pytest

from spanloom.streaming import exports

NS = 1_700_000_000_000_000_000
TS = datetime(2023, 11, 14, 22, 13, 20)


def attr(key, value):
    kind = {str: "stringValue", bool: "boolValue", int: "intValue", float: "doubleValue"}[type(value)]
    return {"key": key, "value": {kind: str(value) if kind == "intValue" else value}}


def attrs(values):
    return [attr(k, v) for k, v in values.items()]


def logs(resource, *records):
    return {"resourceLogs": [{"resource": {"attributes": attrs(resource)}, "scopeLogs": [{"logRecords": list(records)}]}]}


def record(name, time=NS, **values):
    return {"timeUnixNano": str(time), "attributes": [attr("event.name", name), *attrs({k.replace("__", "."): v for k, v in values.items()})]}


def metrics(resource, *made):
    return {"resourceMetrics": [{"resource": {"attributes": attrs(resource)}, "scopeMetrics": [{"metrics": list(made)}]}]}


def point(value, **values):
    return {"attributes": attrs({k.replace("__", "."): v for k, v in values.items()}), "timeUnixNano": str(NS), **value}


def spans(resource, *made):
    return {"resourceSpans": [{"resource": {"attributes": attrs(resource)}, "scopeSpans": [{"spans": list(made)}]}]}


def span(name, values, end=NS + 10**9, **more):
    return {"name": name, "startTimeUnixNano": str(NS), "endTimeUnixNano": str(end), "attributes": attrs(values), **more}


def typed(spark, *requests):
    lines = [r if isinstance(r, str) else json.dumps(r) for r in requests]
    return exports.typed_events(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()


S = {"session.id": "s"}


def test_all_log_names(spark):
    names = ["claude_code.session.start", "session.end", "user.prompt", "claude_code.user_prompt", "tool.decision_start", "tool_decision", "claude_code.tool.decision", "tool.result", "tool_result", "tool_start"]
    got = typed(spark, logs(S, *[record(n) for n in names]))
    assert [r["event_type"] for r in got] == ["session_start", "session_end", "prompt", "prompt", "tool_start", "tool_start", "tool_start", "tool_result", "tool_result", "unrecognised"]
    assert {r["ts"] for r in got} == {TS} and got[-1]["session_id"] is None and got[-1]["identity"] == "log.event_name=tool_start"
    assert {r["signal"] for r in got} == {"log"}


def test_typed_values_of_logs(spark):
    got = typed(spark, logs(S, record("tool_result", success=False, error__message="bad", tool__name="x", turn__id="t"), record("tool_result", success="false"), record("tool_result"), record("tool_decision", user__approved=True), record("tool_decision", user__approved="true"),
                            record("user_prompt", turn_id="9", prompt__size_bytes=7), record("user_prompt", prompt_size_bytes=2.5), record("user_prompt", prompt__size_bytes=-1), record("user_prompt", prompt__size_bytes="7"), record("session.start", model="m", cwd="/w")))
    assert [(r["status"], r["error_message"], r["tool_name"], r["turn_id"]) for r in got[:3]] == [("failure", "bad", "x", "t"), ("success", None, "", None), ("success", None, "", None)]
    assert [r["user_approved"] for r in got[3:5]] == [True, False]
    assert [(r["turn_id"], r["prompt_size_bytes"]) for r in got[5:9]] == [("9", 7), ("", 3), ("", None), ("", None)]
    assert (got[9]["model"], got[9]["cwd"]) == ("m", "/w")


def test_sessions_of_records(spark):
    far = "x" * 256
    got = typed(spark, logs({}, record("session.end")), logs({"claude.session_id": "c"}, record("session.end", session__id="r")), logs({"session.id": ""}, record("session.end", session__id="r")), logs({"session.id": far}, record("session.end")), logs({"session.id": far + "x", "claude.session_id": "c"}, record("session.end")))
    assert [(r["event_type"], r["session_id"], r["identity"]) for r in got] == [("error", None, "missing session.id"), ("session_end", "c", None), ("session_end", "r", None), ("session_end", far, None), ("error", None, "session.id is too long")]


@pytest.mark.parametrize("resource, agent", [({"service.name": "claude-code"}, "claude"), ({"service.name": "other", "agent.kind": "claude"}, "claude"), ({"service.name": "codex-cli"}, "codex"), ({"service.name": "codex-cli", "agent.kind": "claude"}, "claude"), ({"service.name": "my-claude"}, "copilot"), ({}, "copilot")])
def test_agents(spark, resource, agent):
    assert typed(spark, logs(S | resource, record("session.start")))[0]["agent"] == agent


def test_times(spark):
    late = record("session.end") | {"observedTimeUnixNano": str(NS + 10**9)}
    got = typed(spark, logs(S, late, record("session.end", time=2**64 - 1), record("odd", time=2**64 - 1)))
    assert (got[0]["ts"] - TS).total_seconds() == 1 and [r["identity"] for r in got[1:]] == ["time is out of range"] * 2


def test_metrics(spark):
    ways = ["input", "prompt", "output", "completion", "cache_read", "cache.read", "cache_create", "cache_creation", "cache.create"]
    some = [point({"asInt": "3"}, gen_ai__token__type=w, model="m") for w in ways]
    bad = [point({"asInt": 3}, gen_ai__token__type="sideways"), point({"asInt": 3}), point({"asInt": "-1"}, direction="input"), point({"asDouble": -0.5}, direction="input"), point({"asDouble": "NaN"}, direction="input"), point({}, direction="input")]
    got = typed(spark, metrics(S, {"name": "gen_ai.client.token.usage", "sum": {"dataPoints": some + bad}}))
    assert [r["direction"] for r in got[:9]] == ["input"] * 2 + ["output"] * 2 + ["cache_read"] * 2 + ["cache_creation"] * 3 and {(r["value"], r["model"]) for r in got[:9]} == {(3, "m")}
    assert [r["event_type"] for r in got[9:]] == ["error"] * 6
    assert [r["identity"] for r in got[9:12]] == ["unknown token direction: sideways", "missing gen_ai.token.type", "invalid token count: -1"] and got[-1]["identity"] == "data point without a value"


def test_metric_kinds_and_models(spark):
    p = point({"asDouble": 2.5}, direction="output")
    named = point({"asInt": 1}, direction="output", gen_ai__response__model="g", model="m")
    got = typed(spark, metrics(S | {"gen_ai.response.model": "r"}, {"name": "claude_code.token.usage", "gauge": {"dataPoints": [p, named]}}, {"name": "agent.token.usage", "histogram": {}}, {"name": "x.token.usage", "sum": {"dataPoints": [p]}}))
    assert [(r["event_type"], r["value"], r["model"], r["identity"]) for r in got] == [("token_usage", 3, "r", None), ("token_usage", 1, "g", None), ("unrecognised", None, None, "metric.name=agent.token.usage;unsupported_data_kind"), ("unrecognised", None, None, "metric.name=x.token.usage")]


def test_spans(spark):
    got = typed(spark, spans(S, span("any", {"gen_ai.operation.name": "tool.execute", "gen_ai.tool.name": "x", "user.approved": True}, status={"code": 2, "message": "bad"}), span("tool.execute", {"session.event": "start", "model": "m"}), span("a", {"session.event": "session.end"}, end=NS - 5), span("llm.toolbox", {}), span("tool.execute", {"tool.name": "y"}, status={"code": "STATUS_CODE_ERROR", "message": ""})), spans({}, span("tool.execute", {})))
    assert [(r["event_type"], r["tool_name"], r["status"], r["error_message"]) for r in got] == [("tool_start", "x", None, None), ("tool_result", "x", "failure", "bad"), ("session_start", None, None, None), ("session_end", None, None, None), ("unrecognised", None, None, None), ("tool_start", "y", None, None), ("tool_result", "y", "failure", None), ("error", None, None, None), ("error", None, None, None)]
    assert got[0]["user_approved"] is True and got[3]["ts"] == TS and got[4]["identity"] == "span.name=llm.toolbox" and (got[1]["ts"] - got[0]["ts"]).total_seconds() == 1


def test_requests_that_are_empty_or_broken(spark):
    got = typed(spark, {}, "no json", " ", "[1]", {"resourceLogs": None}, {"resourceLogs": [{"scopeLogs": [{"logRecords": [record("session.end", session__id="r")]}, {}]}]}, {"resourceMetrics": [{}]})
    assert [(r["event_type"], r["signal"]) for r in got] == [("unrecognised", "unknown"), ("unrecognised", "unknown"), ("session_end", "log")]


def test_one_signal_of_exports(spark):
    """One signal's events are those that all signals give of it; texts that are no exports are told in any case."""
    both = json.dumps(logs(S, record("user_prompt")) | spans(S, span("a", {})))
    rows = spark.createDataFrame([(both,), ("{broken",)], "value string")
    whole = exports.typed_events(rows).collect()
    assert sorted(r["signal"] for r in whole) == ["log", "trace", "unknown"]
    for signal in ("log", "trace", "metric"):
        got = exports.typed_events(rows, signals=(signal,))
        assert sorted(map(str, got.collect())) == sorted(str(r) for r in whole if r["signal"] in (signal, "unknown"))
        schema = got._jdf.queryExecution().optimizedPlan().toString()
        assert ("resourceLogs" in schema) == (signal == "log") and ("resourceSpans" in schema) == (signal == "trace")
