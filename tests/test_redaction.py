"""Both levels of redaction, and the way back."""

from datetime import datetime

from spanloom.functions.scalars import short_hash
from spanloom.operators import redact
from pyspark.sql import functions as F

AT, EPOCH = datetime(2024, 5, 1, 12), datetime(1970, 1, 1)


def tables(spark):
    sessions = spark.createDataFrame([("S", "1.2", "prod", AT, "/home/x", "repo", None, "gpt-5-mini", 7)], "session_id string, agent_version string, producer string, started_at timestamp, cwd string, repository string, branch string, model string, output_tokens long")
    calls = spark.createDataFrame([("S", "T", "mcp__jira__find", AT, AT, 5), ("S", None, "bash", AT, AT, 6)], "session_id string, turn_id string, name string, started_at timestamp, ended_at timestamp, duration_ms long")
    ids = spark.createDataFrame([("S", 0), ("T", 1), ("S", 5)], "id string, place long")
    return sessions, calls, redact.pseudonyms(ids)


def test_pseudonyms_are_numbered_by_first_place(spark):
    _, _, names = tables(spark)
    assert {tuple(r) for r in names.collect()} == {("S", "<uuid-0>"), ("T", "<uuid-1>")}


def test_places_go_at_both_levels_and_builds_and_times_when_anonymizing(spark):
    sessions, calls, names = tables(spark)
    r = redact.redact(sessions, names).first()
    assert (r["session_id"], r["cwd"], r["repository"], r["branch"], r["model"], r["agent_version"], r["started_at"], r["output_tokens"]) == ("<uuid-0>", "<redacted>", "<redacted>", None, "gpt-5", "1.2", AT, 7)
    r = redact.redact(sessions, names, anonymize=True).first()
    assert (r["agent_version"], r["producer"], r["started_at"], r["output_tokens"]) == ("<redacted>", "<redacted>", EPOCH, 7)


def test_calls_keep_durations_and_join_by_pseudonyms(spark):
    _, calls, names = tables(spark)
    plain = {r["name"]: r for r in redact.redact(calls, names).collect()}
    assert plain["mcp__jira__find"]["turn_id"] == "<uuid-1>" and plain["bash"]["turn_id"] is None and plain["bash"]["started_at"] == AT
    hashed = spark.range(1).select(short_hash(F.lit("jira"))).first()[0]
    anonymous = {r["name"]: r for r in redact.redact(calls, names, anonymize=True).collect()}
    r = anonymous[f"mcp__{hashed}__find"]
    assert (r["started_at"], r["ended_at"], r["duration_ms"], r["session_id"]) == (EPOCH, EPOCH, 5, "<uuid-0>")


def test_diagnostics_are_emptied_and_rollups_merged(spark):
    rows = spark.createDataFrame([("S", ["x"])], "session_id string, warnings array<string>")
    assert redact.redact(rows, tables(spark)[2]).first()["warnings"] is None
    models = spark.createDataFrame([("gpt-5-a", 1), ("gpt-5-b", 2), ("o1", 4)], "model string, n long")
    assert {tuple(r) for r in redact.redact_rollup(models).collect()} == {("gpt-5", 3), ("o1", 4)}
    servers = spark.createDataFrame([("jira", 1)], "server string, n long")
    assert redact.redact_rollup(servers).first()["server"] == "jira" and redact.redact_rollup(servers, anonymize=True).first()["server"] != "jira"


def test_the_way_back(spark, tmp_path):
    _, calls, names = tables(spark)
    models = spark.createDataFrame([("gpt-5-b", 2), ("gpt-5-a", 1)], "model string, place long")
    mapping = redact.reverse_map(names, models, calls)
    found = {(r["kind"], r["original"]): r["pseudonym"] for r in mapping.collect()}
    assert found["uuid", "T"] == "<uuid-1>" and found["model", "gpt-5-a"] == "gpt-5" and len(found["server", "jira"]) == 8
    assert redact.write_reverse_map(mapping, str(tmp_path / "m"), anonymize=True) and spark.read.json(str(tmp_path / "m")).count() == mapping.count()
    assert not redact.write_reverse_map(mapping, str(tmp_path / "n"), anonymize=False) and not redact.write_reverse_map(mapping.limit(0), str(tmp_path / "n"), anonymize=True)
