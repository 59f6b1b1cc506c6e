"""Session logs as a data source: discovery, live flags, pushed conditions, lines."""

import json
import os

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from spanloom.sources import jsonl, logsource
from spanloom.sources.logsource import LogFolder, LogReader


def line(kind, i, **data):
    return json.dumps({"type": kind, "id": f"e{i}", "timestamp": f"2024-01-01T00:00:{i:02d}Z", "data": data})


START = {"version": 1, "producer": "p", "copilotVersion": "1.0", "startTime": "2024-01-01T00:00:00.250Z", "context": {"cwd": "/w"}, "alreadyInUse": False}


@pytest.fixture
def root(tmp_path):
    top = tmp_path / "logs"
    for n, (folder, lines) in enumerate(
        {
            "f1": [line("session.start", 0, sessionId="S1", **START), line("assistant.turn_start", 1, turnId="t"), line("tool.execution_start", 2, toolCallId="c", toolName="bash", arguments={}), line("tool.execution_complete", 3, toolCallId="c", success=True)],
            "f2": ["no json", line("abort", 1, reason="x")], "f3": [], "f4": [json.dumps({"sessionId": "S4", "timestamp": "2024-01-01T00:00:01+01:00"}), '{"type": "abo'],
        }.items()
    ):
        (top / folder).mkdir(parents=True)
        (top / folder / "events.jsonl").write_text("\n".join(lines))
        os.utime(top / folder / "events.jsonl", (1000 + n, 1000 + n))
    (top / "f4" / "inuse.7.lock").write_text("")
    (top / "empty").mkdir()
    (top / "f1" / "sub").mkdir()
    (top / "f1" / "sub" / "events.jsonl").write_text("x")
    (top / "events.jsonl").write_text("x")
    return str(top)


def test_discovery_newest_first(spark, root):
    got = LogFolder(spark, root).refs().collect()
    assert [(r["session_id"], r["folder"], r["modified_ms"], r["is_live"], r["started_ms"]) for r in got] == [("S4", "f4", 1_003_000, True, 1_704_063_601_000), ("f3", "f3", 1_002_000, False, None), ("f2", "f2", 1_001_000, False, None), ("S1", "f1", 1_000_000, False, 1_704_067_200_250)]
    assert [r["session_id"] for r in LogFolder(spark, root).refs(since_ms=1_002_000).collect()] == ["S4", "f3"]
    with pytest.raises(Exception, match="no folder of sessions"):
        LogFolder(spark, root + "/none").refs().collect()


def test_conditions_prune_files(root):
    def folders(*filters, **options):
        reader = LogReader({"path": root, **options})
        left = list(reader.pushFilters(list(filters)))
        return [[x.folder for x in g.logs] for g in reader.partitions()], left

    assert folders() == ([["f4", "f3", "f2", "f1"]], [])
    assert folders(GreaterThanOrEqual(("modified_ms",), 1_002_000)) == ([["f4", "f3"]], [])
    assert folders(LessThan(("modified_ms",), 1_002_000), In(("folder",), ("f1", "f4"))) == ([["f1"]], [])
    odd = EqualTo(("line",), "x")
    assert folders(odd, EqualTo(("folder",), "f2")) == ([["f2"]], [odd])
    assert folders(group_bytes="1")[0] == [["f4"], ["f3"], ["f2"], ["f1"]]
    # one wrong id is seen on the first line, and nothing else of the file is read
    reader = LogReader({"path": root})
    assert list(reader.pushFilters([EqualTo(("session_id",), "S1")])) == []
    [group] = reader.partitions()
    assert {r[0] for r in reader.read(group)} == {"S1"}


def test_conditions_reach_the_source(spark, root):
    logsource.register(spark)
    rows = spark.read.format("session_logs").load(root).where("session_id = 'S1' and line_no > 0")
    assert [r["line_no"] for r in rows.orderBy("line_no").collect()] == [1, 2, 3]
    assert spark.read.format("session_logs").option("group_bytes", "1").load(root).rdd.getNumPartitions() == 4


def test_lines_and_episodes(spark, root):
    source = LogFolder(spark, root)
    _, warnings = jsonl.decode(source.lines())
    assert {(r["file_path"].split("/")[-2], r["line_no"]) for r in warnings.collect()} == {("f2", 0), ("f4", 0), ("f4", 1)}
    calls = source.episodes().calls.collect()
    assert [(r["session_id"], r["name"], r["status"]) for r in calls] == [("S1", "bash", "success")]
    assert source.episodes(["f2"]).calls.count() == 0 and source.lines([]).count() == 0 and logsource.sources(source)["files"] is source
