"""Viewer files: frames, marks, and one file a session."""

import json
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from spanloom.operators import flame

T0 = datetime(2024, 1, 1)


def at(s):
    return None if s is None else T0 + timedelta(seconds=s)


def tables(spark):
    bounds = spark.createDataFrame([(s, T0, at(9)) for s in ("a-long-session", "b", "quiet")], "session_id string, zero timestamp, last timestamp")
    turns = spark.createDataFrame([("a-long-session", 1, at(1), at(5)), ("a-long-session", 7, at(6), None)], "session_id string, turn_seq long, started_at timestamp, ended_at timestamp")
    calls = spark.createDataFrame([("a-long-session", 1, 2, "mcp__gh__list", at(1), at(3)), ("a-long-session", 1, 3, "bash", at(2), at(4)), ("a-long-session", 7, 8, "bash", at(7), at(8)), ("b", None, 2, "bash", at(1), at(2))], "session_id string, turn_seq long, start_seq long, name string, started_at timestamp, ended_at timestamp")
    hooks = spark.createDataFrame([("a-long-session", 1, 4, "pre", at(4), at(5))], "session_id string, turn_seq long, start_seq long, name string, started_at timestamp, ended_at timestamp")
    skills = spark.createDataFrame([("a-long-session", None, 9, "s", at(8))], "session_id string, turn_seq long, seq long, name string, ts timestamp")
    return bounds, turns, calls, hooks, skills


def test_profiles(spark):
    bounds, *rest = tables(spark)
    ends = flame.session_ends(bounds, *rest)
    assert {r["session_id"]: r["last"] for r in ends.collect()} == {"a-long-session": at(8), "b": at(2), "quiet": T0}
    agents = spark.createDataFrame([("b", "claude")], "session_id string, agent string")
    made = {r["session_id"]: json.loads(r["j"]) for r in flame.profiles(ends, *rest, agents=agents).select("session_id", F.to_json("profile").alias("j")).collect()}
    one = made["a-long-session"]
    assert one["name"] == "spanloom a-long-s copilot" and one["$schema"].endswith("file-format-schema.json") and made["b"]["name"] == "spanloom b claude"
    frames = [f["name"] for f in one["shared"]["frames"]]
    assert frames == ["session", "turn-1", "turn-2 (open)", "bash", "hook:pre", "mcp:gh::list", "skill:s"]
    [p] = one["profiles"]
    assert (p["type"], p["unit"], p["startValue"], p["endValue"]) == ("evented", "milliseconds", 0, 8000)
    assert [(e["type"], e["at"], frames[e["frame"]]) for e in p["events"]] == [
        ("O", 0, "session"), ("O", 1000, "turn-1"), ("O", 1000, "mcp:gh::list"), ("C", 3000, "mcp:gh::list"), ("O", 3001, "bash"), ("C", 4000, "bash"), ("O", 4000, "hook:pre"), ("C", 5000, "hook:pre"), ("C", 5000, "turn-1"),
        ("O", 6000, "turn-2 (open)"), ("O", 7000, "bash"), ("C", 8000, "bash"), ("C", 8000, "turn-2 (open)"), ("C", 8000, "session"),
    ]
    assert [f["name"] for f in made["b"]["shared"]["frames"]] == ["session", "turn-orphan", "bash"]
    assert [e["type"] for e in made["quiet"]["profiles"][0]["events"]] == ["O", "C"] and made["quiet"]["profiles"][0]["endValue"] == 0
    for file in made.values():  # marks nest, and never go back
        stack, last = [], 0
        for e in file["profiles"][0]["events"]:
            assert e["at"] >= last
            last = e["at"]
            if e["type"] == "O":
                stack.append(e["frame"])
            else:
                assert stack.pop() == e["frame"]
        assert not stack


def test_one_file_a_session(spark, tmp_path):
    bounds, *rest = tables(spark)
    made = flame.profiles(flame.session_ends(bounds, *rest), *rest)
    flame.write_profiles(made, str(tmp_path / "out"))
    flame.write_profiles(made.where("session_id = 'b'"), str(tmp_path / "out"))
    files = list(Path(tmp_path / "out").glob("session_id=*/part-*"))
    assert len(files) == 3
    for f in files:
        [line] = f.read_text().splitlines()
        assert json.loads(line)["shared"]["frames"][0] == {"name": "session"}


def test_calls_that_queue_behind_the_turns_push_on_later_ones(spark):
    ms = lambda n: T0 + timedelta(milliseconds=n)
    bounds = spark.createDataFrame([("a", T0, ms(30))], "session_id string, zero timestamp, last timestamp")
    turns = spark.createDataFrame([("a", 1, T0, ms(10))], "session_id string, turn_seq long, started_at timestamp, ended_at timestamp")
    # five calls wait for the turn's end, each with 1 ms of its own; the sixth begins after that end, but while they still queue
    begins = [1, 2, 3, 4, 5, 13]
    calls = spark.createDataFrame([("a", None, n, f"t{n}", ms(b), ms(b)) for n, b in enumerate(begins)], "session_id string, turn_seq long, start_seq long, name string, started_at timestamp, ended_at timestamp")
    spans = flame.adjusted(bounds, turns, calls).where("depth = 1").orderBy("place").collect()
    assert [(r["name"], r["open_ms"], r["close_ms"]) for r in spans] == [("t0", 11, 12), ("t1", 13, 14), ("t2", 15, 16), ("t3", 17, 18), ("t4", 19, 20), ("t5", 21, 22)]
