"""Roll-ups kept up to date over growing logs against a full recompute."""

import json
import random
from pathlib import Path

from spanloom.operators import ranks
from spanloom.operators.bundle import Episodes
from spanloom.sources import jsonl
from spanloom.streaming import rollups


def line(kind, i, second, **data):
    return json.dumps({"type": kind, "id": f"e{i}", "timestamp": f"2024-01-{1 + second // 86400:02d}T{second % 86400 // 3600:02d}:{second % 3600 // 60:02d}:{second % 60:02d}Z", "data": data})


def random_lines(rng, i, second):
    kind = rng.choice(["assistant.turn_start", "assistant.turn_end", "tool.execution_start", "tool.execution_start", "tool.execution_complete", "tool.execution_complete", "assistant.message", "abort"])
    data = {
        "assistant.turn_start": {"turnId": "t"}, "assistant.turn_end": {"turnId": "t"}, "tool.execution_start": {"toolCallId": "c", "toolName": rng.choice(["bash", "mcp__a__b"]), "arguments": {}}, "tool.execution_complete": {"toolCallId": "c", "success": rng.random() < 0.7},
        "assistant.message": {"messageId": "m", "model": rng.choice(["m1", "m2"]), "content": "", "interactionId": "i", "outputTokens": rng.randrange(50)}, "abort": {"reason": "x"},
    }[kind]
    return line(kind, i, second, **data)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def test_five_random_appends_equal_a_full_recompute(spark, tmp_path):
    rng = random.Random(5)
    root, seconds, parts = tmp_path / "logs", {}, {}
    live = rollups.LiveRollups(spark, str(tmp_path / "state"))
    for step in range(5):
        for name in rng.sample([f"s{i}" for i in range(5)], 3):
            folder = root / name
            folder.mkdir(parents=True, exist_ok=True)
            lines = []
            if name not in seconds:
                seconds[name] = rng.randrange(200_000)
                lines.append(line("assistant.turn_start", 0, seconds[name], turnId="t"))
            for _ in range(rng.randrange(1, 12)):
                seconds[name] += rng.randrange(400)
                lines.append(random_lines(rng, seconds[name], seconds[name]))
            parts[name] = parts.get(name, 0) + 1
            (folder / f"events-{parts[name]:04d}.jsonl").write_text("\n".join(lines) + "\n")
        query = live.watch(str(root), str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        if step in (1, 4):
            e = Episodes(jsonl.decode(jsonl.folder_lines(spark, [str(p) for p in root.iterdir()]))[0])
            sums = live.totals()
            assert rows(rollups.by_tool(sums)) == rows(ranks.by_tool(e.calls)), step
        if step == 4:
            assert rows(rollups.by_day(sums)) == rows(ranks.by_day(e.walls, e.calls, e.turns))
            assert rows(rollups.by_model(sums)) == rows(ranks.by_model(e.walls, e.turns).select("model", "sessions", "turns", "output_tokens", "wall_ms"))
    # a batch that runs again, and compacting, change nothing
    before = rows(live.totals())
    last = live._batches("shares", None)[-1]
    again = [r["session_id"] for r in live._read("shares", [last], rollups.SHARES).select("session_id").distinct().collect()]
    live.refresh(jsonl.decode(jsonl.folder_lines(spark, [str(root / n) for n in again]))[0], last)
    assert rows(live.totals()) == before
    live.compact(last + 1)
    assert rows(live.totals()) == before and live._batches("shares", None) == [last + 1]
    live.refresh(e.events.limit(0), last + 2)
    assert rows(live.totals()) == before


def test_a_batch_pairs_its_events_once(spark, tmp_path):
    """All shares of a batch come of events that are dealt by session and paired once; what is dealt after that is a part of them. The paired events are removed."""
    rng = random.Random(7)
    (tmp_path / "logs" / "s").mkdir(parents=True)
    (tmp_path / "logs" / "s" / "events-0001.jsonl").write_text("\n".join(random_lines(rng, i, i) for i in range(2000)) + "\n")
    events = jsonl.decode(jsonl.folder_lines(spark, [str(tmp_path / "logs" / "s")]))[0]
    events.write.parquet(str(tmp_path / "events"))
    store, doubles = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._gateway.jvm.double, 0)

    def shuffled() -> int:
        stages = store.stageList(None, False, False, doubles, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before, events = shuffled(), spark.read.schema(events.schema).parquet(str(tmp_path / "events"))
    rollups.LiveRollups(spark, str(tmp_path / "state")).refresh(events, 0)
    assert shuffled() - before < 3 * 2000
    with Episodes(events).held() as h:
        assert rows(h.calls) == rows(Episodes(events).calls)
        paths = h.rows.inputFiles()
    assert paths and not any(Path(p.removeprefix("file://")).exists() for p in paths)
