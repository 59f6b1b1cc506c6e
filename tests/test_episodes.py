"""Episodes against a plain stack machine, on random event streams."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.operators import episodes, flame, ranks
from spanloom.operators.bundle import Episodes
from spanloom.schema import EVENTS

KINDS = ["turn_start", "turn_end", "tool_start", "tool_complete", "hook_start", "hook_end", "abort", "assistant_message", "mode_changed"]


def streams(seed):
    rng, rows = random.Random(seed), []
    for s in range(40):
        for i in range(rng.randint(1, 40)):
            kind = rng.choice(KINDS)
            at = datetime(2024, 1, 1) + timedelta(seconds=10 * i + rng.randint(0, 15))
            rows.append((f"s{s}", i, f"e{i}", at, kind, rng.choice("abc"), "c", "m" if kind == "assistant_message" else None, i if kind == "assistant_message" else None, rng.choice(["plan", "odd"]), rng.random() < 0.7, "bad", None, None, None))
    return rows


def machine(rows):
    """(session, start seq, name, status, turn seq) of tool calls, and each abort's route, by pushing and popping."""
    calls, routes = set(), {}
    for s in sorted({r[0] for r in rows}):
        tools, hooks, turn = [], [], None
        for _, seq, _, _, kind, name, _, _, _, _, ok, *_ in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            if kind == "turn_start":
                turn = seq
            elif kind == "turn_end":
                turn = None
            elif kind == "tool_start":
                tools.append((seq, name, turn))
            elif kind == "hook_start":
                hooks.append(seq)
            elif kind == "tool_complete":
                if tools:
                    a, n, t = tools.pop()
                    calls.add((s, a, n, "success" if ok else "failure", t))
                else:
                    calls.add((s, seq, "<orphan>", "orphan", turn))
            elif kind == "hook_end" and hooks:
                hooks.pop()
            elif kind == "abort":
                if tools:
                    a, n, t = tools.pop()
                    calls.add((s, a, n, "failure", t))
                    routes[s, seq] = "tool"
                elif hooks:
                    hooks.pop()
                    routes[s, seq] = "hook"
                elif turn is not None:
                    turn, routes[s, seq] = None, "turn"
                else:
                    routes[s, seq] = "session"
        calls |= {(s, a, n, "open_at_end", t) for a, n, t in tools}
    return calls, routes


def test_pairing_equals_a_stack_machine(spark):
    rows = streams(1)
    routed = episodes.routed(spark.createDataFrame(rows, EVENTS))
    calls, routes = machine(rows)
    assert {tuple(r) for r in episodes.tool_calls(routed).select("session_id", "start_seq", "name", "status", "turn_seq").collect()} == calls
    assert {(r[0], r[1]): r[2] for r in routed.where("kind = 'abort'").select("session_id", "seq", "abort_route").collect()} == routes


def plain_flame(bounds, turns, kids):
    """The rule of the flame events, turn by turn: (session, ordinal, depth, name, open, close)."""
    out = set()
    for s, (zero, last) in bounds.items():
        ms = lambda t: max(0, (t - zero) // timedelta(milliseconds=1))  # noqa: E731, B023
        mine, top = sorted(turns.get(s, [])), 0

        def shift(rows, before, stop):
            spans = []
            for a, _, _, z, name in rows:
                moved = a < before
                begin = before + 1 if moved else a
                end = max(z, begin + 1) if moved else z
                before = max(begin, end if stop is None else min(end, stop))
                spans.append((name, begin, before))
            return spans

        for n, (seq, started, ended) in enumerate(mine):
            close = ms(ended) if ended else min([ms(last)] + [ms(x[1]) for x in mine[n + 1 : n + 2]])
            rows = sorted((ms(a), part, q, ms(z), name) for t, part, q, a, z, name in kids.get(s, []) if t == seq)
            spans = shift(rows, ms(started), ms(ended or last))
            out |= {(s, n + 1, 0, f"turn-{n + 1}" + (" (open)" if not ended else ""), ms(started), close)} | {(s, n + 1, 1, *x) for x in spans}
            top = max([top, ms(started), close] + [v for x in spans for v in x[1:]])
        rows = sorted((ms(a), part, q, ms(z), name) for t, part, q, a, z, name in kids.get(s, []) if t is None and part == 1)
        if rows:
            begin = max(rows[0][0], top)
            spans = shift(rows, begin, None)
            out |= {(s, flame.ORPHANS, 0, "turn-orphan", begin, max(begin, rows[-1][3], spans[-1][2]))} | {(s, flame.ORPHANS, 1, *x) for x in spans}
    return out


@pytest.mark.parametrize("seed", [2, 3])
def test_flame_events_equal_a_plain_loop(spark, seed):
    rows = streams(seed)
    rows += [(s, 100 + i, f"k{i}", datetime(2024, 1, 1, 0, 0, 7 * i), "skill_invoked", "sk", None, None, None, None, None, None, None, None, None) for s in ("s1", "s2", "s3") for i in range(3)]
    e = Episodes(spark.createDataFrame(rows, EVENTS))
    bounds = {r[0]: (r[1], r[2]) for r in e.bounds.collect()}
    turns, kids = {}, {}
    for r in e.turns.collect():
        turns.setdefault(r["session_id"], []).append((r["turn_seq"], r["started_at"], r["ended_at"]))
    for part, df, label in ((1, e.calls, "{}"), (2, e.hooks, "hook:{}"), (3, e.skills.withColumnsRenamed({"seq": "start_seq", "ts": "started_at"}).withColumn("ended_at", F.col("started_at")), "skill:{}")):
        for r in df.collect():
            kids.setdefault(r["session_id"], []).append((r["turn_seq"], part, r["start_seq"], r["started_at"], r["ended_at"], label.format(r["name"])))
    spans = flame.adjusted(e.bounds, e.turns, e.calls, e.hooks, e.skills).drop("place")
    got = {tuple(r) for r in spans.collect()}
    assert got == plain_flame(bounds, turns, kids)
    assert any(r[1] == flame.ORPHANS for r in got) and any("(open)" in r[3] for r in got)
    inner = {}
    for r in got:
        if r[2]:
            inner.setdefault(r[:2], []).append(r[4:])
    assert all(b[0] >= a[1] or b[0] >= a[0] for x in inner.values() for a, b in itertools.pairwise(sorted(x)))
    assert flame.marks(spans).count() == 2 * len(got)


@pytest.mark.parametrize("seed", range(5, 8))
def test_walls_reach_the_latest_end_of_any_episode(spark, seed):
    rng, rows = random.Random(seed), []
    for s in range(60):
        for i in range(rng.randint(1, 12)):
            kind = rng.choice([*KINDS, "model_change", "skill_invoked", "user_message"])
            rows.append((f"s{s}", i, f"e{i}", datetime(2024, 1, 1) + timedelta(seconds=rng.randint(0, 60)), kind, "x", "c", None, None, "plan", True, None, None, None, None))
    e = Episodes(spark.createDataFrame(rows, EVENTS))
    ends = {}
    for df in (e.turns, e.calls, e.hooks, e.modes, e.skills.withColumn("ended_at", F.col("ts"))):
        for r in df.where("ended_at is not null").select("session_id", "ended_at").collect():
            ends[r[0]] = max(ends.get(r[0], r[1]), r[1])
    first = {r[0]: r[3] for r in sorted(rows, key=lambda r: -r[1])}
    expected = {s: max(0, (ends.get(s, t) - t) // timedelta(milliseconds=1)) for s, t in first.items()}
    assert {r["session_id"]: r["wall_ms"] for r in e.walls.collect()} == expected


def test_bundle_names_its_tables(spark):
    tables = Episodes(spark.createDataFrame(streams(4), EVENTS)).bundle()
    assert {"turn_summary", "tool_rank", "usage", "sessions"} <= set(tables) and tables["turn_summary"].count() > 0


def test_empty_events(spark):
    routed = episodes.routed(spark.createDataFrame([], EVENTS))
    assert episodes.tool_calls(routed).count() == 0 and episodes.turns(routed).count() == 0


def test_usage_saturates_and_is_null_without_metrics(spark):
    most = (1 << 63) - 1
    usage = spark.createDataFrame([("a", "m", most - 1, 1, None, 0), ("a", "n", 5, 1, None, 0)], "session_id string, model string, input_tokens long, output_tokens long, cache_read long, cache_write long")
    sessions = spark.createDataFrame([("a",), ("b",)], "session_id string")
    got = {r["session_id"]: tuple(r)[1:] for r in ranks.session_totals(sessions, usage).collect()}
    assert got == {"a": (most, 2, None, 0), "b": (None,) * 4}
    m = {"x": {"input": 1}, "y": {"input": 2, "output": 3}}
    events = spark.createDataFrame([("a", 1, m), ("a", 2, {}), ("a", 0, {"z": {"input": 9}}), ("b", 1, {}), ("c", 1, None)], "session_id string, seq long, model_metrics map<string, struct<input: long, output: long, cache_read: long, cache_write: long>>")
    assert {tuple(r) for r in ranks.last_usage(events).collect()} == {("a", "x", 1, 0, 0, 0), ("a", "y", 2, 3, 0, 0)}
