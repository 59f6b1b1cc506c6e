"""Flame events: open and close marks of turns and what they hold, without overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import display_name
from ..sources.folders import written

#: The number of the turn that gathers calls without a turn; it comes after all others.
ORPHANS = 1 << 40
#: Of the viewer's file format.
FORMAT = "https://www.speedscope.app/file-format-schema.json"


def _rows(bounds: DataFrame, turns: DataFrame, calls: DataFrame, hooks: DataFrame | None, skills: DataFrame | None) -> DataFrame:
    """One row a turn (part 0) or child: session_id, ordinal, part, seq, name, a, z, stop: times in ms from the session's start, not below 0."""

    def ms(c: str | Column) -> Column:
        at = F.col(c) if isinstance(c, str) else c
        return F.greatest(F.lit(0), F.floor((F.unix_micros(at) - F.unix_micros("zero")) / 1000))

    order = Window.partitionBy("session_id").orderBy("turn_seq")
    t = turns.withColumns({"ordinal": F.row_number().over(order).cast("long"), "next_start": F.lead("started_at").over(order)}).join(bounds, "session_id")
    label = F.concat(F.lit("turn-"), F.col("ordinal").cast("string"), F.when(F.col("ended_at").isNull(), " (open)").otherwise(""))
    closes = F.coalesce("ended_at", F.least("last", "next_start"))
    out = t.select("session_id", "ordinal", F.lit(0).alias("part"), F.col("turn_seq").alias("seq"), label.alias("name"), ms("started_at").alias("a"), ms(closes).alias("z"), ms(F.coalesce("ended_at", "last")).alias("stop"))
    places = t.select("session_id", "turn_seq", "ordinal")
    tools = calls.select("session_id", "turn_seq", F.lit(1).alias("part"), F.col("start_seq").alias("seq"), display_name(F.col("name")).alias("name"), "started_at", "ended_at")
    kids = tools
    if hooks is not None:
        kids = kids.unionByName(hooks.select("session_id", "turn_seq", F.lit(2).alias("part"), F.col("start_seq").alias("seq"), F.concat(F.lit("hook:"), "name").alias("name"), "started_at", "ended_at").where("turn_seq is not null"))
    if skills is not None:
        kids = kids.unionByName(skills.select("session_id", "turn_seq", F.lit(3).alias("part"), "seq", F.concat(F.lit("skill:"), "name").alias("name"), F.col("ts").alias("started_at"), F.col("ts").alias("ended_at")).where("turn_seq is not null"))
    placed = kids.join(places, ["session_id", "turn_seq"], "left").where("turn_seq is null or ordinal is not null").join(bounds, "session_id")
    return out.unionByName(placed.select("session_id", F.coalesce("ordinal", F.lit(ORPHANS)).alias("ordinal"), "part", "seq", "name", ms("started_at").alias("a"), ms("ended_at").alias("z"), F.lit(None).cast("long").alias("stop")))


SHIFTED = "struct<last: bigint, out: array<struct<place: bigint, name: string, open_ms: bigint, close_ms: bigint>>>"


def _shifted(kids: DataFrame) -> DataFrame:
    """session_id, ordinal, place, name, open_ms, close_ms of what turns hold (kids: session_id, ordinal, part, seq, name, a, z, first: where the neighbour of the first ends, stop or null), each moved behind its neighbour's end.

    Only neighbours that overlap depend on each other. No end lies beyond the largest of `first` and all starts and ends before it by more than two
    for each row between, so where a row begins later than that, a new run begins. Runs are mostly a row or two; each is folded in the JVM.
    """
    order = Window.partitionBy("session_id", "ordinal").orderBy("a", "part", "seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = kids.withColumn("place", F.row_number().over(order).cast("bigint"))
    reach = F.max(F.greatest(F.col("a") + 1, F.col("z")) - 2 * F.col("place")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("free", F.col("a") >= F.greatest(F.col("first"), reach) + 2 * (F.col("place") - 1))
    rows = rows.withColumn("run", F.sum(F.when(F.col("free"), 1).otherwise(0)).over(so_far))
    runs = rows.groupBy("session_id", "ordinal", "run").agg(F.array_sort(F.collect_list(F.struct("place", "name", "a", "z"))).alias("kids"), F.min("first").alias("first"), F.min("stop").alias("stop"), F.min("a").alias("a"))

    def step(acc: Column, x: Column) -> Column:
        moved = x["a"] < acc["last"]
        begin = F.when(moved, acc["last"] + 1).otherwise(x["a"])
        wanted = F.when(moved & (x["z"] <= begin), begin + 1).otherwise(x["z"])
        end = F.greatest(begin, F.when(F.col("stop").isNull(), wanted).otherwise(F.least(wanted, F.col("stop"))))
        made = F.struct(x["place"].alias("place"), x["name"].alias("name"), begin.alias("open_ms"), end.alias("close_ms"))
        return F.struct(end.alias("last"), F.concat(acc["out"], F.array(made)).alias("out")).cast(SHIFTED)

    start = F.struct(F.when(F.col("run") == 0, F.col("first")).otherwise(F.col("a")).alias("last"), F.array().alias("out")).cast(SHIFTED)
    return runs.select("session_id", "ordinal", F.inline(F.aggregate("kids", start, step)["out"]))


def adjusted(bounds: DataFrame, turns: DataFrame, calls: DataFrame, hooks: DataFrame | None = None, skills: DataFrame | None = None) -> DataFrame:
    """session_id, ordinal, depth (0 a turn, 1 what it holds), place (of a child in its turn, from 1), name, open_ms, close_ms, in whole ms from the session's start.

    A child that begins before its neighbour's end is moved to 1 ms after it (and lasts 1 ms at least); none ends after its turn, or
    before it begins. F10: turns are numbered by start; an open one ends where the next begins, or with the session. Calls
    without a turn are gathered in a last turn, which opens when all others are closed. bounds holds session_id, zero, last:
    the times of a session's start and end. Rows are written once, as several passes read them; all of it stays in the JVM, and a turn is dealt to one task, not a session.
    """
    rows = written(_rows(bounds, turns, calls, hooks, skills), "flame-rows")
    whole = lambda c: F.col(c).cast("bigint")
    heads = rows.where("part = 0").select("session_id", "ordinal", F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("place"), "name", whole("a").alias("open_ms"), whole("z").alias("close_ms"))
    # a turn's row stands first and hands its bounds to what it holds
    turn = Window.partitionBy("session_id", "ordinal")
    owned = rows.where(F.col("ordinal") != ORPHANS)
    owned = owned.withColumns({"first": F.max(F.when(F.col("part") == 0, F.col("a"))).over(turn), "bound": F.max(F.when(F.col("part") == 0, F.col("stop"))).over(turn)})
    inner = _shifted(owned.where("part > 0").select("session_id", "ordinal", "part", "seq", "name", whole("a").alias("a"), whole("z").alias("z"), whole("first").alias("first"), whole("bound").alias("stop")))
    inner = inner.select("session_id", "ordinal", F.lit(1).alias("depth"), "place", "name", "open_ms", "close_ms")
    closed = heads.unionByName(inner)
    tops = closed.groupBy("session_id").agg(F.max(F.greatest("open_ms", "close_ms")).alias("top"))
    lone = rows.where(F.col("ordinal") == ORPHANS).join(tops, "session_id", "left")
    lone = lone.withColumn("first", F.greatest(F.min("a").over(Window.partitionBy("session_id")), F.coalesce("top", F.lit(0))))
    orphans = _shifted(lone.select("session_id", "ordinal", "part", "seq", "name", whole("a").alias("a"), whole("z").alias("z"), whole("first").alias("first"), F.lit(None).cast("bigint").alias("stop"))).select("session_id", "ordinal", F.lit(1).alias("depth"), "place", "name", "open_ms", "close_ms")
    by_start = F.struct("a", "part", "seq")
    opened = lone.groupBy("session_id").agg(F.max("first").alias("open_ms"), F.max_by("z", by_start).alias("z"))
    ends = orphans.groupBy("session_id").agg(F.max_by("close_ms", "place").alias("last"))
    pseudo = opened.join(ends, "session_id").select("session_id", F.lit(ORPHANS).alias("ordinal"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("place"), F.lit("turn-orphan").alias("name"), whole("open_ms").alias("open_ms"), F.greatest("open_ms", "z", "last").cast("bigint").alias("close_ms"))
    return closed.unionByName(orphans).unionByName(pseudo)


def marks(spans: DataFrame) -> DataFrame:
    """Two rows a span, O and C, in the order a viewer reads."""
    both = F.explode(F.array(F.struct(F.lit("O").alias("type"), F.col("open_ms").alias("at")), F.struct(F.lit("C").alias("type"), F.col("close_ms").alias("at"))))
    return spans.select("session_id", "ordinal", "depth", "name", both.alias("m")).select("session_id", "ordinal", "depth", "name", "m.type", "m.at")


def session_ends(bounds: DataFrame, turns: DataFrame, calls: DataFrame, hooks: DataFrame, skills: DataFrame) -> DataFrame:
    """bounds with the exporter's end of a session as `last`: the latest end of a turn (of an open one its start), call, hook or skill; not before its first event."""
    at = lambda rows, c: rows.select("session_id", c.alias("at"))
    marks_ = at(turns, F.coalesce("ended_at", "started_at")).unionByName(at(calls, F.col("ended_at"))).unionByName(at(hooks, F.col("ended_at"))).unionByName(at(skills, F.col("ts")))
    return bounds.select("session_id", "zero").join(marks_.groupBy("session_id").agg(F.max("at").alias("at")), "session_id", "left").select("session_id", "zero", F.greatest("zero", "at").alias("last"))


def profiles(bounds: DataFrame, turns: DataFrame, calls: DataFrame, hooks: DataFrame, skills: DataFrame, agents: DataFrame | None = None, version: str = "1") -> DataFrame:
    """session_id, profile: each session as a viewer's evented profile (a struct that to_json gives the file of).

    shared.frames holds each name once: the session, its turns in order, turn-orphan if calls have no turn, then the names of tools, hooks and
    skills in order; events refer to frames by index. An outer frame spans the session, up to its end or to the last mark. bounds
    are session_ends; agents (session_id, agent) name the sessions' agents. A row holds one session's marks, as its file does.
    """
    bounds = written(bounds, "flame-bounds")
    spans = written(adjusted(bounds, turns, calls, hooks, skills), "flame-spans")
    leaf = lambda rows, name: rows.select("session_id", name.alias("name"))
    leaves = leaf(calls, display_name(F.col("name"))).unionByName(leaf(hooks, F.concat(F.lit("hook:"), "name"))).unionByName(leaf(skills, F.concat(F.lit("skill:"), "name"))).distinct()
    frames = bounds.select("session_id", F.lit(-1).alias("depth"), F.lit(0).cast("long").alias("ordinal"), F.lit("session").alias("name"))
    frames = frames.unionByName(spans.where("depth = 0").select("session_id", "depth", "ordinal", "name")).unionByName(leaves.select("session_id", F.lit(1).alias("depth"), F.lit(0).cast("long").alias("ordinal"), "name"))
    frames = written(frames.withColumn("frame", F.row_number().over(Window.partitionBy("session_id").orderBy("depth", "ordinal", "name")) - 1), "flame-frames")
    index = frames.select(F.col("session_id").alias("s"), F.col("depth").alias("d"), F.col("name").alias("n"), "frame")
    numbered = spans.join(index, (F.col("session_id") == F.col("s")) & (F.col("depth") == F.col("d")) & (F.col("name") == F.col("n")))
    after = F.when(F.col("depth") == 0, F.lit(ORPHANS)).otherwise(2 * F.col("place") + 1)
    mark = lambda kind, place, at: F.struct("ordinal", place.cast("long").alias("place"), F.lit(kind).alias("type"), at.alias("at"), "frame")
    events = numbered.select("session_id", F.explode(F.array(mark("O", 2 * F.col("place"), F.col("open_ms")), mark("C", after, F.col("close_ms")))).alias("m"))
    inner = events.groupBy("session_id").agg(F.array_sort(F.collect_list("m")).alias("marks"), F.max("m.at").alias("top"))
    names = frames.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "name"))), lambda x: F.struct(x["name"].alias("name"))).alias("frames"))
    ms = F.greatest(F.lit(0), F.floor((F.unix_micros("last") - F.unix_micros("zero")) / 1000))
    rows = bounds.join(names, "session_id").join(inner, "session_id", "left").withColumn("end", F.greatest(ms, F.coalesce("top", F.lit(0))).cast("long"))
    rows = rows.withColumn("agent", F.lit("copilot")) if agents is None else rows.join(agents.select("session_id", "agent"), "session_id", "left")
    event = lambda kind, at, frame: F.struct(kind.alias("type"), at.cast("long").alias("at"), frame.cast("int").alias("frame"))
    outer = lambda kind, at: F.array(event(F.lit(kind), at, F.lit(0)))
    all_ = F.concat(outer("O", F.lit(0)), F.transform(F.coalesce("marks", F.array()), lambda m: event(m["type"], m["at"], m["frame"])), outer("C", F.col("end")))
    profile = F.struct(F.lit("evented").alias("type"), F.lit("wall-clock").alias("name"), F.lit("milliseconds").alias("unit"), F.lit(0).cast("long").alias("startValue"), F.col("end").alias("endValue"), all_.alias("events"))
    title = F.concat(F.lit("spanloom "), F.left("session_id", F.lit(8)), F.lit(" "), F.coalesce("agent", F.lit("copilot")))
    return rows.select("session_id", F.struct(F.lit(FORMAT).alias("$schema"), title.alias("name"), F.lit(f"spanloom v{version}").alias("exporter"), F.struct("frames").alias("shared"), F.array(profile).alias("profiles")).alias("profile"))


def write_profiles(made: DataFrame, path: str) -> None:
    """One JSON file a session, in path/session_id=<id>/; a session that is written again replaces its file."""
    files = made.select("session_id", F.to_json("profile").alias("value")).repartition("session_id")
    files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").text(path)
