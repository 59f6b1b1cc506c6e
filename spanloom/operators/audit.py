"""Audits of event logs and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import home_leaks, shorten

#: Kinds that must balance.
PAIRS = (("turn", "turn_start", "turn_end"), ("tool", "tool_start", "tool_complete"), ("hook", "hook_start", "hook_end"))


def balance(events: DataFrame) -> DataFrame:
    """Per pair the starts, ends, delta and class: ok under 5 % of the larger, minor under 20 %, else severe."""
    counts = events.groupBy("kind").agg(F.count("*").alias("n"))
    named = F.create_map(*[x for p, a, b in PAIRS for k in (a, b) for x in (F.lit(k), F.lit(p))])
    sides = counts.withColumn("pair", F.element_at(named, F.col("kind"))).where("pair is not null")
    is_start = F.col("kind").isin(*[a for _, a, _ in PAIRS])
    out = sides.groupBy("pair").agg(F.coalesce(F.sum(F.when(is_start, F.col("n"))), F.lit(0)).alias("starts"), F.coalesce(F.sum(F.when(~is_start, F.col("n"))), F.lit(0)).alias("ends"))
    out = out.withColumn("delta", F.col("starts") - F.col("ends"))
    share = F.abs("delta") / F.greatest("starts", "ends")
    return out.withColumn("class", F.when(share < 0.05, "ok").when(share < 0.2, "minor").otherwise("severe"))


def first_k(rows: DataFrame, by: list[str], order: list, k: int, salts: int = 64) -> DataFrame:
    """The first k rows of each group. In two levels: of a salted part of the group, then of the parts' firsts. Spark cuts each task's rows to k a group before it deals them (WindowGroupLimit), so no task sees more than a few rows of a group, however large."""
    salted = Window.partitionBy(*by, F.pmod(F.xxhash64(*order), F.lit(salts))).orderBy(*order)
    some = rows.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k)


def kind_counts(events: DataFrame, known: tuple[str, ...], samples: int = 2) -> DataFrame:
    """Per kind the number of events and, for unknown ones, up to `samples` first event ids."""
    counts = events.groupBy("kind").agg(F.count("*").alias("n"))
    odd = events.where(~F.col("kind").isin(*known)).select("kind", "event_id", "ts", "session_id", "seq")
    ranked = first_k(odd, ["kind"], ["ts", "session_id", "seq"], samples)
    return counts.join(ranked.groupBy("kind").agg(F.array_sort(F.collect_list("event_id")).alias("samples")), "kind", "left")


def unknown_types(raw: DataFrame, events: DataFrame, samples: int = 2) -> DataFrame:
    """Per wire type of lines that became unknown events: n, up to `samples` of the lines with long strings cut, and the session of the first. raw and events as aligned takes them."""
    odd = aligned(raw, events).where("kind = 'unknown'").withColumn("type", F.coalesce(F.get_json_object("line", "$.type"), F.lit("(no type field)")))
    firsts = first_k(odd.select("type", "session_id", "line_no", "line"), ["type"], ["session_id", "line_no", "line"], samples)
    shown = firsts.groupBy("type").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", shorten(F.col("line")).alias("x")))), lambda s: s["x"]).alias("samples"), F.min_by("session_id", "_r").alias("example_session"))
    return odd.groupBy("type").agg(F.count("*").alias("n")).join(shown, "type")


#: Where a warning lies, by its kind; the others lie at what their ref names.
LOCATIONS = {"json": "line ", "io": "line ", "out_of_order": "(file order)", "unclosed_turn": "turn ", "unclosed_tool": "tool ", "unclosed_hook": "hook "}


def warning_groups(warnings: DataFrame, most: int = 3) -> DataFrame:
    """Per kind of warnings (session_id, kind, ref): n, and where up to `most` of them lie, as session:place, in order of session and ref."""
    place = F.lit("")
    for kind, text in LOCATIONS.items():
        place = F.when(F.col("kind") == kind, F.lit(text)).otherwise(place)
    at = F.concat("session_id", F.lit(":"), place, F.when(F.col("kind") == "out_of_order", "").otherwise(F.coalesce(F.col("ref").cast("string"), F.lit(""))))
    firsts = first_k(warnings.select("kind", "session_id", "ref", at.alias("at")), ["kind"], ["session_id", "ref"], most)
    shown = firsts.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "at"))), lambda s: s["at"]).alias("locations"))
    return warnings.groupBy("kind").agg(F.count("*").alias("n")).join(shown, "kind")


def classify(raw: DataFrame, events: DataFrame, warnings: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """E31 in full: head (sessions, events), versions (agent_version, n), kinds, unknown, warnings and balance of scanned logs (raw lines, decoded events, parse warnings, sessions)."""
    named = warnings.select(F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("session_id"), "kind", F.col("line_no").alias("ref"))
    return {
        "head": sessions.agg(F.count("*").alias("sessions")).crossJoin(events.agg(F.count("*").alias("events"))), "versions": sessions.where("agent_version is not null").groupBy("agent_version").agg(F.count("*").alias("n")),
        "kinds": events.groupBy("kind").agg(F.count("*").alias("n")), "unknown": unknown_types(raw, events), "warnings": warning_groups(named), "balance": balance(events),
    }


def leaks(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), name for each home path with a name that is not allowed."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.explode(home_leaks(F.col("x"))).alias("name"))


def raw_lines(lines: DataFrame, ids: tuple[str, ...] = (), limit: int = 0) -> DataFrame:
    """file_path, session_id, line_no (from 1), line of log lines that are JSON objects; of the named sessions, or of the first `limit` by id (0: all)."""
    rows = lines.where(F.try_parse_json("line").isNotNull() & F.ltrim("line").startswith("{")).withColumn("session_id", F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1))
    if ids:
        rows = rows.where(F.col("session_id").isin(*ids))
    if limit:
        rows = rows.join(rows.select("session_id").distinct().orderBy("session_id").limit(limit), "session_id", "left_semi")
    return rows.select("file_path", "session_id", (F.col("line_no") + 1).alias("line_no"), "line")


def aligned(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Raw lines beside the kinds of the events they became (events: file_path, seq, kind); lines that became none are left out."""
    return raw.join(events.select("file_path", (F.col("seq") + 1).alias("line_no"), "kind"), ["file_path", "line_no"])


def out_of_order(events: DataFrame) -> DataFrame:
    """one row for each session in which any event is earlier than the one before it."""
    back = F.col("ts") < F.lag("ts").over(Window.partitionBy("session_id").orderBy("seq"))
    return events.withColumn("b", back).groupBy("session_id").agg(F.bool_or("b").alias("b")).where("b").select("session_id", F.lit("out_of_order").alias("kind"))
