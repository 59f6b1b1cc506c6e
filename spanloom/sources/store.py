"""Stored sessions as Parquet: upserts by id, windows, pruning, statistics, and merging with files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str = "id", at: str = "ingested_at") -> DataFrame:
    """The latest row of each id of both tables; among equal times the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(key).orderBy(F.desc(at), F.desc("_new"))
    return both.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r", "_new")


def replace_children(old: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """Old child rows of sessions that new does not hold, and new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def newer(sessions: DataFrame, now_ms: int, since_ms: int | None) -> DataFrame:
    """Sessions that began within the window, newest first; without a window all that have a start."""
    kept = sessions.where("started_at is not null") if since_ms is None else sessions.where(F.col("started_at") >= now_ms - since_ms)
    return kept.orderBy(F.desc("started_at"), "id")


def expired(now_ms: int, retention_ms: int) -> Column:
    return F.coalesce(F.col("started_at") < now_ms - retention_ms, F.lit(False))


def prune(sessions: DataFrame, children: DataFrame, now_ms: int, retention_ms: int) -> tuple[DataFrame, DataFrame]:
    """Both tables without sessions older than the retention; a session without a start stays."""
    kept = sessions.where(~expired(now_ms, retention_ms))
    return kept, children.join(kept.select(F.col("id").alias("session_id")), "session_id", "left_semi")


def stats(sessions: DataFrame, tools: DataFrame, turns: DataFrame) -> DataFrame:
    """One row: the three tables' counts, and the first and last start."""
    s = sessions.agg(F.count("*").alias("sessions"), F.min("started_at").alias("first"), F.max("started_at").alias("last"))
    return s.crossJoin(tools.agg(F.count("*").alias("tools"))).crossJoin(turns.agg(F.count("*").alias("turns")))


def merge_refs(files: DataFrame, store: DataFrame) -> DataFrame:
    """References (id, started_at, path, mtime) of both sides, the file's values first, with the names of fields that differ where both have one."""
    j = files.alias("f").join(store.alias("s"), F.col("f.id") == F.col("s.id"), "full")
    cols = ("mtime", "started_at", "path")
    both = F.col("f.id").isNotNull() & F.col("s.id").isNotNull()
    diff = F.filter(F.array(*[F.when(both & (F.col(f"f.{c}") != F.col(f"s.{c}")), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return j.select(F.coalesce("f.id", "s.id").alias("id"), *[F.coalesce(f"f.{c}", f"s.{c}").alias(c) for c in cols], F.concat_ws(",", diff).alias("differs"), F.when(F.col("f.id").isNotNull(), "file").otherwise("store").alias("origin"))


def fall_through(store: DataFrame, files: DataFrame, key: str = "session_id") -> DataFrame:
    """Stored rows, and files' rows of sessions that the store lacks."""
    return store.unionByName(files.join(store.select(key).distinct(), key, "left_anti"))


def report_lines(rows: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A roll-up as CSV with a header, rates with two decimals."""
    two = {c: F.format_string("%.2f", c) for c, kind in rows.dtypes if kind in ("double", "float")}
    rows.withColumns(two).write.option("header", True).csv(path)


def lookup(rows: DataFrame, session: str, key: str = "session_id") -> DataFrame:
    """The stored rows of one session; none if it is not stored."""
    return rows.where(F.col(key) == session)


def selected(refs: DataFrame, selector: str) -> DataFrame:
    """The reference (id, path, mtime) that a selector means: latest, previous, an id, or a path of a log or its folder. None if there is no such session."""
    if selector in ("latest", "previous"):
        # the two newest of all, not a window over all of them
        top = refs.orderBy(F.desc("mtime"), "id").limit(2).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("mtime"), "id")))
        return top.where(F.col("_r") == (1 if selector == "latest" else 2)).drop("_r")
    if "/" in selector or "\\" in selector:
        whole = selector.rstrip("/\\")
        return refs.where(F.col("path").isin(whole, f"{whole}/events.jsonl"))
    if not re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", selector):
        raise ValueError(f"not a session: {selector!r} (latest, previous, an id or a path)")
    return refs.where(F.col("id") == selector)


def agent_of(text: Column) -> Column:
    """C17: a stored agent; copilot for what is unknown or null."""
    return F.when(text.isin("copilot", "claude", "codex"), text).otherwise("copilot")


def in_window(rows: DataFrame, sessions: DataFrame, now_ms: int, since_ms: int | None, key: str = "session_id") -> DataFrame:
    """The rows of stored sessions that began within a window, for the same roll-ups as over logs."""
    ids = newer(sessions, now_ms, since_ms).select(F.col("id").alias(key))
    return rows.join(ids, key, "left_semi")


def dashboard(sessions: DataFrame, now_ms: int, days: int = 30, most: int = 200) -> DataFrame:
    """The `most` latest sessions of the last `days` days."""
    return newer(sessions, now_ms, days * 86_400_000).limit(most)


def outcome(sessions: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row: sessions that a batch took in, and files of which no session came (their lines are warnings); see ingest."""
    failed = warnings.select("file_path").distinct().join(sessions.select("file_path").distinct(), "file_path", "left_anti")
    return sessions.agg(F.count("*").alias("stored")).crossJoin(failed.agg(F.count("*").alias("failed")))


def ingest(old: DataFrame, sessions: DataFrame, warnings: DataFrame, key: str = "id") -> DataFrame:
    """The store with a batch's sessions written through. Files that fail are counted, and only if none succeeds is it an error."""
    row = outcome(sessions, warnings).first()
    if row["failed"] and not row["stored"]:
        raise ValueError(f"none of {row['failed']} logs could be stored")
    return upsert(old, sessions.select(*old.columns), key)
