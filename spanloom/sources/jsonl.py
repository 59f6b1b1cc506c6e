"""Session logs: one folder a session with events.jsonl, read as ordered lines and decoded to canonical events."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import announced_tools
from ..schema import KINDS, REQUIRED
from .folders import matching


def since_seconds(window: str) -> int | None:
    """Seconds of a window such as 30m, 12h or 7d; None for `all`."""
    if window == "all":
        return None
    m = re.fullmatch(r"(\d+)([smhd])", window)
    if not m:
        raise ValueError(f"not a window: {window!r}")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]]


def lines(spark: SparkSession, pattern: str, since: Column | None = None) -> DataFrame:
    """file_path, mtime, line_no (from 0, blank lines counted), line. The order is the file's: blocks by their start, and within a block the order of the scan. since prunes files by their modification time."""
    raw = spark.read.text(pattern).select("value", "_metadata.file_path", F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    raw = raw if since is None else raw.where(F.col("mtime") >= since)
    order = Window.partitionBy("file_path").orderBy("block", "at")
    return raw.select("file_path", "mtime", (F.row_number().over(order) - 1).cast("long").alias("line_no"), F.col("value").alias("line"), F.lead("value").over(order).isNull().alias("is_last"))


def folder_lines(spark: SparkSession, places: list[str]) -> DataFrame:
    """A5: lines of sessions whose log lies in several files of one folder (*.jsonl), as lines gives them: numbered on from file to file, in order of the files' names; file_path is that of an events.jsonl in the folder."""
    raw = spark.read.text([f"{p.rstrip('/')}/*.jsonl" for p in places]).select("value", F.regexp_replace("_metadata.file_path", r"[^/]+$", "events.jsonl").alias("file_path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    order = Window.partitionBy("file_path").orderBy("file", "block", "at")
    return raw.select("file_path", "mtime", (F.row_number().over(order) - 1).cast("long").alias("line_no"), F.col("value").alias("line"), F.lead("value").over(order).isNull().alias("is_last"))


def incomplete(line: Column) -> Column:
    """Whether a line ends inside a string or with braces open."""
    bare = F.regexp_replace(F.regexp_replace(line, r"\\\\.", ""), r'"[^"]*"', "")
    return (F.length(F.regexp_replace(bare, r"[^{]", "")) > F.length(F.regexp_replace(bare, r"[^}]", ""))) | bare.contains('"')


def _field(path: str) -> Column:
    return F.get_json_object("line", f"$.{path}")


def decode(raw: DataFrame, live: Column | None = None, unknown_ts: str = "epoch") -> tuple[DataFrame, DataFrame]:
    """Canonical events and parse warnings of lines. Blank lines are skipped; a line that is no JSON object or lacks a required field becomes a warning; the cut last line of a live file is dropped. Events of unknown types get an empty id and, with unknown_ts "epoch", the time 0 (else they are dropped)."""
    rows = raw.where(F.trim("line") != "")
    live = F.lit(False) if live is None else live
    rows = rows.where(~(live & F.col("is_last") & incomplete(F.col("line"))))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    rows = rows.withColumn("type", _field("type")).withColumn("kind", F.element_at(kinds, F.col("type")))
    ok_json = F.try_parse_json("line").isNotNull() & F.col("type").isNotNull()
    lacking = F.lit(False)
    for kind, fields in REQUIRED.items():
        some = [_field(f"data.{f}").isNull() for f in fields]
        lacking = lacking | ((F.col("type") == kind) & F.coalesce(*[F.when(c, F.lit(True)) for c in some], F.lit(False)))
    asked, failed = _field("data.toolRequests"), _field("data.error")
    each = F.from_json(asked, "array<struct<toolCallId: string, name: string, arguments: string, type: string>>")
    some = F.exists(each, lambda r: r["toolCallId"].isNull() | r["name"].isNull() | r["arguments"].isNull() | r["type"].isNull())
    nested = ((F.col("type") == "assistant.message") & asked.isNotNull() & (each.isNull() | some)) | ((F.col("type") == "tool.execution_complete") & failed.isNotNull() & _field("data.error.message").isNull())
    lacking = lacking | F.coalesce(nested, F.lit(False))
    envelope = F.col("kind").isNotNull() & (_field("id").isNull() | F.try_to_timestamp(_field("timestamp")).isNull() | _field("data").isNull())
    bad = ~ok_json | lacking | envelope
    marked = rows.withColumn("bad", bad)
    warnings = marked.where("bad").select("file_path", "line_no", F.lit("json").alias("kind"), F.when(ok_json, F.concat(F.lit("missing field in "), "type")).otherwise("not an event").alias("error"))
    good = marked.where("not bad")
    good = good if unknown_ts == "epoch" else good.where("kind is not null")
    is_ = lambda *k: F.col("kind").isin(*k)
    requests = F.from_json(_field("data.toolRequests"), "array<struct<toolCallId: string, arguments: string>>")
    usage = F.from_json(_field("data.modelMetrics"), "map<string, struct<usage: struct<inputTokens: bigint, outputTokens: bigint, cacheReadTokens: bigint, cacheWriteTokens: bigint>>>")
    z = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    metrics = F.transform_values(usage, lambda _, v: F.struct(z(v["usage"]["inputTokens"]).alias("input"), z(v["usage"]["outputTokens"]).alias("output"), z(v["usage"]["cacheReadTokens"]).alias("cache_read"), z(v["usage"]["cacheWriteTokens"]).alias("cache_write")))
    events = good.select(
        F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1).alias("session_id"), "file_path", F.col("line_no").alias("seq"), F.when(F.col("kind").isNull(), "").otherwise(_field("id")).alias("event_id"),
        F.when(F.col("kind").isNull(), F.timestamp_millis(F.lit(0))).otherwise(F.try_to_timestamp(_field("timestamp"))).alias("ts"), F.coalesce("kind", F.lit("unknown")).alias("kind"),
        F.when(is_("tool_start", "tool_user_requested"), _field("data.toolName")).when(is_("hook_start", "hook_end"), _field("data.hookType")).when(is_("skill_invoked"), _field("data.name")).alias("name"),
        _field("data.toolCallId").alias("call_id"), F.when(is_("assistant_message"), _field("data.model")).alias("model"), F.when(is_("assistant_message"), _field("data.outputTokens").cast("long")).alias("output_tokens"),
        F.when(is_("mode_changed"), _field("data.newMode")).alias("mode"), F.when(is_("tool_complete", "hook_end"), _field("data.success").cast("boolean")).alias("success"), _field("data.error.message").alias("error_message"),
        F.when(is_("assistant_message"), F.transform(requests, lambda r: F.struct(r["toolCallId"].alias("call_id"), r["arguments"].alias("arguments")))).alias("tool_requests"),
        F.when(is_("session_shutdown"), metrics).alias("model_metrics"), F.when(is_("user_message"), announced_tools(_field("data.transformedContent"))).alias("loaded_tools"), F.when(is_("session_start"), F.col("line")).alias("line"),
    )
    return events, warnings


def sessions(events: DataFrame) -> DataFrame:
    """A row a file: session_id by the first line's data.sessionId (else the folder), agent version, producer, start, place; of several starts the last. Files without a start are left out."""
    last = events.where("kind = 'session_start'").groupBy("file_path", F.col("session_id").alias("folder")).agg(F.max_by("line", "seq").alias("line"))
    return last.select("file_path", F.coalesce(_field("data.sessionId"), _field("sessionId"), "folder").alias("session_id"), F.lit("copilot").alias("agent"), _field("data.copilotVersion").alias("agent_version"), _field("data.producer").alias("producer"), F.coalesce(F.try_to_timestamp(_field("data.startTime")), F.try_to_timestamp(_field("timestamp"))).alias("started_at"), _field("data.context.cwd").alias("cwd"), _field("data.context.repository").alias("repository"), _field("data.context.branch").alias("branch"))


def live_folders(spark: SparkSession, root: str) -> DataFrame:
    """A2: session_id of folders that hold an inuse.*.lock file, which is empty as a rule: so folders are listed, and no file is read."""
    found = matching(spark, f"{root.rstrip('/')}/*/inuse.*.lock")
    return spark.createDataFrame([(p.rsplit("/", 2)[-2],) for p in found], "session_id string").distinct()


def server_config(spark: SparkSession, path: str) -> DataFrame:
    """A10: server, tool of a tool-server configuration; tool is null where only mcpServers' names are known."""
    text = spark.read.text(path, wholetext=True)
    some = text.select(F.explode(F.from_json(F.get_json_object("value", "$.servers"), "map<string, struct<tools: array<string>>>")).alias("server", "v")).select("server", F.explode("v.tools").alias("tool"))
    names = text.select(F.explode(F.map_keys(F.from_json(F.get_json_object("value", "$.mcpServers"), "map<string, string>"))).alias("server"))
    return some.unionByName(names.withColumn("tool", F.lit(None).cast("string")))


def tool_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Server, tool, description of one file {server: [tool]} or of a folder of <server>.json as {tools: [tool]} or [tool]; of a tool given twice the later file's counts."""
    entry = "array<struct<name: string, description: string>>"
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"), F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("stem"))
    single = F.coalesce(F.from_json(F.get_json_object("value", "$.tools"), entry), F.when(F.ltrim("value").startswith("["), F.from_json("value", entry)))
    one = text.where(single.isNotNull()).select(F.col("stem").alias("server"), "file", F.posexplode(single).alias("p", "t"))
    many = text.where(single.isNull()).select("file", F.explode(F.from_json("value", f"map<string, {entry}>")).alias("server", "ts")).select("server", "file", F.posexplode("ts").alias("p", "t"))
    both = one.unionByName(many).where("t.name is not null")
    return both.groupBy("server", F.col("t.name").alias("tool")).agg(F.max_by("t.description", F.struct("file", "p")).alias("description"))


#: Agent -> decoder of lines. Another format is added by registering its decoder.
FORMATS: dict[str, Callable] = {"copilot": decode}


def decoder(agent: str) -> Callable:
    if agent not in FORMATS:
        raise ValueError(f"no decoder for agent {agent!r}")
    return FORMATS[agent]
