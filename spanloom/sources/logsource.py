"""Session logs as a data source: spark.read.format("session_logs").load(root).

One row a line of root/<folder>/events.jsonl, with what is known of its session. Files are dealt to tasks in groups of about
`group_bytes`; a task reads its files one after another, line by line. Conditions on modified_ms and folder are met when
files are listed, those on session_id after a file's first line; files that fail them are not read any further. With
option("what", "sessions") there is one row a session, and only first lines are read.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "session_logs"
REFS = "session_id string, agent string, folder string, file_path string, modified_ms bigint, size bigint, is_live boolean, started_ms bigint"
LINES = f"{REFS}, line_no bigint, line string, is_last boolean"
GROUP_BYTES = 64 << 20


@dataclass
class Log:
    folder: str
    path: str
    modified_ms: int
    size: int
    is_live: bool


@dataclass
class Group(InputPartition):
    value: int
    logs: list[Log]


@dataclass
class Wanted:
    """What a query asks of its files: bounds on their modification time, folders, ids; None stands for no condition."""

    least_ms: int | None = None
    most_ms: int | None = None
    folders: set | None = None
    ids: set | None = None

    def take(self, f: Filter) -> bool:
        """Whether the filter is met here, so that Spark need not test it again."""
        name = getattr(f, "attribute", ())
        if name == ("modified_ms",):
            bound = {GreaterThanOrEqual: (0, None), GreaterThan: (1, None), LessThanOrEqual: (None, 0), LessThan: (None, -1)}.get(type(f))
            if bound and isinstance(f.value, int):
                up, down = bound
                if up is not None:
                    self.least_ms = max(f.value + up, self.least_ms if self.least_ms is not None else f.value + up)
                else:
                    self.most_ms = min(f.value + down, self.most_ms if self.most_ms is not None else f.value + down)
                return True
        if name in (("folder",), ("session_id",)) and isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            which = "folders" if name == ("folder",) else "ids"
            held = getattr(self, which)
            setattr(self, which, values if held is None else held & values)
            return True
        return False

    def lists(self, log: Log) -> bool:
        return (self.least_ms is None or log.modified_ms >= self.least_ms) and (self.most_ms is None or log.modified_ms <= self.most_ms) and (self.folders is None or log.folder in self.folders)


def file_system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def listed(root: str) -> list[Log]:
    """The logs below a root, one a direct folder that holds events.jsonl; a file inuse.*.lock beside it marks a live session. A root that isn't there is an error."""
    from pyarrow import fs

    place, top = file_system(root)
    if place.get_file_info(top).type != fs.FileType.Directory:
        raise FileNotFoundError(f"no folder of sessions: {root}")
    found, live = {}, set()
    for info in place.get_file_info(fs.FileSelector(top, recursive=True)):
        parts = info.path[len(top.rstrip("/")) + 1 :].split("/")
        if len(parts) != 2 or info.type != fs.FileType.File:
            continue
        folder, name = parts
        if name == "events.jsonl":
            found[folder] = Log(folder, info.path, info.mtime_ns // 1_000_000, info.size, False)
        elif name.startswith("inuse.") and name.lower().endswith(".lock"):
            live.add(folder)
    return [Log(x.folder, x.path, x.modified_ms, x.size, x.folder in live) for x in found.values()]


def first_values(line: str) -> tuple[str | None, int | None]:
    """A3, A4: the session's id and start in ms as a log's first line gives them; None for what it lacks or if it is no JSON."""
    try:
        value = json.loads(line)
        data = value.get("data") if isinstance(value.get("data"), dict) else {}
    except (ValueError, AttributeError):
        return None, None
    ids = [x for x in (data.get("sessionId"), value.get("sessionId")) if isinstance(x, str)]
    times = [x for x in (data.get("startTime"), value.get("timestamp")) if isinstance(x, str)]
    try:
        at = datetime.fromisoformat(times[0]) if times else None
    except ValueError:
        at = None
    return (ids[0] if ids else None), (round(at.timestamp() * 1000) if at and at.tzinfo else None)


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.sessions_only = options["path"], options.get("what") == "sessions"
        self.group_bytes, self.wanted = int(options.get("group_bytes", GROUP_BYTES)), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Group]:
        """Files in groups of about group_bytes, larger ones alone; when only first lines are read, a file counts as 64 KB."""
        groups, size = [[]], 0
        for log in sorted(filter(self.wanted.lists, listed(self.root)), key=lambda x: (-x.modified_ms, x.folder)):
            cost = min(log.size, 1 << 16) if self.sessions_only else log.size
            if groups[-1] and size + cost > self.group_bytes:
                groups.append([])
                size = 0
            groups[-1].append(log)
            size += cost
        return [Group(i, g) for i, g in enumerate(groups)]

    def read(self, partition: Group) -> Iterator[tuple]:
        place, _ = file_system(self.root)
        for log in partition.logs:
            with io.BufferedReader(place.open_input_stream(log.path), 1 << 20) as raw:
                lines = (x.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace") for x in iter(raw.readline, b""))
                line = next(lines, None)
                named, started = first_values(line or "")
                session = named or log.folder
                if self.wanted.ids is not None and session not in self.wanted.ids:
                    continue
                known = (session, "copilot", log.folder, f"{log.path}", log.modified_ms, log.size, log.is_live, started)
                if self.sessions_only:
                    yield known
                    continue
                n = 0
                while line is not None:
                    later = next(lines, None)
                    yield (*known, n, line, later is None)
                    line, n = later, n + 1


class SessionLogs(DataSource):
    """The data source; see the module."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return REFS if self.options.get("what") == "sessions" else LINES

    def reader(self, schema) -> LogReader:
        return LogReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SessionLogs)


@dataclass
class LogFolder:
    """A source of sessions: what there is, and the tables of some of them."""

    spark: SparkSession
    root: str
    name: str = "files"
    options: dict = field(default_factory=dict)

    def __post_init__(self):
        register(self.spark)

    def _read(self, what: str) -> DataFrame:
        return self.spark.read.format(NAME).options(what=what, **self.options).load(self.root)

    def refs(self, since_ms: int | None = None) -> DataFrame:
        """The sessions (REFS), newest change first; since_ms leaves out logs that were last changed before."""
        found = self._read("sessions")
        found = found if since_ms is None else found.where(F.col("modified_ms") >= since_ms)
        return found.orderBy(F.desc("modified_ms"), "session_id")

    def lines(self, ids: list[str] | None = None, since_ms: int | None = None) -> DataFrame:
        """A5: the lines of all sessions or some, as jsonl.decode takes them."""
        rows = self._read("lines")
        rows = rows if ids is None else rows.where(F.col("session_id").isin(*ids) if ids else F.lit(False))
        rows = rows if since_ms is None else rows.where(F.col("modified_ms") >= since_ms)
        return rows.withColumn("mtime", F.timestamp_millis("modified_ms"))

    def episodes(self, ids: list[str] | None = None):
        """The episode tables of all sessions or some, under the sessions' own ids; the cut last line of a live one is dropped."""
        from ..operators.bundle import Episodes
        from .jsonl import decode

        lines = self.lines(ids)
        events, _ = decode(lines, live=F.col("is_live"))
        named = lines.where("line_no = 0").select("file_path", F.col("session_id").alias("_id"))
        return Episodes(events.join(named, "file_path").withColumn("session_id", F.col("_id")).drop("_id"))


def sources(*found: LogFolder) -> dict[str, LogFolder]:
    """Sources by name."""
    return {s.name: s for s in found}
