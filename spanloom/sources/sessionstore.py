"""A store of analysed sessions on disk: four Parquet tables, replaced session by session, pruned by day.

All tables are partitioned by `part`, a hash of the session's id, and `day`, the day of its start. A batch touches the parts of its
sessions only: old rows there are read, those of the batch's sessions fall out, and the days that change are overwritten as
whole partitions. Children are written before their sessions, and a batch that runs again gives the same files, so a run that
breaks off is mended by running it again. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import saturating_sum, source_kind, source_name
from . import folders

SESSIONS = (
    "id string, agent string, dominant_model string, started_at bigint, duration_ms bigint, raw_path string, raw_mtime bigint, total_input_tokens bigint, total_output_tokens bigint, "
    "total_cache_read bigint, total_cache_creation bigint, schema_version bigint, ingested_at bigint, analysis_report_json string"
)
TOOLS = "session_id string, tool_name string, source string, call_count bigint, total_duration_ms bigint, tokens bigint, token_source string"
TURNS = "session_id string, turn_index bigint, input_tokens bigint, output_tokens bigint, cache_read bigint, cache_creation bigint, model string"
EPISODES = "session_id string, ingested_at bigint, episodes_json string"
SCHEMAS = {"episodes": EPISODES, "turn_buckets": TURNS, "tools_loaded": TOOLS, "sessions": SESSIONS}
KEYS = {"sessions": "id", "tools_loaded": "session_id", "turn_buckets": "session_id", "episodes": "session_id"}
NO_DAY, DAY_MS = "none", 86_400_000
NO_EPISODES = "{}"


def day_of(started_ms: Column) -> Column:
    """The day of a start as text; NO_DAY without one."""
    return F.coalesce(F.to_date(F.timestamp_millis(started_ms)).cast("string"), F.lit(NO_DAY))


class SessionStore:
    def __init__(self, spark: SparkSession, path: str, parts: int = 32):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _raw(self, table: str) -> DataFrame:
        schema = f"{SCHEMAS[table]}, part int, day string"
        return self.spark.read.schema(schema).parquet(self._at(table)) if folders.children(self.spark, self._at(table)) else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """The stored rows of sessions, tools_loaded, turn_buckets or episodes."""
        return self._raw(name).drop("part", "day")

    def newer(self, now_ms: int, since_ms: int) -> DataFrame:
        """Sessions that began within the window; days before it are not read."""
        first = now_ms - since_ms
        return self._raw("sessions").where((F.col("day") >= F.lit(_day_text(first))) & (F.col("day") != NO_DAY) & (F.col("started_at") >= first)).drop("part", "day")

    def lookup(self, session: str, table: str = "sessions") -> DataFrame:
        """The rows of one session; one part is read."""
        part = self.spark.range(1).select(self._part(F.lit(session))).first()[0]
        return self._raw(table).where((F.col("part") == part) & (F.col(KEYS[table]) == session)).drop("part", "day")

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _overwrite(self, name: str, rows: DataFrame, places: set[tuple[int, str]]) -> None:
        """Puts rows (with part and day) in the place of what those partitions hold; those that get no row are removed."""
        filled = {(r["part"], r["day"]) for r in rows.select("part", "day").distinct().collect()}
        if filled:
            rows.repartition("part", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "day").parquet(self._at(name))
        for part, day in places - filled:
            folders.remove(self.spark, f"{self._at(name)}/part={part}/day={day}")

    def _replace(self, name: str, rows: DataFrame, ids: DataFrame, touched: list[int]) -> None:
        """Stores rows in the place of all rows of ids (id, day), which lie in the touched parts. Partitions that hold none of these ids stay as they are."""
        key = KEYS[name]
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        gone = ids.select(F.col("id").alias(key))
        new = rows.join(ids.select(F.col("id").alias(key), "day"), key).select(*columns, self._part(F.col(key)).alias("part"), "day")
        old = self._raw(name).where(F.col("part").isin(touched))
        changed = old.join(gone, key, "left_semi").select("part", "day").union(new.select("part", "day")).distinct()
        places = {(r["part"], r["day"]) for r in changed.collect()}  # at most the parts and days of one batch's sessions
        days = sorted({day for _, day in places})
        kept = old.where(F.col("day").isin(days)).join(changed, ["part", "day"], "left_semi").join(gone, key, "left_anti")
        self._overwrite(name, kept.select(*columns, "part", "day").unionByName(new), places)

    def upsert(self, sessions: DataFrame, tools: DataFrame, turns: DataFrame, at_ms: int) -> int:
        """Replaces sessions by id, with all their tools and turns; their episodes become NO_EPISODES until upsert_episodes runs. Of several rows of an id in the batch the one with the latest start counts; rows without an id are left out. Gives the number of sessions."""
        own = sessions.where("id is not null").withColumn("ingested_at", F.lit(at_ms).cast("bigint"))
        rows = own.groupBy("id").agg(F.max_by(F.struct(*own.columns), F.struct("started_at", "raw_path")).alias("s")).select("s.*")
        batch = folders.scratch(self.spark, "store-batch")
        rows.withColumn("day", day_of(F.col("started_at"))).write.parquet(f"{batch}/sessions")
        rows = self.spark.read.parquet(f"{batch}/sessions")
        ids = rows.select("id", "day")
        touched = [r[0] for r in ids.select(self._part(F.col("id"))).distinct().collect()]
        n = ids.count()
        if n:
            blank = rows.select(F.col("id").alias("session_id"), F.lit(at_ms).cast("bigint").alias("ingested_at"), F.lit(NO_EPISODES).alias("episodes_json"))
            for name, new in (("episodes", blank), ("turn_buckets", turns), ("tools_loaded", tools), ("sessions", rows.drop("day"))):
                # read several times, so made once
                new.write.parquet(f"{batch}/new-{name}")
                self._replace(name, self.spark.read.schema(new.schema).parquet(f"{batch}/new-{name}"), ids, touched)
        folders.remove(self.spark, batch)
        return n

    def upsert_episodes(self, episodes: DataFrame, at_ms: int) -> int:
        """Stores episodes (session_id, episodes_json) of sessions that the store has; others are left out. Gives their number."""
        new = episodes.select("session_id", F.lit(at_ms).cast("bigint").alias("ingested_at"), "episodes_json")
        batch = folders.scratch(self.spark, "store-batch")
        known = self._raw("sessions").select("id", "day").join(new.select(F.col("session_id").alias("id")), "id", "left_semi")
        known.write.parquet(f"{batch}/ids")
        ids = self.spark.read.parquet(f"{batch}/ids")
        touched = [r[0] for r in ids.select(self._part(F.col("id"))).distinct().collect()]
        n = ids.count()
        if n:
            self._replace("episodes", new, ids, touched)
        folders.remove(self.spark, batch)
        return n

    def prune(self, now_ms: int, retention_ms: int, dry_run: bool = False) -> int:
        """Removes sessions that began before the retention, with their children, and gives their number; a dry run only counts. Sessions without a start stay.

        Whole days before the boundary are removed as folders, without being read; in the boundary's day rows are rewritten.
        """
        cutoff = now_ms - retention_ms
        edge = _day_text(cutoff)
        raw = self._raw("sessions")
        old = raw.where((F.col("day") != NO_DAY) & (F.col("day") <= edge) & (F.col("started_at") < cutoff))
        n = old.count()
        if dry_run or not n:
            return n
        batch = folders.scratch(self.spark, "store-batch")
        old.where(F.col("day") == edge).select("id").write.parquet(f"{batch}/ids")
        gone = self.spark.read.parquet(f"{batch}/ids")
        parts = [r[0] for r in gone.select(self._part(F.col("id"))).distinct().collect()]
        for name in SCHEMAS:  # sessions last, as in upsert
            for part in [p for p in folders.children(self.spark, self._at(name)) if p.startswith("part=")]:
                for day in folders.children(self.spark, f"{self._at(name)}/{part}"):
                    if day.startswith("day=") and day[4:] != NO_DAY and day[4:] < edge:
                        folders.remove(self.spark, f"{self._at(name)}/{part}/{day}")
            if parts:
                rows = self._raw(name).where(F.col("part").isin(parts) & (F.col("day") == edge))
                left = rows.join(gone.select(F.col("id").alias(KEYS[name])), KEYS[name], "left_anti").select(*rows.columns)
                self._overwrite(name, left, {(p, edge) for p in parts})
        folders.remove(self.spark, batch)
        return n

    def stats(self) -> DataFrame:
        """One row: sessions, tools_loaded, turn_buckets, size_bytes, oldest_started_ms, newest_started_ms."""
        s = self._raw("sessions").agg(F.count("*").alias("sessions"), F.min("started_at").alias("oldest_started_ms"), F.max("started_at").alias("newest_started_ms"))
        for name in ("tools_loaded", "turn_buckets"):
            s = s.crossJoin(self._raw(name).agg(F.count("*").alias(name)))  # one row each
        return s.withColumn("size_bytes", F.lit(folders.size(self.spark, self.path)))

    def sink(self, split: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]], clock: Callable[[], int]) -> Callable[[DataFrame, int], None]:
        """A function for foreachBatch: split makes a batch's sessions, tools and turns, which upsert stores. A batch that runs again replaces the same sessions."""

        def flush(batch: DataFrame, number: int) -> None:
            self.upsert(*split(batch), clock())

        return flush


def _day_text(ms: int) -> str:
    return datetime.fromtimestamp(ms // 1000, UTC).date().isoformat()


def report_tables(meta: DataFrame, tool_rank: DataFrame, turn_summary: DataFrame, usage: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, tools_loaded, turn_buckets) of analysed sessions: meta (session_id, agent, started_at, raw_path, raw_mtime), their tool_rank, turn_summary (with turn_seq) and model usage.

    Totals are null for sessions without usage; the dominant model is the one with the most tokens, of equals the smaller name.
    """
    parts = ("input_tokens", "output_tokens", "cache_read", "cache_write")
    used = usage.withColumn("_total", sum((F.col(c) for c in parts[1:]), F.col(parts[0])))
    totals = used.groupBy("session_id").agg(*[saturating_sum(F.col(c)).alias(c) for c in parts], F.min_by("model", F.struct(-F.col("_total"), F.col("model"))).alias("dominant_model"))
    kind = source_kind(F.col("name"))
    source = F.when(kind == "builtin", kind).otherwise(F.concat(kind, F.lit(":"), source_name(F.col("name"))))
    none = lambda t: F.lit(None).cast(t)
    tools = tool_rank.select("session_id", F.col("name").alias("tool_name"), source.alias("source"), F.col("calls").alias("call_count"), F.col("total_ms").alias("total_duration_ms"), none("bigint").alias("tokens"), none("string").alias("token_source"))
    index = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_seq")) - 1
    turns = turn_summary.select("session_id", index.cast("bigint").alias("turn_index"), none("bigint").alias("input_tokens"), "output_tokens", none("bigint").alias("cache_read"), none("bigint").alias("cache_creation"), "model")
    ms = F.unix_millis("started_at")
    head = F.to_json(F.struct(F.struct(F.col("session_id").alias("id"), "agent", ms.alias("started_at")).alias("meta"), F.struct(*[F.col(c) for c in parts]).alias("totals")), {"ignoreNullFields": "false"})
    sessions = meta.join(totals, "session_id", "left").select(
        F.col("session_id").alias("id"), "agent", "dominant_model", ms.alias("started_at"), none("bigint").alias("duration_ms"), "raw_path", "raw_mtime", F.col("input_tokens").alias("total_input_tokens"), F.col("output_tokens").alias("total_output_tokens"),
        F.col("cache_read").alias("total_cache_read"), F.col("cache_write").alias("total_cache_creation"), F.lit(1).cast("bigint").alias("schema_version"), none("bigint").alias("ingested_at"), head.alias("analysis_report_json"),
    )
    return sessions, tools, turns
