"""Roll-ups that follow growing logs: only sessions whose logs changed are analysed again, their old rows taken off and the new ones added.

A session's part in all roll-ups is a few rows of counters (`shares`), and roll-ups are sums of shares. Batch n writes the
shares of its sessions to shares/batch=n and the sums to totals/batch=n, from what earlier batches wrote alone. A batch that runs
again, after any failure, gives the same two folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.percentiles import of_counts
from ..functions.scalars import source_kind, source_name
from ..operators.bundle import Episodes
from ..operators.ranks import with_utilisation
from ..sources import folders, jsonl

#: kind: tool (a row a duration, ms), caller (a session calls a tool), day, model; name: the tool, day or model.
KEYS = ("kind", "name", "ms")
SUMS = ("calls", "ok", "fail", "sessions", "wall_ms", "tool_ms", "output_tokens", "turns")
SHARES = "session_id string, kind string, name string, ms bigint, " + ", ".join(f"{c} bigint" for c in SUMS)


def _row(kind: str, name, ms=None, **sums):
    cols = {c: F.coalesce(sums[c], F.lit(0)).cast("bigint") if c in sums else F.lit(0).cast("bigint") for c in SUMS}
    return ["session_id", F.lit(kind).alias("kind"), name.cast("string").alias("name"), (F.lit(None) if ms is None else ms).cast("bigint").alias("ms"), *[c.alias(k) for k, c in cols.items()]]


def shares(e: Episodes) -> DataFrame:
    """What each session of e adds to the roll-ups by tool, day and model (SHARES)."""
    one = F.lit(1)
    status = F.col("status")
    calls = e.calls.groupBy("session_id", "name", "duration_ms").agg(F.count("*").alias("n"), F.count_if(status == "success").alias("ok"), F.count_if(status == "failure").alias("fail"))
    tools = calls.select(*_row("tool", F.col("name"), F.col("duration_ms"), calls=F.col("n"), ok=F.col("ok"), fail=F.col("fail"), tool_ms=F.col("n") * F.col("duration_ms")))
    callers = calls.select("session_id", "name").distinct().select(*_row("caller", F.col("name"), sessions=one))
    spent = calls.groupBy("session_id").agg(F.sum(F.col("n") * F.col("duration_ms")).alias("tool_ms"))
    turns = e.turns.groupBy("session_id").agg(F.min_by(F.struct("model"), "turn_seq").alias("first"), F.count("*").alias("turns"), F.sum("output_tokens").alias("tokens"))
    each = e.walls.join(spent, "session_id", "left").join(turns, "session_id", "left")
    days = each.select(*_row("day", F.to_date("started_at"), sessions=one, wall_ms=F.col("wall_ms"), tool_ms=F.col("tool_ms"), output_tokens=F.col("tokens")))
    models = each.where("first.model is not null").select(*_row("model", F.col("first.model"), sessions=one, wall_ms=F.col("wall_ms"), turns=F.col("turns"), output_tokens=F.col("tokens")))
    return tools.unionByName(callers).unionByName(days).unionByName(models)


def totals(rows: DataFrame) -> DataFrame:
    """The sums of shares, or of sums and signed shares; groups whose counters are all 0 again are left out."""
    agg = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
    return agg.where(F.greatest(*[F.abs(F.col(c)) for c in SUMS]) > 0)


def by_tool(sums: DataFrame) -> DataFrame:
    """E11 of totals."""
    tools = sums.where("kind = 'tool'")
    agg = tools.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("calls", "ok", "fail")], F.sum("tool_ms").alias("total_ms"))
    percentiles = of_counts(tools, ["name"], "ms", "calls", {"p50": 50, "p95": 95})
    callers = sums.where("kind = 'caller'").select("name", "sessions")
    out = agg.join(callers, "name").join(percentiles, "name")
    return out.select("name", source_kind(F.col("name")).alias("source_kind"), F.coalesce(source_name(F.col("name")), F.lit("")).alias("source_name"), "calls", "ok", "fail", "total_ms", "sessions", "p50", "p95")


def by_day(sums: DataFrame, low: float = 20.0) -> DataFrame:
    """E13 of totals."""
    return with_utilisation(sums.where("kind = 'day'").select(F.col("name").cast("date").alias("day"), "sessions", "wall_ms", "tool_ms", "output_tokens"), low)


def by_model(sums: DataFrame) -> DataFrame:
    """E14 of totals."""
    return sums.where("kind = 'model'").select(F.col("name").alias("model"), "sessions", "turns", "output_tokens", "wall_ms")


class LiveRollups:
    """Roll-ups of a folder of session logs, kept up to date in `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self, what: str, before: int | None) -> list[int]:
        found = (int(x[6:]) for x in folders.children(self.spark, f"{self.path}/{what}") if x.startswith("batch="))
        return sorted(n for n in found if (before is None or n < before) and folders.exists(self.spark, f"{self.path}/{what}/batch={n}/_SUCCESS"))

    def _read(self, what: str, numbers: list[int], schema: str) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema + ", batch bigint")
        paths = [f"{self.path}/{what}/batch={n}" for n in numbers]
        return self.spark.read.option("basePath", f"{self.path}/{what}").schema(schema + ", batch bigint").parquet(*paths)

    def shares(self, before: int | None = None) -> DataFrame:
        """Each session's latest shares, of the batches before a number."""
        rows = self._read("shares", self._batches("shares", before), SHARES)
        return rows.withColumn("_last", F.max("batch").over(Window.partitionBy("session_id"))).where("batch = _last").drop("_last", "batch")

    def totals(self, before: int | None = None) -> DataFrame:
        """The latest sums."""
        numbers = self._batches("totals", before)[-1:]
        return self._read("totals", numbers, SHARES.split(", ", 1)[1]).drop("batch")

    def refresh(self, events: DataFrame, number: int) -> None:
        """Batch `number`: events are the whole logs, decoded, of the sessions that changed. Their shares take the place of those that earlier batches gave them."""
        new = f"{self.path}/shares/batch={number}"
        with Episodes(events).held() as e:
            shares(e).write.mode("overwrite").parquet(new)
        fresh = self.spark.read.schema(SHARES).parquet(new)
        changed = fresh.select("session_id").distinct()
        old = self.shares(before=number).join(changed, "session_id", "left_semi")
        off = old.select("session_id", *KEYS, *[(-F.col(c)).alias(c) for c in SUMS])
        delta = totals(fresh.unionByName(off).drop("session_id"))
        totals(self.totals(before=number).unionByName(delta)).write.mode("overwrite").parquet(f"{self.path}/totals/batch={number}")

    def compact(self, number: int) -> None:
        """Writes all sessions' latest shares as batch `number`, whose totals are those of before, and removes the earlier batches."""
        earlier = {what: self._batches(what, number) for what in ("shares", "totals")}
        self.shares(before=number).write.mode("overwrite").parquet(f"{self.path}/shares/batch={number}")
        self.totals(before=number).write.mode("overwrite").parquet(f"{self.path}/totals/batch={number}")
        for what, numbers in earlier.items():
            for n in numbers:
                folders.remove(self.spark, f"{self.path}/{what}/batch={n}")

    def watch(self, root: str, checkpoint: str, most_files: int = 1000) -> DataStreamWriter:
        """A stream over root/<session>/*.jsonl that refreshes the roll-ups whenever files come. Logs grow by further files of a session's folder, read in order of their names; a batch reads the whole folders of the at most `most_files` files that are new."""
        stream = self.spark.readStream.option("maxFilesPerTrigger", most_files).format("text").load(f"{root.rstrip('/')}/*/*.jsonl")

        def flush(batch: DataFrame, number: int) -> None:
            new = batch.select(F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]+$", "").alias("folder")).distinct().collect()  # at most most_files
            if new:
                self.refresh(jsonl.decode(jsonl.folder_lines(self.spark, [r["folder"] for r in new]))[0], number)

        return stream.select("value", "_metadata").writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
