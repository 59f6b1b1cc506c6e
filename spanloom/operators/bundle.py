"""All episode tables of a set of sessions by name."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import folders
from . import episodes, ranks


class Episodes:
    """The episode tables of events, and the session bundle over them; all rest on one sort by session. Tables are planned when asked for."""

    def __init__(self, events: DataFrame, rows: DataFrame | None = None):
        self.events = events
        self.rows = episodes.routed(events) if rows is None else rows
        self.calls = episodes.tool_calls(self.rows)
        self.hooks = episodes.hook_calls(self.rows)
        self.turns = episodes.turns(self.rows)
        self.modes = episodes.mode_segments(self.rows)

    @cached_property
    def skills(self) -> DataFrame:
        return self.rows.where("kind = 'skill_invoked'").select("session_id", "seq", "name", "ts", F.col("open_turn_seq").alias("turn_seq"))

    @cached_property
    def walls(self) -> DataFrame:
        return episodes.session_wall(self.rows)

    @cached_property
    def bounds(self) -> DataFrame:
        """session_id, zero, last: the times of the first and the last event."""
        return self.rows.groupBy("session_id").agg(F.min_by("ts", "seq").alias("zero"), F.max_by("ts", "seq").alias("last"))

    @contextmanager
    def held(self) -> Iterator[Episodes]:
        """The same episodes over routed events that are written once: for several tables of them, sorting by session and pairing is done once. The written events are removed at the end."""
        spark = self.rows.sparkSession
        path = folders.scratch(spark, "routed")
        self.rows.write.parquet(path)
        try:
            yield Episodes(self.events, spark.read.schema(self.rows.schema).parquet(path))
        finally:
            folders.remove(spark, path)

    def bundle(self) -> dict[str, DataFrame]:
        return {
            "turn_summary": ranks.turn_summary(self.turns, self.calls, self.hooks, self.skills), "tool_rank": ranks.tool_rank(self.calls), "hook_rank": ranks.hook_rank(self.hooks), "by_mode": ranks.by_mode(self.turns, self.calls),
            "sessions": ranks.session_list(self.turns, self.walls), "usage": ranks.last_usage(self.events), "announced": ranks.announced(self.events), "warnings": episodes.warnings(self.rows),
        }
