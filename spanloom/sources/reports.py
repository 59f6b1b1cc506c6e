"""Shapes of reports: roll-ups as CSV with fixed headers and as one JSON document, stored reports a line a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cache_metrics

#: Fixed headers of a roll-up's CSV, each with the column that it shows, in order.
HEADERS = {
    "tool": {"name": "name", "source": "source", "call_count": "calls", "success_count": "ok", "failure_count": "fail", "total_duration_ms": "total_ms", "p50_ms": "p50", "p95_ms": "p95", "session_count": "sessions"},
    "mcp_server": {"server": "server", "tool_count": "tools", "call_count": "calls", "failure_count": "fail", "total_duration_ms": "total_ms", "session_count": "sessions", "unused_tool_count": "unused", "fully_unused_session_count": "unused_sessions", "wasted_tokens (approx)": "wasted_tokens"},
    "day": {"date": "day", "session_count": "sessions", "wall_ms": "wall_ms", "tool_ms": "tool_ms", "output_tokens": "output_tokens", "utilization_pct": "utilisation", "is_low_utilization": "low", "cache_creation": "cache_write", "cache_read": "cache_read", "hit_pct_honest": "hit", "saved_net": "net"},
    "model": {"model": "model", "session_count": "sessions", "turn_count": "turns", "output_tokens": "output_tokens", "total_duration_ms": "wall_ms", "cache_creation": "cache_write", "cache_read": "cache_read", "hit_pct_honest": "hit", "saved_net": "net"},
}


def _extra(rollup: DataFrame, by: str) -> DataFrame:
    """The roll-up with what its report shows beside its own columns: a tool's source, cache counters (0 if it has none) and metrics."""
    if by == "tool":
        source = F.when(F.col("source_kind") == "builtin", "builtin").otherwise(F.concat_ws(":", "source_kind", "source_name"))
        return rollup.withColumn("source", source)
    if by not in ("day", "model"):
        return rollup
    counters = {c: F.coalesce(F.col(c), F.lit(0)) if c in rollup.columns else F.lit(0) for c in ("cache_read", "cache_write")}
    out = rollup.withColumns({k: v.cast("bigint") for k, v in counters.items()})
    m = cache_metrics(F.lit(0), F.col("cache_read"), F.col("cache_write"))
    return out.withColumns({"hit": 100 * m["honest"], "net": m["net"]})


def csv_rows(rollup: DataFrame, by: str) -> DataFrame:
    """A roll-up (by tool, mcp_server, day or model) as texts under its fixed headers: rates with two decimals, empty where there is nothing to say."""
    if by not in HEADERS:
        raise ValueError(f"no report by {by!r}")
    rows = _extra(rollup, by)
    kinds = dict(rows.dtypes)

    def shown(c: str) -> Column:
        text = F.format_string("%.2f", F.col(c).cast("double")) if kinds[c] in ("double", "float") else F.col(c).cast("string")
        return F.when(F.col(c).isNull(), "").otherwise(text)

    return rows.select(*[shown(c).alias(name) for name, c in HEADERS[by].items()])


def write_csv(rollup: DataFrame, by: str, path: str) -> None:
    """csv_rows as files with a header each; parts follow the roll-up's order."""
    csv_rows(rollup, by).write.option("header", True).option("emptyValue", "").csv(path)


def rollup_json(rollup: DataFrame, by: str, header: DataFrame) -> DataFrame:
    """Value: one JSON document {by, data}, where data holds the header's row (ranks.header) and the buckets in the roll-up's order. A report is read as a whole, so it is one row: limit the roll-up first if its keys are many."""
    rows = _extra(rollup, by).withColumn("_at", F.monotonically_increasing_id())
    columns = [c for c in rows.columns if c != "_at"]
    buckets = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.struct(*columns).alias("b")))), lambda x: x["b"]).alias("buckets"))
    named = header.drop("by").crossJoin(buckets)  # a row each
    return named.select(F.to_json(F.struct(F.lit(by).alias("by"), F.struct(*named.columns).alias("data")), {"ignoreNullFields": "false"}).alias("value"))


def report_parts(reports: DataFrame, column: str = "analysis_report_json") -> DataFrame:
    """Value: a line {key: part} for each top-level key of stored reports (JSON texts); one {"value": ...} for a report that is no object."""
    text = F.col(column)
    parts = F.from_json(text, "map<string, variant>")
    lines = F.transform(F.map_entries(parts), lambda e: F.to_json(F.create_map(e["key"], e["value"])))
    whole = F.array(F.concat(F.lit('{"value":'), F.trim(text), F.lit("}")))
    return reports.where(text.isNotNull()).select(F.explode(F.when(F.ltrim(text).startswith("{"), lines).otherwise(whole)).alias("value"))
