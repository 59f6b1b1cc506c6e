"""Telemetry exports as JSON: nested requests to records, and records to typed events. Works on tables and on streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>"
ATTRS = f"array<struct<key: string, value: {VALUE}>>"
POINTS = f"struct<dataPoints: array<struct<attributes: {ATTRS}, timeUnixNano: string, asInt: string, asDouble: double>>>"
RESOURCE = f"resource: struct<attributes: {ATTRS}>"
#: The parts of a request that are read, by signal: resources, their scopes, their records. 64-bit numbers may be numbers or texts.
EXPORT = {
    "log": f"resourceLogs: array<struct<{RESOURCE}, scopeLogs: array<struct<logRecords: array<struct<timeUnixNano: string, observedTimeUnixNano: string, attributes: {ATTRS}>>>>>>",
    "metric": f"resourceMetrics: array<struct<{RESOURCE}, scopeMetrics: array<struct<metrics: array<struct<name: string, sum: {POINTS}, gauge: {POINTS}>>>>>>",
    "trace": f"resourceSpans: array<struct<{RESOURCE}, scopeSpans: array<struct<spans: array<struct<name: string, startTimeUnixNano: string, endTimeUnixNano: string, attributes: {ATTRS}, status: struct<code: string, message: string>>>>>>>",
}
TYPED = (
    "session_id string, event_type string, agent string, ts timestamp, turn_id string, tool_name string, source string, user_approved boolean, status string, error_message string, "
    "model string, direction string, value bigint, cwd string, prompt_size_bytes bigint, signal string, identity string"
)

#: Metrics that count tokens; the fixed names of the telemetry format.
TOKEN_METRICS = ("gen_ai.client.token.usage", "agent.token.usage", "claude_code.token.usage")
#: Names of log events, once the prefix is off, by the event that they mean.
LOG_EVENTS = {"session_start": ("session.start",), "session_end": ("session.end",), "prompt": ("user.prompt", "user_prompt"), "tool_start": ("tool.decision_start", "tool_decision", "tool.decision"), "tool_result": ("tool.result", "tool_result")}
LONGEST_ID = 256


def records(exports: DataFrame, column: str = "value", signals: tuple[str, ...] = tuple(EXPORT)) -> DataFrame:
    """One row a log record, metric point or span of exports (a JSON text a row): signal, resource, attrs (key and typed value), name, kind, first_ns, last_ns, whole, real, code, message.

    A metric that doesn't count tokens, or has neither a sum nor a gauge, is one row without a point. A text that is no export gives a row of signal
    `unknown`; null and blank texts give none. All signals that are asked for are read in one pass; the parser steps over the others.
    """
    e = F.from_json(F.col(column), f"struct<{', '.join(EXPORT[s] for s in signals)}>")
    none = lambda kind: F.lit(None).cast(kind)

    def row(signal: str, resource: Column, attrs: Column, **more: Column) -> Column:
        kinds = {"name": "string", "kind": "string", "first_ns": "string", "last_ns": "string", "whole": "string", "real": "double", "code": "string", "message": "string"}
        return F.struct(F.lit(signal).alias("signal"), resource["resource"]["attributes"].alias("resource"), attrs.alias("attrs"), *[more.get(k, none(t)).cast(t).alias(k) for k, t in kinds.items()])

    def each(items: Column, body) -> Column:
        """The lists that body makes of the items, as one list; null items are empty lists."""
        return F.flatten(F.transform(F.coalesce(items, F.array()), lambda x: F.coalesce(body(x), F.array())))

    def of_metric(r: Column, m: Column) -> Column:
        counts = m["name"].isin(*TOKEN_METRICS)
        points = F.coalesce(m["sum"]["dataPoints"], m["gauge"]["dataPoints"], F.array())
        kind = F.when(m["sum"].isNotNull(), "sum").when(m["gauge"].isNotNull(), "gauge")
        each_point = F.transform(points, lambda p: row("metric", r, p["attributes"], name=m["name"], kind=kind, first_ns=p["timeUnixNano"], whole=p["asInt"], real=p["asDouble"]))
        return F.when(counts & kind.isNotNull(), each_point).otherwise(F.array(row("metric", r, none(ATTRS), name=m["name"])))

    logs = lambda: each(e["resourceLogs"], lambda r: each(r["scopeLogs"], lambda s: F.transform(s["logRecords"], lambda x: row("log", r, x["attributes"], first_ns=x["timeUnixNano"], last_ns=x["observedTimeUnixNano"]))))
    metrics = lambda: each(e["resourceMetrics"], lambda r: each(r["scopeMetrics"], lambda s: each(s["metrics"], lambda m: of_metric(r, m))))
    spans = lambda: each(e["resourceSpans"], lambda r: each(r["scopeSpans"], lambda s: F.transform(s["spans"], lambda x: row("trace", r, x["attributes"], name=x["name"], first_ns=x["startTimeUnixNano"], last_ns=x["endTimeUnixNano"], code=x["status"]["code"], message=x["status"]["message"]))))
    lists = {"log": logs, "metric": metrics, "trace": spans}
    broken = F.try_parse_json(F.col(column)).isNull() | ~F.ltrim(F.col(column)).startswith("{")
    nothing = F.struct(none(f"struct<{RESOURCE}>")["resource"].alias("resource"))
    made = F.when(broken, F.array(row("unknown", nothing, none(ATTRS), name=F.left(F.col(column), F.lit(60))))).otherwise(F.concat(*[lists[s]() for s in signals]))
    return exports.where(F.trim(F.col(column)) != "").select(F.inline(made))


def typed(rows: DataFrame) -> DataFrame:
    """Typed events (TYPED) of records.

    What can't be mapped stays as a row: event_type `unrecognised` with the name as identity, or `error` with the reason; neither has a
    session. A tool span is a start and a result, or two errors.
    """
    resource, attrs, signal = F.col("resource"), F.col("attrs"), F.col("signal")
    text = lambda *keys, of=attrs: S.text_value(S.first_attribute(of, *keys))
    name = F.coalesce(F.regexp_replace(text("event.name"), r"^claude_code\.", ""), F.lit(""))
    log_kind = F.lit(None).cast("string")
    for kind, names in LOG_EVENTS.items():
        log_kind = F.when(name.isin(*names), kind).otherwise(log_kind)
    marked = F.coalesce(text("session.event"), F.lit(""))
    tool_span = (F.coalesce(text("gen_ai.operation.name"), F.lit("")) == "tool.execute") | F.coalesce(F.col("name") == "tool.execute", F.lit(False))
    span_kind = F.when(marked.isin("session.start", "start"), "session_start").when(marked.isin("session.end", "end"), "session_end").when(tool_span, "tool_span")
    metric_kind = F.when(F.col("kind").isNotNull(), "token_usage")
    kind = F.when(signal == "log", log_kind).when(signal == "metric", metric_kind).when(signal == "trace", span_kind)
    identity = (
        F.when(signal == "log", F.concat(F.lit("log.event_name="), name))
        .when(signal == "metric", F.concat(F.lit("metric.name="), F.coalesce("name", F.lit("")), F.when(F.col("name").isin(*TOKEN_METRICS), ";unsupported_data_kind").otherwise("")))
        .when(signal == "trace", F.concat(F.lit("span.name="), F.coalesce("name", F.lit(""))))
        .otherwise(F.concat(F.lit("no export: "), F.coalesce("name", F.lit(""))))
    )
    ns = lambda c: F.coalesce(F.col(c).try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    base = rows.withColumns({"_kind": kind, "_identity": identity, "_session": S.session_of(resource, attrs), "_way": text("gen_ai.token.type", "direction"), "_first": ns("first_ns"), "_last": F.greatest(ns("first_ns"), ns("last_ns"))})
    whole, real, way = F.col("whole").try_cast("decimal(20,0)"), F.col("real"), F.col("_way")
    at = F.when((signal == "log") | F.col("_kind").isin("session_end", "tool_span"), F.col("_last")).otherwise(F.col("_first"))
    known = F.col("_kind").isNotNull()
    no_session = F.when(F.col("_session").isNull(), "missing session.id").when(F.octet_length("_session") > LONGEST_ID, "session.id is too long")
    no_time = F.when(at > F.lit(S.MAX_LONG), "time is out of range")
    no_way = F.when(way.isNull(), "missing gen_ai.token.type").when(S.direction(way).isNull(), F.concat(F.lit("unknown token direction: "), way))
    no_value = F.when(whole.isNull() & real.isNull(), "data point without a value").when(S.token_value(whole.try_cast("bigint"), real).isNull(), F.concat(F.lit("invalid token count: "), F.coalesce("whole", real.cast("string"))))
    problem = F.when(signal == "log", F.coalesce(no_time, F.when(known, no_session))).when(known & (signal == "metric"), F.coalesce(no_session, no_time, no_way, no_value)).when(known, F.coalesce(no_session, no_time))
    base = base.withColumn("_problem", problem)
    good = F.col("_problem").isNull() & known
    event = lambda k, when: F.struct(k.alias("kind"), when.alias("ns"))
    one = F.array(event(F.when(signal == "log", F.col("_kind")).otherwise(F.col("_kind")), at))
    two = F.array(event(F.lit("tool_start"), F.col("_first")), event(F.lit("tool_result"), F.col("_last")))
    out = base.withColumn("e", F.explode(F.when(F.col("_kind") == "tool_span", two).otherwise(one)))
    k = F.when(good, F.col("e.kind"))
    is_ = lambda *kinds: F.coalesce(k.isin(*kinds), F.lit(False))
    tool = is_("tool_start", "tool_result")
    failed = F.when(signal == "log", ~F.coalesce(S.flag_value(S.first_attribute(attrs, "success")), F.lit(True))).otherwise(F.coalesce(F.col("code").isin("2", "STATUS_CODE_ERROR"), F.lit(False)))
    message = F.when(signal == "log", text("error.message")).otherwise(F.nullif("message", F.lit("")))
    model = F.when(is_("session_start"), text("model")).when(is_("token_usage"), F.coalesce(S.text_value(F.coalesce(S.first_attribute(attrs, "gen_ai.response.model", "model"), S.first_attribute(resource, "gen_ai.response.model"))), F.lit("")))
    tool_name = F.coalesce(F.when(signal == "log", text("tool.name")).otherwise(text("tool.name", "gen_ai.tool.name")), F.lit(""))
    return out.select(
        F.when(good, F.col("_session")).alias("session_id"), F.when(F.col("_problem").isNotNull(), "error").otherwise(F.coalesce(k, F.lit("unrecognised"))).alias("event_type"), agent(resource).alias("agent"),
        F.when(F.col("e.ns") <= F.lit(S.MAX_LONG), F.timestamp_micros(F.floor(F.col("e.ns") / 1000).cast("bigint"))).alias("ts"),
        F.when(is_("prompt"), F.coalesce(text("turn.id", "turn_id"), F.lit(""))).when(tool, text("turn.id")).alias("turn_id"), F.when(tool, tool_name).alias("tool_name"), F.when(tool, F.lit("builtin")).alias("source"),
        F.when(is_("tool_start"), F.coalesce(S.flag_value(S.first_attribute(attrs, "user.approved")), F.lit(False))).alias("user_approved"), F.when(is_("tool_result"), F.when(failed, "failure").otherwise("success")).alias("status"),
        F.when(is_("tool_result") & failed, message).alias("error_message"), model.alias("model"), F.when(is_("token_usage"), S.direction(way)).alias("direction"), F.when(is_("token_usage"), S.token_value(whole.try_cast("bigint"), real)).alias("value"),
        F.when(is_("session_start"), text("cwd")).alias("cwd"), F.when(is_("prompt"), S.count_value(S.first_attribute(attrs, "prompt.size_bytes", "prompt_size_bytes"))).alias("prompt_size_bytes"), signal.alias("signal"),
        F.when(F.col("_problem").isNotNull(), F.col("_problem")).when(~known, F.col("_identity")).alias("identity"),
    )


def agent(resource: Column) -> Column:
    """Claude or codex by a resource's service.name or agent.kind, of which the first that says claude counts; else copilot."""
    service, kind = (F.coalesce(S.text_value(S.first_attribute(resource, k)), F.lit("")) for k in ("service.name", "agent.kind"))
    return F.when((service == "claude-code") | (kind == "claude"), "claude").when((service == "codex-cli") | (kind == "codex"), "codex").otherwise("copilot")


def typed_events(exports: DataFrame, column: str = "value", signals: tuple[str, ...] = tuple(EXPORT)) -> DataFrame:
    """Typed events of exports (a JSON text a row), of all signals or of some; texts that are no exports are told in any case."""
    return typed(records(exports, column, signals))
