"""Scalar expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tools that wait for the user.
USER_BLOCKING = ("ask_user",)
HEURISTIC_TOKENS = 200
NOTICE = r"(?s)<tools_changed_notice>(.*?)</tools_changed_notice>"
MAX_LONG = (1 << 63) - 1


def source_kind(name: Column) -> Column:
    """C4: mcp, skill or builtin, from a tool's full name; the first __ after the prefix splits."""
    return F.when(name.rlike(r"(?s)^mcp__.*?__"), "mcp").when(name.rlike(r"(?s)^skill__.*?__"), "skill").otherwise("builtin")


def source_name(name: Column) -> Column:
    """C4: the server or skill of a tool; null for builtin ones."""
    kind = source_kind(name)
    return F.when(kind == "mcp", F.regexp_extract(name, r"(?s)^mcp__(.*?)__", 1)).when(kind == "skill", F.regexp_extract(name, r"(?s)^skill__(.*?)__", 1))


def split_full_name(name: Column) -> Column:
    """struct(server, tool) of mcp__server__tool; null unless both are non-empty."""
    server, tool = (F.regexp_extract(name, r"(?s)^mcp__(.*?)__(.*)$", i) for i in (1, 2))
    return F.when((server != "") & (tool != ""), F.struct(server.alias("server"), tool.alias("tool")))


def short_name(name: Column) -> Column:
    """The tool part of a full name, or the name itself."""
    tool = F.regexp_extract(name, r"(?s)^mcp__(.*?)__(.*)$", 2)
    return F.when(tool != "", tool).otherwise(name)


def display_name(name: Column) -> Column:
    """Mcp:server::tool, skill:name:tool, or the name."""
    rest = F.regexp_extract(name, r"(?s)^(?:mcp|skill)__.*?__(.*)$", 1)
    kind, source = source_kind(name), source_name(name)
    return F.when(kind == "mcp", F.concat(F.lit("mcp:"), source, F.lit("::"), rest)).when(kind == "skill", F.concat(F.lit("skill:"), source, F.lit(":"), rest)).otherwise(name)


def mode_of(text: Column) -> Column:
    """Interactive, plan, autopilot, or unknown:text."""
    return F.when(text.isin("interactive", "plan", "autopilot"), text).when(text.isNotNull(), F.concat(F.lit("unknown:"), text))


def millis(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, an end before its start counting as the start."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000)).cast("long")


def saturating_sum(value: Column) -> Column:
    """A sum of counters that stops at the largest long; null if there are none."""
    total, most = F.sum(value.cast("decimal(20,0)")), F.lit(MAX_LONG).cast("decimal(20,0)")
    return F.when(total > most, most).otherwise(total).cast("long")


def cache_metrics(inp: Column, read: Column, write: Column) -> Column:
    """struct(naive, honest, gross, net); null if nothing was read or written."""
    ratio = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(0.0)
    made = F.struct(ratio(read, inp).alias("naive"), ratio(read, write).alias("honest"), F.round(0.9 * read).cast("long").alias("gross"), F.round(0.9 * read - 0.25 * write).cast("long").alias("net"))
    return F.when((read != 0) | (write != 0), made)


def short_hash(text: Column) -> Column:
    """H2: the first 8 hex digits of SHA-256."""
    return F.left(F.sha2(text, 256), F.lit(8))


def model_family(model: Column) -> Column:
    """H3: the first two parts of a model's name."""
    return F.substring_index(model, "-", 2)


def hash_server(name: Column) -> Column:
    """H4: an MCP tool's name with its server hashed."""
    rest = F.regexp_extract(name, r"(?s)^mcp__.*?__(.*)$", 1)
    return F.when(source_kind(name) == "mcp", F.concat(F.lit("mcp__"), short_hash(source_name(name)), F.lit("__"), rest)).otherwise(name)


def tokenizer_class(model: Column) -> Column:
    """o200k for the newer model families, else cl100k."""
    return F.when(model.rlike("^(gpt-5|gpt-4o|o1|o3)"), "o200k").otherwise("cl100k")


def announced_tools(text: Column) -> Column:
    """H1: full MCP names that a message's notices announce, distinct and sorted."""
    lines = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(NOTICE), 1), lambda b: F.regexp_extract_all(b, F.lit(r"New tools available:([^\n]*)"), 1)))
    names = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x.rlike(r"^mcp__[A-Za-z0-9_-]*$"))))


def severity(calls: Column, failures: Column) -> Column:
    """C11: high over half failed, medium for any failure in three calls or more, else low."""
    return F.when((calls > 0) & (failures / calls > 0.5), "high").when((failures > 0) & (calls >= 3), "medium").otherwise("low")


def shorten(text: Column, most: int = 60) -> Column:
    """The string values inside a JSON text cut to `most` characters and three dots; keys stay. A match begins where the last one ended and takes whole short strings and keys first, so it never begins between two strings."""
    one = r'(?:[^"\\]|\\.)'
    before = rf'\G((?:[^"]++|"{one}*+"(?=\s*:)|"{one}{{0,{most}}}+")*+)'
    return F.regexp_replace(text, rf'{before}"({one}{{{most}}}){one}++"', '$1"$2..."')


def home_leaks(text: Column, allowed: tuple[str, ...] = ("user", "runner", "example")) -> Column:
    """User names after /home/, /Users/ or C:\\Users\\ that are not allowed."""
    found = F.regexp_extract_all(text, F.lit(r"(?:/home/|/Users/|[A-Za-z]:\\Users\\)([A-Za-z0-9._-]+)"), 1)
    return F.filter(found, lambda x: ~x.isin(*allowed))


def first_attribute(attrs: Column, *keys: str) -> Column:
    """The typed value (a struct of stringValue, intValue, doubleValue, boolValue) of the first entry with a key in an array of struct(key, value); of several keys the first that has a value."""

    def first(key: str) -> Column:
        return F.get(F.filter(attrs, lambda a: a["key"] == key), F.lit(0))["value"]

    return F.coalesce(*map(first, keys))


def text_value(value: Column) -> Column:
    """A typed value's text; null for other types."""
    return value["stringValue"]


def flag_value(value: Column) -> Column:
    """A typed value's truth value; null for other types, texts too."""
    return value["boolValue"]


def count_value(value: Column) -> Column:
    """A typed value as a count: an integer, or a rounded double; null if negative, not finite or of another type."""
    return token_value(value["intValue"].try_cast("bigint"), value["doubleValue"])


def session_of(resource: Column, record: Column) -> Column:
    """Session.id of the resource, its claude.session_id, or session.id of the record; texts only, and empty ones are skipped."""
    found = F.array(*[text_value(first_attribute(of, key)) for of, key in ((resource, "session.id"), (resource, "claude.session_id"), (record, "session.id"))])
    return F.get(F.filter(found, lambda x: x != ""), F.lit(0))


def direction(text: Column) -> Column:
    """One of four token directions; null for unknown ones."""
    return F.when(text.isin("input", "prompt"), "input").when(text.isin("output", "completion"), "output").when(text.isin("cache_read", "cache.read"), "cache_read").when(text.isin("cache_create", "cache_creation", "cache.create"), "cache_creation")


def token_value(whole: Column, real: Column) -> Column:
    """A count from an integer or a rounded double; null if negative, not finite or missing."""
    ok = real.isNotNull() & ~F.isnan(real) & (F.abs(real) != float("inf"))
    value = F.coalesce(whole, F.when(ok, F.round(real).cast("long")))
    return F.when(value >= 0, value)
