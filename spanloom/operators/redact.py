"""Redaction of reports, with stable pseudonyms and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_server, model_family, short_hash, source_kind, source_name

HIDDEN = "<redacted>"
#: Columns of sessions that are hidden at both levels, and those that only anonymizing hides; times that it sets to the epoch; columns of ids; columns of diagnostics, which are emptied.
PLACES, BUILDS, TIMES, IDS, DIAGNOSTICS = ("file_path", "cwd", "branch", "repository"), ("agent_version", "producer"), ("started_at", "ended_at", "at"), ("session_id", "turn_id"), ("warnings", "parse_warnings")


def pseudonyms(ids: DataFrame, per_bucket: int = 100_000) -> DataFrame:
    """Original, pseudonym (<uuid-N>) for ids (id, place), numbered from 0 by first place. Numbers come from per-bucket counts, so that no task sorts all ids."""
    first = ids.where("id is not null").groupBy("id").agg(F.min("place").alias("place"))
    bucketed = first.withColumn("b", F.floor(F.col("place") / per_bucket))
    counts = bucketed.groupBy("b").agg(F.count("*").alias("n"))
    starts = counts.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("b").orderBy("place", "id")) - 1
    numbered = bucketed.withColumn("r", within).join(starts, "b")
    return numbered.select(F.col("id").alias("original"), F.concat(F.lit("<uuid-"), (F.col("start") + F.col("r")).cast("string"), F.lit(">")).alias("pseudonym"))


def redact(rows: DataFrame, names: DataFrame, anonymize: bool = False) -> DataFrame:
    """H5, H6, H9: a table of sessions, turns or calls: ids get their pseudonyms (names: original, pseudonym), models become families, places are hidden and
    diagnostics emptied; anonymizing also hides builds, sets times to the epoch and hashes servers in tools' names. Counters and durations stay."""
    for c in [c for c in IDS if c in rows.columns]:
        known = names.select(F.col("original").alias("_id"), "pseudonym")
        rows = rows.join(known, F.col(c) == F.col("_id"), "left").withColumn(c, F.coalesce("pseudonym", c)).drop("_id", "pseudonym")
    kinds = dict(rows.dtypes)
    hide = lambda c: F.when(F.col(c).isNotNull(), HIDDEN)
    new: dict[str, Column] = {c: hide(c) for c in PLACES if c in kinds} | {c: F.lit(None).cast(kinds[c]) for c in DIAGNOSTICS if c in kinds}
    new |= {c: model_family(F.col(c)) for c in ("model",) if c in kinds}
    if anonymize:
        new |= {c: hide(c) for c in BUILDS if c in kinds} | {c: F.when(F.col(c).isNotNull(), F.timestamp_millis(F.lit(0)).cast(kinds[c])) for c in TIMES if c in kinds}
    return redact_tools(rows.withColumns(new) if new else rows, anonymize)


def redact_tools(rows: DataFrame, anonymize: bool = False) -> DataFrame:
    """H7, H8: tool names (name), loaded tools (an array) and servers hashed when anonymizing."""
    if not anonymize:
        return rows
    new = {"name": hash_server(F.col("name"))} if "name" in rows.columns else {}
    new |= {c: short_hash(F.col(c)) for c in ("server", "source_name") if c in rows.columns}
    return rows.withColumns(new | ({"loaded_tools": F.transform("loaded_tools", hash_server)} if "loaded_tools" in rows.columns else {}))


def redact_rollup(rows: DataFrame, anonymize: bool = False) -> DataFrame:
    """H7: a roll-up by model is merged by family at both levels; those by tool or server get hashed names when anonymizing; days stay."""
    return consolidate(rows) if "model" in rows.columns else redact_tools(rows, anonymize)


def consolidate(models: DataFrame) -> DataFrame:
    """Roll-ups by model merged where their families are equal."""
    sums = [c for c in models.columns if c != "model"]
    return models.groupBy(model_family(F.col("model")).alias("model")).agg(*[F.sum(c).alias(c) for c in sums])


def reverse_map(names: DataFrame, models: DataFrame, tools: DataFrame) -> DataFrame:
    """Kind (uuid, model, server), pseudonym, original: pseudonyms of ids; families with the model seen first (models: model, place); hashes of servers (tools: name)."""
    first = models.where("model is not null").groupBy(model_family(F.col("model")).alias("pseudonym")).agg(F.min_by("model", F.struct("place", "model")).alias("original"))
    server = tools.where(source_kind(F.col("name")) == "mcp").select(source_name(F.col("name")).alias("original")).distinct()
    row = lambda kind, df: df.select(F.lit(kind).alias("kind"), "pseudonym", "original")
    return row("uuid", names).unionByName(row("model", first)).unionByName(row("server", server.withColumn("pseudonym", short_hash(F.col("original")))))


def write_reverse_map(mapping: DataFrame, path: str, anonymize: bool) -> bool:
    """The map beside the output, if anonymizing and there is anything to map."""
    if not anonymize or mapping.isEmpty():
        return False
    mapping.write.mode("overwrite").json(path)
    return True
