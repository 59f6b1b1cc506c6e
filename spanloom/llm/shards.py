"""Proportional stratified interleaving: shards that each hold the whole mixture's shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows that one window sorts, about.
PER_BUCKET = 100_000


def ranked(rows: DataFrame, by: list[str], bucket: str, order: list[str], rank: str) -> DataFrame:
    """Adds a rank from 0 over (order) within `by`. Rows are sorted inside buckets, which follow the order; the counts of the buckets before are added. So no group is sorted in one task, however large."""
    counts = rows.groupBy(*by, bucket).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    starts = materialize(counts.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(bucket).alias("_bucket"), F.coalesce(before, F.lit(0)).alias("_start")), "starts")
    on = F.col(bucket) == F.col("_bucket")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    within = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)) - 1
    return rows.withColumn(rank, within).join(starts, on).withColumn(rank, F.col(rank) + F.col("_start")).drop("_bucket", "_start", *[f"_{c}" for c in by])


def interleave(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, size, text_crc32, shard, slot.

    Rows are shuffled within their source by a seeded hash of doc_id and text, so rows without an id, or with one that is
    repeated, spread as others do, and only equal rows are exchangeable. The method knows no groups: equal texts may lie in different shards. The row of rank r among n has the fractional rank (2r + 1) / 2n; all
    rows are sorted by it (ties: source, null last, then rank) and cut into `shards` runs of which the lengths differ by one at most.
    slot counts from 0 within a shard. size is the UTF-8 bytes of the text plus 1; a null text has none and the
    checksum of an empty one. Null sources are one source. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text)).cast("binary"))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), shuffled.alias("_h"), F.md5(text).alias("_t"))
    totals = materialize(rows.groupBy("source").agg(F.count("*").alias("_total")), "sources")
    n = totals.agg(F.sum("_total")).first()[0] or 0
    buckets = 1 << max(6, (n // PER_BUCKET).bit_length())
    first = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("_b", F.floor(first * buckets / F.lit(2.0**32)))
    rows = ranked(rows, ["source"], "_b", ["_h", "_t", "size", "doc_id"], "_rank")
    rows = rows.join(totals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    fraction = (2 * F.col("_rank") + 1) / (2 * F.col("_total"))
    rows = rows.withColumn("_f", fraction).withColumn("_g", F.floor(F.col("_f") * buckets)).withColumn("_none", F.col("source").isNull())
    rows = ranked(rows, [], "_g", ["_f", "_none", "source", "_rank"], "_at")
    shard = F.floor(F.col("_at") * shards / F.lit(max(n, 1)))
    start = F.ceil(shard * n / F.lit(shards))
    return rows.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), (F.col("_at") - start).alias("slot"))
