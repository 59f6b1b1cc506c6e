"""Mixing sources to target weights: whole repetitions plus one seeded Bernoulli copy of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Seeded draws that a source may pick from: four of 32 bits from each of DIGESTS digests of the id.
DIGESTS = 8


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> also position, target. One row a source.

    The targets sum to share * all sizes. They go by weight, but stop at most * source_size, the excess being shared
    out again by weight: so a source gets level * weight or its cap, for one level. Sources fill in the order of
    cap / weight, and the level follows from what is left when the last of them has filled.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*map(F.lit, weights))
    one = sizes.withColumn("position", F.row_number().over(by_name) - 1)
    one = one.withColumn("weight", F.element_at(cycle, (F.col("position") % len(weights) + 1).cast("int")).cast("double"))
    one = one.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    whole = Window.partitionBy()
    one = one.withColumn("before", F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    one = one.withColumn("rest", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    one = one.withColumn("left", F.sum("source_size").over(whole) * F.lit(float(share)) - F.col("before"))
    one = one.withColumn("filled", F.col("left") * F.col("weight") >= F.col("cap") * F.col("rest"))
    # those that fill come first; the level is that of the first which doesn't
    level = F.first(F.when(~F.col("filled"), F.struct("left", "rest")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.when(F.col("filled"), F.col("cap")).otherwise(level["left"] * F.col("weight") / level["rest"])
    return one.withColumn("target", target).select("source", "source_size", "position", "target")


def draws(doc_id: Column, seed: int) -> Column:
    """4 * DIGESTS numbers from 0 up to 2 ** 32 for a document, the same in every run."""
    digests = [F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(i)), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")) for i in range(DIGESTS)]
    return F.array(*(F.conv(F.substring(d, 1 + 8 * j, 8), 16, 10).cast("long") for d in digests for j in range(4)))


def mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs (doc_id, source): doc_id, size, source_size, target, copies, taken, and the columns named in keep.

    A document is taken floor(rate) times and once more if its draw falls below the rate's fraction; rate is
    target / source_size. Each source uses that one of its 4 * DIGESTS seeded draws by which its sum comes nearest to
    its target (ties: the first). Null source: a source of its own, last in order. Null doc_id: draws as the text "null".
    Empty documents and sources without words take nothing. Repeated rows draw alike. An empty table gives an empty result.
    """
    n = 4 * DIGESTS
    rows = materialize(docs.select("doc_id", "source", size.alias("size")), "sizes")
    sizes = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sizes = sizes.withColumn("whole", F.floor(rate)).withColumn("below", F.floor((rate - F.floor(rate)) * F.lit(2.0**32)))

    def with_draws(rows: DataFrame) -> DataFrame:
        return rows.join(sizes, rows["source"].eqNullSafe(sizes["source"])).select(rows["*"], "source_size", "target", "position", "whole", "below", draws(F.col("doc_id"), seed).alias("draws"))

    drawn = with_draws(rows)
    extra = [F.sum(F.when(F.col("draws")[i] < F.col("below"), F.col("size")).otherwise(0)) for i in range(n)]
    sums = drawn.groupBy("position").agg(F.first("target").alias("target"), F.first("whole").alias("whole"), F.first("source_size").alias("source_size"), F.array(*extra).alias("extra"))
    off = F.transform("extra", lambda x: F.abs(F.col("whole") * F.col("source_size") + x - F.col("target")))
    pick = sums.select("position", (F.array_position(off, F.array_min(off)) - 1).cast("int").alias("pick"))
    picked = materialize(pick, "picks").select(F.col("position").alias("p"), "pick")
    # sizes are written once; texts are read again only to be carried
    out = (with_draws(docs.select("doc_id", "source", size.alias("size"), *keep)) if keep else drawn).join(picked, F.col("position") == F.col("p"))
    copies = (F.col("whole") + F.when(F.get("draws", F.col("pick")) < F.col("below"), 1).otherwise(0)).cast("int")
    return out.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)
