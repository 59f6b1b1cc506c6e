"""Exact percentiles without a list of all values: a histogram of distinct values with running counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rounded_index(rows: DataFrame, by: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """per group the value at index round(p / 100 * (n - 1)) of the sorted values, as columns names -> p. One row a distinct value and group is shuffled."""
    return _picked(rows, by, value, _rounded(names))


def ceiling_rank(rows: DataFrame, by: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """per group the value at index ceil(p * n / 100) - 1, at least 0."""
    return _picked(rows, by, value, {n: F.greatest(F.lit(0).cast("long"), F.ceil(F.lit(p) * F.col("_n") / 100) - 1) for n, p in names.items()})


def of_counts(counts: DataFrame, by: list[str], value: str, n: str, names: dict[str, float]) -> DataFrame:
    """rounded_index where `counts` says how often (n) each value occurs."""
    return _from_counts(counts.select(*by, value, F.col(n).alias("_c")), by, value, _rounded(names))


def _rounded(names: dict[str, float]) -> dict:
    return {n: F.round(F.lit(max(0.0, min(100.0, p)) / 100) * (F.col("_n") - 1)).cast("long") for n, p in names.items()}


def _picked(rows: DataFrame, by: list[str], value: str, index: dict) -> DataFrame:
    return _from_counts(rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c")), by, value, index)


def _from_counts(counts: DataFrame, by: list[str], value: str, index: dict) -> DataFrame:
    group = Window.partitionBy(*by)
    running = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_c").over(running)).withColumn("_n", F.sum("_c").over(group))
    return ranked.groupBy(*by).agg(*[F.min(F.when(F.col("_upto") > i, F.col(value))).alias(n) for n, i in index.items()])
