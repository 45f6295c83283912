"""Grouped tables: rates with support, shares, pivots, distances between distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_table(rows: DataFrame, keys: list[str], target: str = "y", min_support: int = 1, **more: Column) -> DataFrame:
    """Rate and count by key, for groups of at least min_support rows."""
    made = rows.groupBy(*keys).agg(F.avg(target).alias("rate"), F.count("*").alias("n"), *[c.alias(k) for k, c in more.items()])
    return made.where(F.col("n") >= min_support)


def shares(rows: DataFrame, keys: list[str], category: str, out: str = "share") -> DataFrame:
    """Share of each category within its keys; categories that do not occur have no row."""
    counts = rows.groupBy(*keys, category).agg(F.count("*").alias("n"))
    return counts.withColumn(out, F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def mix(rows: DataFrame, keys: list[str], category: str, values: list[str]) -> DataFrame:
    """Row-normalised mix over a fixed list of categories, zero where one is absent."""
    pivoted = rows.groupBy(*keys).pivot(category, values).count().na.fill(0, values)
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return pivoted.select(*keys, *[F.try_divide(F.col(v), total).alias(v) for v in values])


def total_variation(a: DataFrame, b: DataFrame, category: str, keys: list[str] = ()) -> DataFrame:
    """Half the L1 distance of two share tables (category, share), within keys."""
    on = [*keys, category]
    left = a.select(*on, F.col("share").alias("pa"))
    right = b.select(*on, F.col("share").alias("pb"))
    both = left.join(right, on, "full")
    gap = F.abs(F.coalesce("pa", F.lit(0.0)) - F.coalesce("pb", F.lit(0.0)))
    return both.groupBy(*keys).agg((0.5 * F.sum(gap)).alias("tv"))


def unpivoted(rows: DataFrame, ids: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return rows.unpivot(ids, columns, name, value)
