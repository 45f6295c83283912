"""Positions within groups of any size.

A window over a group puts the group into one task. Here rows are dealt by ranges of (keys, order), numbered
inside each range, and shifted by the running counts of the ranges, a table with a row for each range and key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import staged


def ordinal_positions(rows: DataFrame, keys: list[str], order: list[Column], out: str = "position", total: str = "total") -> DataFrame:
    """rows with their place from 0 within their keys, and the number of rows of the keys. Rows equal in all of
    ``order`` are numbered in any order."""
    by = [*[F.col(k) for k in keys], *order]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    # the id numbers the rows of each sorted range from 0; staged, as a second evaluation could range anew
    ranged = staged(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), "positions")
    ranged = ranged.withColumn("_part", F.shiftright("_id", 33))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy(*keys, "_part")
        .agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
        .select(
            *[F.col(k).alias(f"_s_{k}") for k in keys],
            F.col("_part").alias("_s_part"),
            (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
            F.sum("_n").over(group).alias(total),
        )
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], F.col("_part") == F.col("_s_part"))
    return ranged.join(starts, on).withColumn(out, F.col("_id") + F.col("_shift")).select(*rows.columns, out, total)


def running_before(rows: DataFrame, order: list[Column], amount: str, out: str) -> DataFrame:
    """rows with the sum of ``amount`` over all rows before them in ``order``, in which rows must differ; 0 for the first.

    Only the sums of the ranges, a row each, go through a window without a partition.
    """
    # staged, as a second evaluation could range anew
    ranged = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    below = Window.orderBy("_s_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(F.col("_part").alias("_s_part")).agg(F.sum(amount).alias("_sum"))
    starts = sums.select("_s_part", F.coalesce(F.sum("_sum").over(below), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("_within", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return within.join(starts, F.col("_part") == F.col("_s_part")).withColumn(out, F.col("_start") + F.col("_within")).select(*rows.columns, out)


def running_totals(rows: DataFrame, keys: list[str], order: list[str], amounts: list[str]) -> DataFrame:
    """rows with upto_<a>, the sum of each amount up to and with the row in ``order``, in which rows of the same keys must
    differ, and total_<a>, its sum over the keys. Null keys are a group of their own."""
    # staged, as a second evaluation could range anew
    ranged = staged(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "totals")
    group = Window.partitionBy(*keys)
    below = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_part").agg(*[F.sum(a).alias(a) for a in amounts])
    starts = sums.select(
        *[F.col(k).alias(f"_s_{k}") for k in keys],
        F.col("_part").alias("_s_part"),
        *[F.coalesce(F.sum(a).over(below), F.lit(0)).alias(f"_start_{a}") for a in amounts],
        *[F.sum(a).over(group).alias(f"total_{a}") for a in amounts],
    )
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = ranged.select("*", *[F.sum(a).over(inside).alias(f"_within_{a}") for a in amounts])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], F.col("_part") == F.col("_s_part"))
    upto = [(F.col(f"_start_{a}") + F.col(f"_within_{a}")).alias(f"upto_{a}") for a in amounts]
    return within.join(starts, on).select(*rows.columns, *upto, *[f"total_{a}" for a in amounts])


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, points: list[float], out: str = "q") -> DataFrame:
    """keys and an array of linearly interpolated quantiles of the values that aren't null.

    percentile() holds a map of all distinct values in one task; here distinct values are counted first, so that frequent ones are one row each, and
    their counts run by ranges.
    """
    return counted_quantiles(counted(rows.select(*keys, value), keys, value), keys, value, points, out)


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n (rows of that value), upto_n (of values up to it) and total_n, of the values that aren't null. Written once; quantiles, extremes and counts come from it."""
    values = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return staged(running_totals(values, keys, [value], ["n"]), "counted")


def counted_quantiles(counts: DataFrame, keys: list[str], value: str, points: list[float], out: str = "q") -> DataFrame:
    """keys and an array of linearly interpolated quantiles, from ``counted``."""
    at = [F.lit(float(p)) * (F.col("total_n") - 1) for p in points]
    picked = lambda place: F.min(F.when(F.col("upto_n") > place, F.col(value)))
    made = counts.groupBy(*keys, "total_n").agg(*[picked(f(a)).alias(f"_{n}{i}") for i, a in enumerate(at) for n, f in (("lo", F.floor), ("hi", F.ceil))])
    between = [F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (a - F.floor(a)) for i, a in enumerate(at)]
    return made.select(*keys, F.array(*between).alias(out))


def average_ranks(rows: DataFrame, column: str, out: str, within: list[str]) -> DataFrame:
    """Ranks from 1 with ties averaged, from the counts of distinct values; null values have no rank. Groups of any number of values are ranked by ranges."""
    values = rows.where(F.col(column).isNotNull()).groupBy(*within, column).agg(F.count("*").alias("_n"))
    placed = running_totals(values, within, [column], ["_n"])
    ranks = placed.select(*[F.col(c).alias(f"_r_{c}") for c in (*within, column)], (F.col("upto__n") - (F.col("_n") - 1) / 2).alias(out))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in (*within, column)])
    return rows.join(ranks, on, "left").drop(*[f"_r_{c}" for c in (*within, column)])
