"""Ordered sequences: runs, walks and their matches. Every operator is partitioned by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_ids(rows: DataFrame, entity: str, order: list[str], key: Column, out: str = "run") -> DataFrame:
    """Numbers runs of equal keys within each entity, from 1."""
    w = Window.partitionBy(entity).orderBy(*order)
    starts = F.when(key.eqNullSafe(F.lag(key).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return rows.withColumn("_start", starts).withColumn(out, F.sum("_start").over(w)).drop("_start")


def walks(rows: DataFrame, entity: list[str], order: list[str], code: str) -> DataFrame:
    """entity, walk (codes in order) and its length: one row an entity, whose rows are its sequence."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, code)))
    return rows.groupBy(*entity).agg(ordered.alias("_w")).select(*entity, F.transform("_w", lambda x: x[code]).alias("walk"), F.size("_w").alias("steps"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two arrays."""
    short = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, F.lit(1), short), F.slice(b, F.lit(1), short), lambda x, y: x == y)
    first = F.array_position(same, False)
    return F.when(short == 0, 0).when(first == 0, short).otherwise(first - 1).cast("int")


def prefix_rows(rows: DataFrame, entity: list[str], order: list[str], code: str) -> DataFrame:
    """rows with place, their number within the entity from 1, steps, the entity's number of rows, and the digest of the
    codes up to each row: two 64-bit digests of (code, place), combined by exclusive or."""
    w = Window.partitionBy(*entity).orderBy(*order)
    placed = rows.withColumn("place", F.row_number().over(w))
    digest = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), code, "place")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.select("*", F.count("*").over(Window.partitionBy(*entity)).alias("steps"), digest(1).alias("digest"), digest(2).alias("digest2"))


def longest_prefix(left: DataFrame, right: DataFrame, entity: list[str], group: list[str]) -> DataFrame:
    """entity, group, steps, lcp (codes that its walk shares at its start with some right walk of its group) and exact (right walks that are equal).

    left and right come from prefix_rows, with the group's columns constant in an entity. Every row stands for the prefix that ends
    there, so prefixes meet in one equi-join on group, length and digest; the right's are told apart first, and no pair of walks is formed.
    """
    by = [*group, "place", "digest", "digest2"]
    known = right.groupBy(*by).agg(F.count_if(F.col("place") == F.col("steps")).alias("_ends"))
    met = left.select(*entity, *by, "steps").join(known, by, "left")
    shared = F.max(F.when(F.col("_ends").isNotNull(), F.col("place")).otherwise(0))
    exact = F.max(F.when(F.col("place") == F.col("steps"), F.coalesce("_ends", F.lit(0))))
    return met.groupBy(*entity, *group, "steps").agg(shared.alias("lcp"), exact.alias("exact"))


def majority(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """left, right, n and confidence of each left's most frequent right; ties go to the smaller right."""
    n = pairs.groupBy(left, right).agg(F.count("*").alias("n"))
    best = n.groupBy(left).agg(F.max(F.struct("n", (-F.col(right)).alias("r"))).alias("b"), F.sum("n").alias("t"))
    return best.select(left, (-F.col("b.r")).alias(right), F.col("b.n").alias("n"), (F.col("b.n") / F.col("t")).alias("confidence"))


def mutual_best(pairs: DataFrame, left: str, right: str, distance: str, tie: float = 1e-12) -> DataFrame:
    """Pairs that are each other's nearest, with the margin to the second; ambiguous where the margin is a tie."""
    by_left, by_right = Window.partitionBy(left).orderBy(distance, right), Window.partitionBy(right).orderBy(distance, left)
    ranked = pairs.select(
        "*",
        F.row_number().over(by_left).alias("_l"),
        F.row_number().over(by_right).alias("_r"),
        (F.lead(distance).over(by_left) - F.col(distance)).alias("margin"),
    )
    status = F.when(F.col("margin") <= tie, "ambiguous").otherwise("accepted")
    return ranked.where((F.col("_l") == 1) & (F.col("_r") == 1)).withColumn("status", status).drop("_l", "_r")
