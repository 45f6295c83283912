"""Strictly-past statistics and their backoff.

A row of season S may use history of seasons before S only. Sums, counts and variances come from
per-season partial sums, carried forward over a dense spine of cutoffs, so history is read once
whatever the number of cutoffs. Order statistics come from counts of distinct values, which carry one count for each cutoff.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import running_totals


def cutoffs(history: DataFrame, first: int, last: int) -> DataFrame:
    return history.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("cutoff"))


def past_sums(history: DataFrame, keys: list[str], sums: dict[str, Column], first: int, last: int) -> DataFrame:
    """keys, cutoff and each sum over the seasons before the cutoff; keys without any past have no row."""
    season = history.groupBy(*keys, "season").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    each = F.explode(F.sequence(F.greatest(F.col("season") + 1, F.lit(first)), F.lit(last))).alias("cutoff")
    # a season's partial sums go to every later cutoff: seasons are few, and rows are already summed
    return season.where(F.col("season") < last).select(*keys, *sums, each).groupBy(*keys, "cutoff").agg(*[F.sum(n).alias(n) for n in sums])


def past_quantiles(history: DataFrame, keys: list[str], value: str, points: list[float], first: int, last: int, out: str = "q", weight: str | None = None) -> DataFrame:
    """keys, cutoff, n and an array of linearly interpolated quantiles of the values of seasons before the cutoff.

    Each distinct value of the keys carries its count before every cutoff; running sums of these counts place it at all
    cutoffs at once. Nulls don't count; keys without any past have no row. ``weight`` names a column of row counts.
    """
    span = range(first, last + 1)
    one = F.col(weight) if weight else F.lit(1)
    counts = [F.sum(F.when(F.col("season") < s, one).otherwise(0)).alias(f"n{s}") for s in span]
    values = history.where(F.col(value).isNotNull() & (F.col("season") < last)).groupBy(*keys, value).agg(*counts)
    placed = running_totals(values, keys, [value], [f"n{s}" for s in span])
    bounds, picked = {}, []
    for s in span:
        for i, p in enumerate(points):
            at = F.lit(float(p)) * (F.col(f"total_n{s}") - 1)
            for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
                bounds[s, i, side] = f"_{side}{s}_{i}"
                # the first value with more rows up to it than the place
                picked.append(F.min(F.when(F.col(f"upto_n{s}") > place, F.col(value))).alias(bounds[s, i, side]))
    made = placed.groupBy(*keys, *[f"total_n{s}" for s in span]).agg(*picked)

    def quantile(s: int, i: int, p: float) -> Column:
        at = F.lit(float(p)) * (F.col(f"total_n{s}") - 1)
        low, high = F.col(bounds[s, i, "lo"]), F.col(bounds[s, i, "hi"])
        return low + (high - low) * (at - F.floor(at))

    each = F.array(*[F.struct(F.lit(s).alias("cutoff"), F.col(f"total_n{s}").alias("n"), F.array(*[quantile(s, i, p) for i, p in enumerate(points)]).alias(out)) for s in span])
    return made.select(*keys, F.explode(each).alias("_at")).where("_at.n > 0").select(*keys, "_at.*")


def backoff(rows: DataFrame, levels: list[tuple[str, DataFrame, list[str], str]], support: int, last_support: int | None = None) -> DataFrame:
    """rows with the value of the first level that has support; the last level may ask for another support.

    levels: (name, lookup, keys, value), each lookup with columns keys, n and value, of any one type. Adds level and value;
    NO_HISTORY and null where none has support.
    """
    names, values = F.lit("NO_HISTORY"), F.lit(None)
    out = rows
    for name, lookup, keys, value in reversed(levels):
        renamed = lookup.select(*[F.col(k).alias(f"_{name}_{k}") for k in keys], F.col("n").alias(f"_{name}_n"), F.col(value).alias(f"_{name}_v"))
        on = [F.col(k) == F.col(f"_{name}_{k}") for k in keys]
        # contexts are a fixed domain; a join on few keys would put all rows into as many tasks
        out = out.join(F.broadcast(renamed), on, "left").drop(*[f"_{name}_{k}" for k in keys])
        enough = F.col(f"_{name}_n") >= (support if last_support is None or name != levels[-1][0] else last_support)
        names = F.when(enough, F.lit(name)).otherwise(names)
        values = F.when(enough, F.col(f"_{name}_v")).otherwise(values)
    out = out.withColumn("level", names).withColumn("value", values)
    return out.drop(*[f"_{name}_{s}" for name, *_ in levels for s in ("n", "v")])


def prior_season(rows: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """The entity's value of the season before, joined to its rows; null where it has none."""
    made = rows.groupBy(*keys, "season").agg(value.alias(out)).withColumn("season", F.col("season") + 1)
    return rows.join(made, [*keys, "season"], "left")


def mean_of_past_seasons(rows: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """keys, season and the unweighted mean of the values of all seasons before, for seasons in which the entity occurs."""
    season = rows.groupBy(*keys, "season").agg(value.alias("_v"))
    before = Window.partitionBy(*keys).orderBy("season").rowsBetween(Window.unboundedPreceding, -1)
    return season.select(*keys, "season", F.avg("_v").over(before).alias(out), F.count("_v").over(before).alias("past_seasons"))
