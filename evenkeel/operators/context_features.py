"""Scores of a context against the strict past: means, spreads and medians by measure and family, backed off from
the whole context to its coarser levels where too few rows support them.

Moments come from partial sums by context and season, order statistics from counts of distinct values that carry one
count for each cutoff (``history.past_quantiles``), so a history row is read once and never multiplied by cutoffs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .history import past_quantiles

ALL = "ALL"
NO_HISTORY = "NO_HISTORY"


@dataclass(frozen=True)
class Feature:
    """kind: mean, sd, z (mean against the global one), apart (difference of two families), median_shift or iqr_ratio."""

    name: str
    kind: str
    measure: str
    family: str = ALL
    other: str | None = None

    @property
    def sets(self) -> list[tuple[str, str]]:
        return [(self.measure, f) for f in (self.family, self.other) if f is not None]


def past_statistics(history: DataFrame, features: list[Feature], levels: dict[str, list[str]], families: list[str], first: int, last: int) -> DataFrame:
    """measure, family (or ALL), level, the context's columns (null where coarser), cutoff, n, mean, var, med and iqr.

    ``levels`` gives each level's columns, finest first; history has season, family, the finest level's columns and the measures. Non-finite values don't count. med
    and iqr are there for measures that a feature asks them of.
    """
    context = next(iter(levels.values()))
    measures = list(dict.fromkeys(f.measure for f in features))
    wanted = list(dict.fromkeys(s for f in features for s in f.sets))
    ordered = list(dict.fromkeys(s for f in features if f.kind in ("median_shift", "iqr_ratio") for s in f.sets))
    value = F.col("value")
    rows = (
        history.where(F.col("family").isin(families))
        .select("season", "family", *context, *[F.col(m).cast("double").alias(m) for m in measures])
        .unpivot(["season", "family", *context], measures, "measure", "value")
        .where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    )

    def by_level(frame: DataFrame, sets: list[tuple[str, str]]) -> DataFrame:
        """Each row once for every set and level that it belongs to."""
        named = reduce(lambda a, b: a | b, [(F.col("measure") == m) & (F.col("family") == f) for m, f in sets])
        each = F.explode(F.array(*[F.struct(F.lit(level).alias("level"), *[(F.col(c) if c in keys else F.lit(None).cast("int")).alias(c) for c in context]) for level, keys in levels.items()])).alias("at")
        spread = frame.withColumn("family", F.explode(F.array(F.col("family"), F.lit(ALL)))).where(named)
        return spread.select(*[c for c in frame.columns if c not in context], each).select("*", "at.*").drop("at")

    keys = ["measure", "family", "level", *context]
    season = rows.groupBy("measure", "family", *context, "season").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    later = F.explode(F.sequence(F.greatest(F.col("season") + 1, F.lit(first)), F.lit(last))).alias("cutoff")
    # contexts, families and seasons are fixed sets, so what follows is small whatever the history
    parts = by_level(season.where(F.col("season") < last), wanted).select(*keys, "n", "mean", "var", later)
    group = Window.partitionBy(*keys, "cutoff")
    centre = F.sum(F.col("n") * F.col("mean")).over(group) / F.sum("n").over(group)
    off = F.col("mean") - F.col("centre")
    moments = (
        parts.withColumn("centre", centre)
        .groupBy(*keys, "cutoff", "centre")
        .agg(F.sum("n").alias("n"), (F.sum(F.col("n") * (F.col("var") + off * off)) / F.sum("n")).alias("var"))
        .withColumnRenamed("centre", "mean")
    )
    if not ordered:
        return moments.select(*keys, "cutoff", "n", "mean", "var", F.lit(None).cast("double").alias("med"), F.lit(None).cast("double").alias("iqr"))
    asked = rows.where(F.col("measure").isin([m for m, _ in ordered]))
    counted = asked.groupBy("measure", "family", *context, "season", "value").count()
    quantiles = past_quantiles(by_level(counted, ordered), keys, "value", [0.25, 0.5, 0.75], first, last, weight="count").select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("cutoff").alias("_cutoff"), F.col("q")[1].alias("med"), (F.col("q")[2] - F.col("q")[0]).alias("iqr")
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "cutoff"]])
    return moments.join(quantiles, on, "left").select(*keys, "cutoff", "n", "mean", "var", "med", "iqr")


def context_features(states: DataFrame, statistics: DataFrame, features: list[Feature], levels: dict[str, list[str]], support: int) -> DataFrame:
    """states (cutoff and the finest level's columns) with each feature and <feature>_level, the level it was taken from.

    A feature of one set takes the finest level with ``support`` rows of that set; a feature of two families takes the finest level at
    which both have support. Denominators are always the global ones, for two families the root of the mean of their variances, and need support too. Without any
    level the feature is null and its level NO_HISTORY.
    """
    sets = list(dict.fromkeys(s for f in features for s in f.sets))
    coarsest = list(levels)[-1]
    stats = ("n", "mean", "var", "med", "iqr")
    out = states
    for level, keys in levels.items():
        wide = [F.expr(f"max(CASE WHEN measure = '{m}' AND family = '{f}' THEN {stat} END) AS {level}_{i}_{stat}") for i, (m, f) in enumerate(sets) for stat in stats]
        out = out.join(statistics.where(F.col("level") == level).groupBy("cutoff", *keys).agg(*wide), ["cutoff", *keys], "left")

    # the features are written as SQL: one expression each, where columns would be put together by thousands of calls
    at = lambda level, of, stat: f"{level}_{sets.index(of)}_{stat}"
    supported = lambda level, of: " AND ".join(f"coalesce({at(level, s, 'n')} >= {support}, false)" for s in of)
    world = lambda of, stat: f"CASE WHEN {supported(coarsest, [of])} THEN {at(coarsest, of, stat)} END"
    ratio = lambda a, b: f"CASE WHEN NOT isnan({b}) THEN try_divide({a}, {b}) END"
    made = []
    for f in features:
        own = f.sets[0]
        pick = lambda value: "CASE " + " ".join(f"WHEN {supported(level, f.sets)} THEN {value(level)}" for level in levels) + " END"  # noqa: B023, E731
        of = lambda stat: pick(lambda level: at(level, own, stat))  # noqa: B023, E731
        if f.kind == "mean":
            value = of("mean")
        elif f.kind == "sd":
            value = f"sqrt({of('var')})"
        elif f.kind == "z":
            value = ratio(f"({of('mean')} - {world(own, 'mean')})", f"sqrt({world(own, 'var')})")
        elif f.kind == "apart":
            one, two = f.sets
            gap = pick(lambda level: f"{at(level, one, 'mean')} - {at(level, two, 'mean')}")  # noqa: B023
            value = ratio(f"({gap})", f"sqrt(({world(one, 'var')} + {world(two, 'var')}) / 2)")
        elif f.kind == "median_shift":
            value = ratio(f"({of('med')} - {world(own, 'med')})", f"({world(own, 'iqr')})")
        elif f.kind == "iqr_ratio":
            value = ratio(f"({of('iqr')})", f"({world(own, 'iqr')})") + " - 1"
        else:
            raise ValueError(f.kind)
        known = "CASE " + " ".join(f"WHEN {supported(level, f.sets)} THEN '{level}'" for level in levels) + f" ELSE '{NO_HISTORY}' END"
        made += [F.expr(f"{value} AS {f.name}"), F.expr(f"{known} AS {f.name}_level")]
    return out.select(*states.columns, *made)
