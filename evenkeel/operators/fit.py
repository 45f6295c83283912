"""Fit on one frame, apply to another: constants and group values as broadcast joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_constants(rows: DataFrame, fitted_on: DataFrame, **aggregates: Column) -> DataFrame:
    """rows with the aggregates of another frame beside each; that side is one row."""
    return rows.crossJoin(F.broadcast(fitted_on.agg(*[a.alias(n) for n, a in aggregates.items()])))


def with_group_value(rows: DataFrame, fitted_on: DataFrame, keys: list[str], how: str = "left", few: bool = False, **aggregates: Column) -> DataFrame:
    """rows with the aggregates of their group in another frame; null where the group is unseen.

    Which side is broadcast is left to Catalyst, since groups may be many. ``few`` says that keys are a fixed, small domain (seasons, bins, contexts): their
    table is broadcast, as a join on so few keys would put all rows into as many tasks.
    """
    names = {k: f"_fit_{k}" for k in keys}
    groups = fitted_on.groupBy(*[F.col(k).alias(v) for k, v in names.items()]).agg(*[a.alias(n) for n, a in aggregates.items()])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(v)) for k, v in names.items()])
    groups = F.broadcast(groups) if few else groups
    return rows.join(groups, on, how).drop(*names.values())
