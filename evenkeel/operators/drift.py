"""Distances between periods. The three standardised mean differences have three denominators, on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smd_pooled_sample(m1: Column, v1: Column, n1: Column, m2: Column, v2: Column, n2: Column) -> Column:
    """Cohen's d with the pooled sample deviation."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return F.when(pooled > 0, (m2 - m1) / pooled)


def smd_full_panel(part_mean: Column, full_mean: Column, full_sd: Column) -> Column:
    """Part against full, over the full panel's population deviation."""
    return F.when(full_sd > 0, (part_mean - full_mean) / full_sd)


def smd_pooled_population(m1: Column, v1: Column, m2: Column, v2: Column) -> Column:
    pooled = F.sqrt((v1 + v2) / 2)
    return F.when(pooled > 0, (m2 - m1) / pooled)


def boundary_exceeds(change: Column, past: Column, past_nulls: Column) -> Column:
    """Whether a change is larger than all past ones; null, not true, where a past one is unknown."""
    return F.when((past_nulls == 0) & past.isNotNull(), F.abs(change) > past)
