"""Temporal folds as a table: one row a fold, with the seasons it trains and validates on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fold_table(spark: SparkSession, folds: list[tuple[str, int, str | None]]) -> DataFrame:
    """folds: (name, validation season, game type or None for all)."""
    rows = F.array(*[F.struct(F.lit(n).alias("fold"), F.lit(s).alias("valid_season"), F.lit(g).cast("string").alias("only")) for n, s, g in folds])
    return spark.range(1).select(F.inline(rows))


def in_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once for every fold that it is in, with its role: train for earlier seasons, valid for the fold's own."""
    fits = (F.col("season") <= F.col("valid_season")) & (F.col("only").isNull() | (F.col("game_type") == F.col("only")))
    role = F.when(F.col("season") < F.col("valid_season"), "train").otherwise("valid")
    return rows.join(F.broadcast(folds), fits).withColumn("role", role)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n: rows of a whose key is in b. A fold pair is sound where it is zero."""
    return a.join(b.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n"))
