"""Vocabulary codes and standard scores, fitted on a training frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip
from .ranking import ordinal_positions


def vocabulary_codes(rows: DataFrame, train: DataFrame, column: str, out: str) -> DataFrame:
    """1..K by sorted training value; unseen and null values get 0. Values are numbered by ranges, however many there are."""
    values = train.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"), F.lit(0).alias("_all")).distinct()
    codes = ordinal_positions(values, ["_all"], [F.col("_v")], "_at", "_of").select("_v", (F.col("_at") + 1).cast("int").alias(out))
    return rows.join(codes, F.col(column) == F.col("_v"), "left").drop("_v").withColumn(out, F.coalesce(out, F.lit(0)))


def fit_scaler(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean and population deviation of each column; a deviation of zero counts as one."""
    sd = lambda c: F.stddev_pop(c)
    return train.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in columns],
        *[F.when(sd(c) > 0, sd(c)).otherwise(1.0).alias(f"{c}_sd") for c in columns],
    )


def scaled(rows: DataFrame, state: DataFrame, columns: list[str], limit: float = 5.0) -> DataFrame:
    """Adds <column>_z: nulls take the mean, scores are clipped to +-limit."""
    rows = rows.crossJoin(F.broadcast(state))
    for c in columns:
        z = (F.coalesce(F.col(c), F.col(f"{c}_mean")) - F.col(f"{c}_mean")) / F.col(f"{c}_sd")
        rows = rows.withColumn(f"{c}_z", clip(z, -limit, limit))
    return rows.drop(*[f"{c}_{s}" for c in columns for s in ("mean", "sd")])


def without_repeated_columns(rows: DataFrame) -> DataFrame:
    """Drops each column that equals an earlier one in every row; one pass compares columns of equal type."""
    kinds = dict(rows.dtypes)
    names = rows.columns
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if kinds[a] == kinds[b]]
    if not pairs:
        return rows
    same = rows.agg(*[F.coalesce(F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))), F.lit(True)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return rows.drop(*{b for i, (_, b) in enumerate(pairs) if same[i]})


def stratified_folds(rows: DataFrame, key: str, y: str, folds: int) -> DataFrame:
    """rows with fold: each class in order of key cut into contiguous parts, whose sizes deal the sorted classes round.

    A row's place in its class comes from ranges of keys, so no class is ordered in one task.
    """
    placed = ordinal_positions(rows, [y], [F.col(key)], "_place", "_size")
    zeros = rows.agg(F.count_if(F.col(y) == 0).alias("_zeros"))
    first = lambda c, i: F.floor((c + (folds - 1 - i)) / folds)  # noqa: E731  places of 0 .. c - 1 that leave i
    start = F.when(F.col(y) == 1, F.col("_zeros")).otherwise(F.lit(0))
    # how many places from start to start + size leave 0 .. i
    upto = [sum((first(start + F.col("_size"), j) - first(start, j) for j in range(i + 1)), F.lit(0)) for i in range(folds)]
    fold = F.lit(folds - 1)
    for i in reversed(range(folds - 1)):
        fold = F.when(F.col("_place") < upto[i], i).otherwise(fold)
    return placed.crossJoin(F.broadcast(zeros)).withColumn("fold", fold).drop("_place", "_size", "_zeros")


def shrunk_encoding(rows: DataFrame, key: str, entity: str, y: str, folds: int) -> DataFrame:
    """rows with fold and encoded: the entity's mean outside the fold, shrunk to the mean outside the fold.

    The weight of the entity's own mean is v n / (v n + s / n), v the target's variance and s the entity's sum of squares;
    unseen entities get the mean. Sums are by entity and fold, and each fold takes the totals less its own.
    """
    x = stratified_folds(rows, key, y, folds)
    parts = x.groupBy(F.col(entity).alias("_e"), "fold").agg(F.count("*").alias("n"), F.sum(y).alias("sy"))
    sums = parts.groupBy("_e").agg(F.sum("n").alias("tn"), F.sum("sy").alias("ts"))
    whole = parts.groupBy("fold").agg(F.sum("n").alias("fn"), F.sum("sy").alias("fs"))
    total = parts.agg(F.sum("n").alias("gn"), F.sum("sy").alias("gs"))
    means = whole.crossJoin(F.broadcast(total)).select(F.col("fold").alias("_f"), ((F.col("gs") - F.col("fs")) / (F.col("gn") - F.col("fn"))).alias("_mean"))
    own = parts.join(sums, "_e").select("_e", F.col("fold").alias("_of"), (F.col("tn") - F.col("n")).alias("_n"), (F.col("ts") - F.col("sy")).alias("_s"))
    made = x.join(own, (F.col(entity) == F.col("_e")) & (F.col("fold") == F.col("_of")), "left").join(F.broadcast(means), F.col("fold") == F.col("_f"))
    m, v = F.try_divide(F.col("_s"), F.col("_n")), F.col("_mean") * (1 - F.col("_mean"))
    weight = v * F.col("_n") / (v * F.col("_n") + F.col("_s") * (1 - m) / F.col("_n"))
    shrunk = F.when((F.col("_n") > 0) & (v > 0), weight * m + (1 - weight) * F.col("_mean")).otherwise(F.col("_mean"))
    return made.withColumn("encoded", shrunk).drop("_e", "_of", "_n", "_s", "_f", "_mean")
