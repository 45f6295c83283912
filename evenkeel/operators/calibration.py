"""Fitted calibrations: logistic (Platt), beta, isotonic, and zero-sum subgroup intercepts.

Fits go by Newton steps: a step is one aggregate over cells (rows alike in predictor and outcome, counted), its solution a column expression, so neither
rows nor groups come to the driver. Isotonic fits pool cells of a millionth, of which there are a million and one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clip, logit, sigmoid
from ..sources.stage import staged

#: Newton steps; from SURE steps on they stop once no coefficient moves by more than SETTLED.
ROUNDS, SURE, SETTLED = 25, 5, 1e-12
#: Cells of the unit interval that an isotonic fit tells apart.
MICRO = 1_000_000


def platt_features(p: Column) -> list[Column]:
    return [logit(p)]


def beta_features(p: Column, eps: float = 1e-6) -> list[Column]:
    """ln p and -ln(1 - p)."""
    q = clip(p, eps, 1 - eps)
    return [F.log(q), -F.log1p(-q)]


def _solved(h: list[list[Column]], g: list[Column]) -> list[Column]:
    """The solution of a symmetric system of up to three equations, by determinants."""

    def det(m: list[list[Column]]) -> Column:
        if len(m) == 1:
            return m[0][0]
        terms = [m[0][j] * det([row[:j] + row[j + 1 :] for row in m[1:]]) for j in range(len(m))]
        return sum((t if j % 2 == 0 else -t for j, t in enumerate(terms[1:], 1)), terms[0])

    whole = det(h)
    return [F.try_divide(det([[g[i] if j == k else h[i][j] for j in range(len(g))] for i in range(len(g))]), whole) for k in range(len(g))]


def newton_logistic(cells: DataFrame, by: list[str], features: list[str], y: str, n: str, l2: float, rounds: int = ROUNDS) -> DataFrame:
    """by and b0 (intercept), b1, ... of a logistic fit of each ``by``: the least sum of log losses and l2 / 2 times the slopes' squares.

    ``by`` should have few values, such as folds. Where the curvature is singular (a single cell, or one class without penalty) coefficients are null.
    """
    names = [f"b{i}" for i in range(len(features) + 1)]
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    coefficients = cells.select(*by, *[F.lit(0.0).alias(b) for b in names]).distinct()
    for done in range(1, rounds + 1):
        p = sigmoid(sum((F.col(b) * v for b, v in zip(names[1:], x[1:])), F.col("b0")))
        gap, curve = F.col(n) * (F.col(y) - p), F.col(n) * p * (1 - p)
        gradient = [F.sum(gap * v).alias(f"_g{i}") for i, v in enumerate(x)]
        curvature = [F.sum(curve * x[i] * x[j]).alias(f"_h{i}{j}") for i in range(len(x)) for j in range(i, len(x))]
        sums = cells.join(F.broadcast(coefficients), by).groupBy(*by, *names).agg(*gradient, *curvature)
        penalty = [0.0] + [l2] * len(features)
        h = [[F.col(f"_h{min(i, j)}{max(i, j)}") + (penalty[i] if i == j else 0.0) for j in range(len(x))] for i in range(len(x))]
        g = [F.col(f"_g{i}") - penalty[i] * F.col(names[i]) for i in range(len(x))]
        steps = _solved(h, g)
        moved = F.greatest(*[F.abs(s) for s in steps]) if len(steps) > 1 else F.abs(steps[0])
        written = staged(sums.select(*by, *[(F.col(b) + s).alias(b) for b, s in zip(names, steps)], moved.alias("_moved")), "newton")
        coefficients = written.drop("_moved")
        if done >= SURE and (written.agg(F.max("_moved")).first()[0] or 0.0) < SETTLED:
            break
    return coefficients


def logistic(train: DataFrame, rows: DataFrame, p: str, y: str, features=platt_features, out: str = "calibrated", by: list[str] | None = None, l2: float = 0.0) -> DataFrame:
    """rows with calibrated probabilities, fitted on train (one fit for each ``by``, whose columns both have); nothing of rows enters the fit."""
    by = by or []
    keyed = train if by else train.withColumn("_fit", F.lit(0))
    names = [f"_x{i}" for i in range(1, 1 + len(features(F.col(p))))]
    cells = keyed.groupBy(*(by or ["_fit"]), F.col(p).alias("_p"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_n"))
    cells = staged(cells.select("*", *[c.alias(k) for c, k in zip(features(F.col("_p")), names)]), "cells")
    fit = newton_logistic(cells, by or ["_fit"], names, "_y", "_n", l2)
    at = sum((F.col(f"b{i}") * c for i, c in enumerate(features(F.col(p)), 1)), F.col("b0"))
    joined = rows.join(F.broadcast(fit), by) if by else rows.crossJoin(F.broadcast(fit.drop("_fit")))
    return joined.withColumn(out, sigmoid(at)).select(*rows.columns, out)


def _pooled(means: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing values in weighted squares, by pooling adjacent violators."""
    value, weight, size = [], [], []
    for m, w in zip(means.tolist(), weights.tolist()):
        value.append(m)
        weight.append(w)
        size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            m, w, s = value.pop(), weight.pop(), size.pop()
            value[-1] = (value[-1] * weight[-1] + m * w) / (weight[-1] + w)
            weight[-1] += w
            size[-1] += s
    return np.repeat(value, size)


def isotonic_table(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, cell and value of every cell: fitted where n > 0 (n rows, s of them positive), between fitted cells on the straight line, beyond them level.

    cells: by, cell, n and s, each cell once. One ``by`` is one task, with MICRO + 1 cells at most.
    """
    names = [*by, "cell", "value"]

    def fit(table: pa.Table) -> pa.Table:
        cell, n, s = (table.column(c).to_numpy().astype(float) for c in ("cell", "n", "s"))
        order = np.argsort(cell)
        seen = order[n[order] > 0]
        value = np.interp(cell, cell[seen], _pooled(s[seen] / n[seen], n[seen])) if len(seen) else np.full(len(cell), np.nan)
        return pa.Table.from_arrays([*[table.column(k) for k in by], table.column("cell"), pa.array(value, mask=np.isnan(value))], names)

    kinds = ", ".join(f"{k} {cells.schema[k].dataType.simpleString()}" for k in by)
    return cells.groupBy(*by).applyInArrow(fit, f"{kinds}, cell bigint, value double")


def isotonic(train: DataFrame, rows: DataFrame, p: str, y: str, out: str = "calibrated", low: float = 1e-3, by: list[str] | None = None) -> DataFrame:
    """Monotone calibration by millionths of p, clipped away from 0 and 1; one fit for each ``by``, whose columns both have."""
    keys = by or ["_fit"]
    cell = F.round(F.col(p) * MICRO).cast("long")
    keyed = lambda df: (df if by else df.withColumn("_fit", F.lit(0))).withColumn("cell", cell)
    fitted = keyed(train).groupBy(*keys, "cell").agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    asked = keyed(rows).select(*keys, "cell", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s")).distinct()
    cells = fitted.unionByName(asked).groupBy(*keys, "cell").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    table = isotonic_table(cells, keys)
    return keyed(rows).join(table, [*keys, "cell"], "left").withColumn(out, clip(F.col("value"), low, 1 - low)).select(*rows.columns, out)


def cross_fit(rows: DataFrame, fold: str, folds: int, calibrate) -> DataFrame:
    """rows, each calibrated by a fit on the other folds. calibrate(train, rows) gives rows with the calibrated column."""
    parts = [calibrate(rows.where(F.col(fold) != k), rows.where(F.col(fold) == k)) for k in range(folds)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_fit_together(rows: DataFrame, fold: str, folds: int, calibrate) -> DataFrame:
    """cross_fit with the fits of all folds at once: a row trains all but its own fold's.

    calibrate(train, rows, by) gives rows with the calibrated column, fitted for each ``by``.
    """
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col(fold).cast("int"))).alias("_held")
    train = rows.select("*", others)
    return calibrate(train, rows.withColumn("_held", F.col(fold).cast("int")), ["_held"]).drop("_held")


def subgroup_intercepts(rows: DataFrame, group: str, z: str, y: str, lam: float = 0.001, shrink: float = 5000.0, cap: float = 0.05, rounds: int = ROUNDS) -> DataFrame:
    """group, n, raw and beta: logistic intercepts on top of z that minimise the mean log loss plus lam times their squares, with zero
    count-weighted sum (raw), then shrunk by n / (n + shrink) and capped (beta). A single group has 0.

    A Newton step is one aggregate by group over cells of equal z and outcome; the constraint is kept by its Lagrange multiplier, one number for all groups, which
    has a closed form as the curvature is diagonal. Groups stay in a table that is written after each step.
    """
    cells = staged(rows.groupBy(group, F.col(z).alias("_z"), F.col(y).alias("_y")).agg(F.count("*").alias("_n")), "cells")
    beta = cells.groupBy(group).agg(F.sum("_n").alias("n"), F.lit(0.0).alias("raw"))
    penalty = 2 * lam * (cells.agg(F.sum("_n")).first()[0] or 0)
    for _ in range(rounds):
        p = sigmoid(F.col("_z") + F.col("raw"))
        sums = cells.join(beta, group).groupBy(group, "n", "raw").agg(
            (F.sum(F.col("_n") * (F.col("_y") - p)) - penalty * F.first("raw")).alias("_g"), (F.sum(F.col("_n") * p * (1 - p)) + penalty).alias("_h")
        )
        sums = staged(sums, "intercepts")
        g, h, n, raw = (F.col(c) for c in ("_g", "_h", "n", "raw"))
        held = sums.agg(F.try_divide(F.sum(n * g / h) + F.sum(n * raw), F.sum(n * n / h)).alias("_l"))
        step = (g - F.col("_l") * n) / h
        moved = sums.crossJoin(F.broadcast(held)).select(group, "n", (raw + step).alias("raw"), F.abs(step).alias("_moved"))
        beta = staged(moved, "intercepts")
        most = beta.agg(F.max("_moved")).first()[0]
        beta = beta.drop("_moved")
        if most is None or most < SETTLED:
            break
    return beta.withColumn("beta", clip(F.col("raw") * F.col("n") / (F.col("n") + shrink), -cap, cap))
