"""Scores of probability predictions. Each is one aggregate pass; grids are small and broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def skill(p: Column, y: Column, clamp: bool = False, scale: float = 1e5) -> Column:
    """Brier skill against the base rate: 1e5 * (1 - Brier / (r (1 - r))); null for a single class."""
    r = F.avg(y)
    value = scale * (1 - F.try_divide(brier(p, y), r * (1 - r)))
    return F.greatest(F.lit(0.0), value) if clamp else value


def grid(rows: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Each row once for every grid value; aggregate at once."""
    return rows.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name))


def cells(rows: DataFrame, predictions: list[str], y: str) -> DataFrame:
    """Rows of equal predictions and outcome as one, with their number n: a grid multiplies these and not rows."""
    return rows.groupBy(*predictions, y).agg(F.count("*").alias("n"))


def counted_skill(p: Column, y: Column, n: Column, scale: float = 1e5) -> Column:
    """skill of rows that stand for n each."""
    r = F.sum(n * y) / F.sum(n)
    return scale * (1 - F.try_divide(F.sum(n * (p - y) * (p - y)) / F.sum(n), r * (1 - r)))


def capped_correction(z: Column, z_residual: Column, offset: float, cap: Column | float) -> Column:
    """z moved towards the residual member's logit less the deployed offset, by cap at most."""
    limit = F.lit(cap) if isinstance(cap, float) else cap
    return z + F.least(F.greatest(z_residual - F.lit(offset) - z, -limit), limit)


def rolling_choice(years: DataFrame, candidate: str) -> DataFrame:
    """years: candidate, season and b, its score there. mean_brier over the seasons, their number, and chosen: 1 for the least, the smallest candidate on a tie."""
    means = years.groupBy(candidate).agg(F.avg("b").alias("mean_brier"), F.count("*").alias("years"))
    best = means.agg(F.min(F.struct(F.round("mean_brier", 12).alias("r"), candidate))[candidate].alias("_best"))
    return means.crossJoin(F.broadcast(best)).withColumn("chosen", F.when(F.col(candidate) == F.col("_best"), 1).otherwise(0)).drop("_best")


def simplex(members: int, ticks: int) -> list[tuple[int, ...]]:
    """All weight vectors in units of 1 / ticks that sum to one, in lexicographic order."""
    if members == 1:
        return [(ticks,)]
    return [(k, *rest) for k in range(ticks + 1) for rest in simplex(members - 1, ticks - k)]


def _least(rows: DataFrame, names: list[str], points: list[tuple[float, ...]], p: Column, y: str) -> tuple[float, tuple[float, ...]]:
    """The least Brier score of p over the points, to 14 digits, and the first point that has it. One aggregate."""
    each = rows.select("*", F.inline(F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(names, at, strict=True)]) for at in points])))
    scores = each.groupBy(*names).agg(F.round(brier(p, F.col(y)), 14).alias("_b"))
    best = scores.agg(F.min(F.struct("_b", *names)).alias("s")).first()["s"]
    return best["_b"], tuple(best[n] for n in names)


def slope_search(rows: DataFrame, z: str = "z", y: str = "y", offset: float = 0.0) -> tuple[float, float]:
    """The slope of z with the least Brier score, and that score: 201 slopes from 0.6 to 1.4, then steps of 0.001 within 0.02 of the best."""
    rows = rows.select(F.col(z).alias("_z"), F.col(y).alias("_y"))
    p = 1 / (1 + F.exp(-(F.col("_a") * F.col("_z") + offset)))
    _, (a,) = _least(rows, ["_a"], [(0.6 + 0.8 * k / 200,) for k in range(201)], p, "_y")
    low, high = max(0.6, a - 0.02), min(1.4, a + 0.02)
    steps = round((high - low) / 0.001)
    b, (a,) = _least(rows, ["_a"], [(low + (high - low) * k / steps,) for k in range(steps + 1)], p, "_y")
    return a, b


def weight_search(rows: DataFrame, members: list[str], y: str = "y", step: float = 0.02) -> tuple[tuple[float, ...], float]:
    """Weights of three logit columns with the least Brier score, and that score: the simplex in steps of 0.05, then the neighbours of the best at ``step``."""
    rows = rows.select(*[F.col(m).alias(f"_z{k}") for k, m in enumerate(members)], F.col(y).alias("_y"))
    names = ["_w0", "_w1", "_w2"]
    p = 1 / (1 + F.exp(-sum(F.col(w) * F.col(f"_z{k}") for k, w in enumerate(names))))
    _, (a, b, _) = _least(rows, names, [tuple(k / 20 for k in ws) for ws in simplex(3, 20)], p, "_y")
    near = [(round(a + i * step, 4), round(b + j * step, 4)) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    score, weights = _least(rows, names, [(i, j, round(1 - i - j, 4)) for i, j in near if min(i, j, round(1 - i - j, 4)) >= 0], p, "_y")
    return weights, score


def screen_gate(delta: Column, brier_new: Column, brier_base: Column, mean_shift: Column, lower: Column | None = None, gain: float = 1.0, shift: float = 0.005) -> Column:
    """Whether a candidate passes one origin: skill gained, Brier lower, the mean hardly moved, all finite and, where
    it is given, the bootstrap's lower bound above zero. Unknown values don't pass. Brier may be any score that falls as it does."""
    finite = F.abs(brier_new) < float("inf")
    sure = F.lit(True) if lower is None else lower > 0
    return F.coalesce((delta > gain) & (brier_new < brier_base) & (F.abs(mean_shift) <= shift) & finite & sure, F.lit(False))


def family_gate(pairs: DataFrame, guardrails: dict[str, float], tolerance: float = 1e-12) -> DataFrame:
    """pairs: family, current and candidate distances, one row a key. For each family its medians, 95 % points and status.

    PASS where the median is no worse and the 95 % point no more worse than the family's guardrail;
    FAIL_CLOSED where the candidate lacks a value that the current one has, or nothing can be paired. strict tells
    whether the median is better.
    """
    both = F.col("current").isNotNull() & F.col("candidate").isNotNull()
    of = lambda c, p: F.percentile(F.when(both, F.col(c)), F.lit(p))
    made = pairs.groupBy("family").agg(
        F.count_if(both).alias("n"),
        F.count_if(F.col("current").isNotNull() & F.col("candidate").isNull()).alias("lost"),
        *[of(c, p).alias(f"{c}_{name}") for c in ("current", "candidate") for name, p in (("med", 0.5), ("p95", 0.95))],
    )
    rail = F.create_map(*[F.lit(x) for pair in guardrails.items() for x in pair])[F.col("family")]
    good = (F.col("candidate_med") <= F.col("current_med") + tolerance) & (F.col("candidate_p95") <= F.col("current_p95") + rail)
    status = F.when((F.col("lost") > 0) | (F.col("n") == 0), "FAIL_CLOSED").when(good, "PASS").otherwise("FAIL")
    return made.withColumn("status", status).withColumn("strict", (F.col("status") == "PASS") & (F.col("candidate_med") < F.col("current_med") - tolerance))


def relative_reduction(current: Column, candidate: Column, least: float, tolerance: float = 1e-12) -> Column:
    """PASS where candidate is at most (1 - least) of current; FAIL_CLOSED without a positive current or any candidate."""
    closed = current.isNull() | candidate.isNull() | (current <= tolerance)
    return F.when(closed, "FAIL_CLOSED").when(candidate <= current * (1 - least) + tolerance, "PASS").otherwise("FAIL")


def resolution(rows: DataFrame, cell: str, target: str = "y", scale: float = 1e5) -> DataFrame:
    """How much skill the cells' means could give at most."""
    cells = rows.groupBy(cell).agg(F.avg(target).alias("o"), F.count("*").alias("n"))
    whole = cells.agg((F.sum(F.col("o") * F.col("n")) / F.sum("n")).alias("r"), F.sum("n").alias("t"))
    gain = F.sum(F.col("n") / F.col("t") * (F.col("o") - F.col("r")) * (F.col("o") - F.col("r")))
    return cells.crossJoin(F.broadcast(whole)).groupBy("r").agg((scale * gain).alias("g")).select((F.col("g") / (F.col("r") * (1 - F.col("r")))).alias("resolution"))
