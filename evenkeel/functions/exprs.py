"""Row expressions: pure Column builders that stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def flag(condition: Column) -> Column:
    """0 or 1; null counts as 0."""
    return F.when(condition, 1).otherwise(0)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(z: Column) -> Column:
    """Stable for either sign."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def deployed(z: Column, offset: float, low: float = 0.30, high: float = 0.70) -> Column:
    return clip(sigmoid(z + F.lit(offset)), low, high)


def safe_ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is zero, null or NaN."""
    return F.when(F.isnan(b), None).otherwise(F.try_divide(a, b))


def right_closed(c: Column, edges: list[float], otherwise: int = 0) -> Column:
    """Index of the interval (edge, next edge] that holds c; below the first edge or null: otherwise."""
    out = F.lit(otherwise)
    for k, edge in enumerate(edges):
        out = F.when(c > edge, F.lit(k)).otherwise(out)
    return out


def cut(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the interval (edge, next edge] that holds c; null outside all of them."""
    out = F.when(c <= edges[0], None)
    for edge, label in zip(edges[1:], labels, strict=True):
        out = out.when(c <= edge, label)
    return out


def cut_code(c: Column, edges: list[float]) -> Column:
    """Number of the interval (edge, next edge] that holds c, from 0; null outside all of them."""
    out = F.when(c <= edges[0], None)
    for k, edge in enumerate(edges[1:]):
        out = out.when(c <= edge, k)
    return out


def choose(pairs: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value beside the first condition that holds."""
    out = F
    for condition, value in pairs:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def smoothed_rate(n: Column, rate: Column, prior: Column, strength: float) -> Column:
    """(n * rate + m * prior) / (n + m); the prior alone where n is null."""
    return F.when(n.isNull(), prior).otherwise((n * rate + strength * prior) / (n + strength))


def recency_weight(kind: str, season: Column, first: Column, last: Column) -> Column:
    """Weights over seasons rescaled to [0, 1]."""
    t = F.when(last > first, (season - first) / (last - first)).otherwise(F.lit(1.0))
    return {
        "uniform": F.lit(1.0),
        "linear": 1 + t,
        "exponential": F.pow(F.lit(2.0), t),
        "step": F.when(season < (first + last) / 2, 0.5).otherwise(1.5),
    }[kind]


def parse_date(text: Column) -> Column:
    """M/D/YYYY or YYYY-MM-DD, else null; impossible dates are null."""
    return F.when(F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))).when(
        F.rlike(text, F.lit(r"^\d{1,2}/\d{1,2}/\d{4}$")), F.to_date(F.try_to_timestamp(text, F.lit("M/d/yyyy")))
    )


def classify_value(text: Column, low: float, high: float) -> Column:
    """What kind of value a raw string holds for an integer domain."""
    number = text.try_cast("double")
    return choose(
        [
            (text.isNull() | (F.trim(text) == ""), "missing"),
            (number.isNull(), "unparseable"),
            (F.isnan(number) | (F.abs(number) == float("inf")), "nonfinite"),
            (number != F.floor(number), "non_integer"),
            ((number < low) | (number > high), "out_of_domain"),
        ],
        "legal",
    )



def lexical_kind(text: Column) -> Column:
    """How a raw token is spelled."""
    return choose(
        [
            (text.isNull() | (text == ""), "empty"),
            (text != F.trim(text), "whitespace_variant"),
            (F.rlike(text, F.lit(r"^[+-]?\d+$")), "integer_lexeme"),
            (F.rlike(text, F.lit(r"^[+-]?\d+\.\d+$")), "decimal_lexeme"),
            (F.rlike(text, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)[eE][+-]?\d+$")), "exponent_lexeme"),
        ],
        "other_lexeme",
    )


def entropy_term(share: Column) -> Column:
    return F.when(share > 0, -share * F.log(share)).otherwise(0.0)


def bias_corrected_skew(n: Column, g1: Column) -> Column:
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(n: Column, g2: Column) -> Column:
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


#: The normal quantile of a one-sided bound of 95 %.
ONE_SIDED_95 = 1.6448536269514722


def wilson_upper(successes: Column, n: Column, z: float = ONE_SIDED_95) -> Column:
    p = successes / n
    return (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
