"""Scans with contracts: exact headers, role projections, positions, aligned targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """Input that breaks its contract; scans fail closed."""


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header; a byte-order mark is dropped by the reader. Columns are matched to the header exactly."""
    validate_header(spark, path, schema.fieldNames())
    return spark.read.schema(schema).option("enforceSchema", False).csv(path, header=True)


def scan_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as the strings that are written, for lexical audits beside try_cast columns."""
    return spark.read.csv(path, header=True, inferSchema=False, nullValue="\x00", emptyValue="")


def validate_header(spark: SparkSession, path: str, expected: list[str]) -> None:
    """Reads no data rows."""
    found = spark.read.csv(path, header=True).columns
    if found != list(expected):
        raise ContractError(f"header of {path}: {found}, expected {list(expected)}")


def project(df: DataFrame, columns: list[str], forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Exactly these columns; those that a role must never see can't be asked for."""
    seen = set(columns) & set(forbidden)
    if seen:
        raise ContractError(f"columns forbidden here: {sorted(seen)}")
    missing = set(columns) - set(df.columns)
    if missing:
        raise ContractError(f"columns missing: {sorted(missing)}")
    return df.select(*columns)


def scoped(df: DataFrame, seasons: list[int], allowed: set[int]) -> DataFrame:
    """Rows of some seasons; the filter reaches the scan. Other seasons than the allowed can't be asked for."""
    if not set(seasons) <= allowed:
        raise ContractError(f"seasons forbidden here: {sorted(set(seasons) - allowed)}")
    return df.where(F.col("season").isin(*seasons))


def at_positions(df: DataFrame, positions: DataFrame, key: str) -> DataFrame:
    """The rows whose key is listed; fails where a listed key has no row or several."""
    found = df.join(positions.select(key).distinct(), key, "left_semi")
    wanted, got = positions.select(key).distinct().count(), found.count()
    if wanted != got:
        raise ContractError(f"{wanted} positions asked for, {got} rows found")
    return found


def attach_targets(features: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Inner join on a key that must be unique and the same set on both sides."""
    sides = [f.agg(F.count("*").alias("n"), F.countDistinct(key).alias("d")).first() for f in (features, targets)]
    joined = features.join(targets, key)
    if any(s["n"] != s["d"] for s in sides) or sides[0]["n"] != sides[1]["n"] or joined.count() != sides[0]["n"]:
        raise ContractError("keys of features and targets differ")
    return joined


def missing_to_null(df: DataFrame) -> DataFrame:
    """Empty strings and NaN become null, once, at the scan."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.when(c != "", c)
        elif isinstance(f.dataType, T.DoubleType | T.FloatType):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)
