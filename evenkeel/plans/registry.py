"""All driver queries of the analytics operators, by name, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import FRAME_SQL, HISTORY_SQL, MAIN_SQL, PHYSICS_SQL, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SHAPES = {"m": MAIN_SQL, "h": HISTORY_SQL, "f": FRAME_SQL, "g": PHYSICS_SQL}


def query(sql: str | None = None, shapes: str = "", name: str | None = None):
    """Register a function of Tables, under its own name unless another is given. ``shapes`` says which of m, h, f and g the SQL reads."""

    def register(plan: Callable[[Tables], DataFrame]):
        @wraps(plan)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plan(Tables(spark, sf_dir))

        key = name or plan.__name__
        QUERIES[key] = run
        if sql is not None:
            head = ", ".join(_SHAPES[s] for s in shapes)
            ORACLE_SQL[key] = (f"WITH {head}{', ' if sql.startswith('+') else ' '}" if head else "") + sql.removeprefix("+").strip()
        return plan

    return register


from . import drift, features, profiles, sampling, scans, scoring, sequences, signals, temporal  # noqa: E402, F401
from . import tables as _tables  # noqa: E402, F401
