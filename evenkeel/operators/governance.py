"""Guards on the driver: when labels may be read, sealed predictions, determinism."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Phase(Enum):
    SELECTION = "selection"
    FROZEN = "frozen"
    TERMINAL = "terminal"


class FirewallError(RuntimeError):
    pass


class LabelFirewall:
    """Selection seasons' labels are open; the terminal season's are read once, after the choice is frozen."""

    def __init__(self, selection: set[int], terminal: int):
        if terminal in selection:
            raise FirewallError("the terminal season can't be among the selection seasons")
        self.selection, self.terminal, self.phase, self.choice = frozenset(selection), terminal, Phase.SELECTION, None

    def labels(self, rows: DataFrame, season: int) -> DataFrame:
        if season == self.terminal:
            if self.phase is not Phase.FROZEN:
                raise FirewallError(f"terminal labels in phase {self.phase.value}")
            self.phase = Phase.TERMINAL
        elif season not in self.selection:
            raise FirewallError(f"season {season} is not open")
        return rows.where(F.col("season") == season)

    def freeze(self, choice: str) -> None:
        if self.phase is not Phase.SELECTION:
            raise FirewallError("frozen before")
        self.phase, self.choice = Phase.FROZEN, choice


def seal(predictions: DataFrame, key: str, value: str) -> str:
    """A digest of the predictions, whatever their order; 256 buckets' digests are joined in order."""
    line = F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col(value).cast("string")), 256)
    buckets = predictions.select(line.alias("d")).groupBy(F.substring("d", 1, 2).alias("b")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
    return buckets.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256)).first()[0]


def check_seal(predictions: DataFrame, key: str, value: str, digest: str) -> None:
    if seal(predictions, key, value) != digest:
        raise FirewallError("predictions were changed after they were sealed")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def check_contract(config: dict, runtime: dict) -> None:
    """A run's settings must be those that were agreed on, key by key."""
    drift = sorted(k for k in config.keys() | runtime.keys() if config.get(k) != runtime.get(k))
    if drift:
        raise FirewallError(f"settings differ from the contract: {drift}")


def check_aggregate_only(metrics: DataFrame, count: str, least: int, identifiers: tuple[str, ...] = ()) -> None:
    """A report may hold no identifier and no group of fewer than ``least`` rows."""
    named = set(metrics.columns) & set(identifiers)
    if named or not metrics.where(F.col(count) < least).isEmpty():
        raise FirewallError(f"not aggregate only: identifiers {sorted(named)} or groups under {least}")


def freeze_decision(evidence: DataFrame, gain: str, least: float, origins: int) -> str | None:
    """The candidate whose gain exceeds ``least`` on every one of the origins, the largest mean first, then the
    smaller name; None if there is none or any gain is unknown."""
    made = evidence.groupBy("candidate").agg(
        F.avg(gain).alias("mean"), F.min(gain).alias("worst"), F.count(gain).alias("known"), F.count("*").alias("n")
    )
    best = made.where((F.col("known") == origins) & (F.col("n") == origins) & (F.col("worst") > least)).orderBy(F.desc("mean"), "candidate").head()
    return best["candidate"] if best else None


def one_hot(rows: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """A 0/1 column for each level, in lexicographic order; unseen values have all zeros."""
    return rows.select("*", *[F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}={v}") for v in sorted(levels)])
