"""Sinks: golden tables, reports, keyed caches and submissions in template order."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def golden_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One sorted file of a small table."""
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").csv(path, header=True)


def report(metrics: DataFrame, path: str) -> str:
    """Metric rows as JSON lines; returns the hash of their canonical form, whatever their order. Never overwrites."""
    lines = metrics.select(F.to_json(F.struct(*sorted(metrics.columns))).alias("value"))
    lines.coalesce(1).write.mode("errorifexists").text(path)
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("value")), "\n"), 256)).first()[0]


def canonical_hash(metrics: DataFrame) -> str:
    """Of the rows as JSON with sorted keys, in sorted order; metrics are aggregates, few by nature."""
    lines = metrics.select(F.to_json(F.struct(*sorted(metrics.columns))).alias("value"))
    return lines.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("value")), "\n"), 256)).first()[0] or hashlib.sha256(b"").hexdigest()


def write_report(metrics: DataFrame, folder: str, title: str, order: list[str], keep_out: str | None = None) -> str:
    """Metric rows as JSON lines (folder/json) and as a Markdown table under the title and the canonical hash (folder/md); returns the hash.

    Never overwrites, and refuses a folder inside ``keep_out``, such as the repository. Null cells are empty in the table.
    """
    at = os.path.realpath(folder.removeprefix("file:")) if "://" not in folder else None
    if keep_out is not None and at is not None and os.path.commonpath([at, os.path.realpath(keep_out)]) == os.path.realpath(keep_out):
        raise ValueError(f"reports must be outside {keep_out}: {folder}")
    digest = canonical_hash(metrics)
    metrics.select(F.to_json(F.struct(*sorted(metrics.columns))).alias("value")).orderBy("value").coalesce(1).write.mode("errorifexists").text(f"{folder}/json")
    head = [f"# {title}", "", f"Canonical SHA-256: `{digest}`", "", "| " + " | ".join(metrics.columns) + " |", "|" + " --- |" * len(metrics.columns)]
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in metrics.columns]), F.lit(" |"))
    table = metrics.orderBy(*order).select(cells.alias("value"))
    top = metrics.sparkSession.range(1).select(F.explode(F.array(*[F.lit(h) for h in head])).alias("value"))
    top.coalesce(1).unionByName(table.coalesce(1)).coalesce(1).write.mode("errorifexists").text(f"{folder}/md")
    return digest


def cache_key(config: dict) -> str:
    """Of equal configurations, however their keys are ordered, the same key."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def cached(df_of, config: dict, spark, root: str) -> DataFrame:
    """What df_of() gives, computed once for a configuration and kept as Parquet under its key."""
    path = f"{root}/key={cache_key(config)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def in_template_order(template: DataFrame, predictions: DataFrame, key: str, order: str, value: str, placeholder: float | None = None) -> DataFrame:
    """The template's rows in its order with their predictions; a placeholder, or a null to be refused, where one is missing."""
    p = predictions.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    joined = template.select(key, order).join(p, F.col(key) == F.col("_k"), "left")
    filled = F.coalesce("_v", F.lit(placeholder)) if placeholder is not None else F.col("_v")
    return joined.orderBy(order).select(key, filled.alias(value))
