"""Chunked scans as micro-batches: counts that accumulate over the files of a folder.

The batch aggregates of the audits are sums, so a file stream keeps them up to date with the same
expressions; each micro-batch is one chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import lexical_kind


def chunks(spark: SparkSession, path: str, schema: T.StructType, files_per_chunk: int = 1, kind: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_chunk)
    return (reader.option("header", True).csv(path)) if kind == "csv" else reader.parquet(path)


def lexical_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """field, kind and n; works on batch and streaming frames alike."""
    fields: list[Column] = [F.struct(F.lit(c).alias("field"), lexical_kind(F.col(c).cast("string")).alias("kind")) for c in columns]
    return rows.select(F.inline(F.array(*fields))).groupBy("field", "kind").agg(F.count("*").alias("n"))


def run_to_end(counts: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Takes all chunks that are there, and returns the totals."""
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.table(name)
