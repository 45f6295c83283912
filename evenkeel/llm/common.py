"""What several corpus operators share: staged tables, ASCII case, exact row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stage import checkpointed, shared_dir, staged

__all__ = ["ascii_lower", "bounded_batches", "checkpointed", "read_table", "row_key", "shared_dir", "staged"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch, and Spark's own value, which is replaced.
BATCH_BYTES, SPARK_BATCH_BYTES = 4 << 20, 64 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Have the session send texts to Python in batches of BATCH_BYTES, unless it has a value of its own.

    A task holds a batch in the JVM and in Python, with room to grow in both; a single longer text is a batch of its own.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).removesuffix("b") == str(SPARK_BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts of one byte per character take the fast path."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def row_key(docs: DataFrame) -> list[Column]:
    """What tells rows of documents apart without shuffling their texts: doc_id and a text hash."""
    return [
        docs["doc_id"].alias("__ek_id"),
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("__ek_text"),
    ]
