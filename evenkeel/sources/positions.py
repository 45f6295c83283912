"""Source positions of rows in text files, and what rests on them: two-pass reads, ordered attachment, lock-step readings.

A file is read in splits, each by one task in order. A row's place in its split comes from the id that Spark gives the rows of a
task, the split's from the rows of earlier splits, and the file's from the rows of earlier files by name. Splits may be cut anew between two reads; positions don't change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import lexical_kind
from .readers import ContractError
from .stage import shared_dir, staged


def written_csv(rows: DataFrame, order: list[str], parts: int, name: str, header: bool = True) -> str:
    """The rows as CSV files whose names follow the order; returns their folder."""
    path = f"{shared_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.csv(path, header=header)
    return path


def in_file(scan: DataFrame) -> DataFrame:
    """A scan of whole files with _file and _at, the row's number in its file from 0. Not to be filtered by rows before."""
    named = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    # one row a split
    splits = staged(named.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "splits")
    at = F.col("_before") + F.col("_id") - F.col("_first")
    return named.join(splits, ["_file", "_start"]).select(*scan.columns, "_file", at.alias("_at"))


def file_offsets(placed: DataFrame) -> DataFrame:
    """_file and _offset, the rows of all files before it by name; one row a file."""
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    return placed.groupBy("_file").agg(F.count("*").alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))


def positioned(scan: DataFrame) -> DataFrame:
    """A scan of whole files with pos, the row's number in source order from 0."""
    placed = in_file(scan)
    offsets = staged(file_offsets(placed), "offsets")
    return placed.join(offsets, "_file").select(*scan.columns, (F.col("_offset") + F.col("_at")).alias("pos"))


def read_scoped(spark: SparkSession, path: str, schema: T.StructType, wanted: Column, columns: list[str], needs: list[str]) -> DataFrame:
    """columns and pos of the rows where ``wanted`` holds, in two passes.

    The first reads the columns ``needs`` of wanted and notes the positions of its rows; the second opens only files that hold any, and takes the rows at those
    positions without looking at their values. Fails where the passes differ in number.
    """
    read = lambda: spark.read.schema(schema).csv(path, header=True)
    first = in_file(read().select(*needs))
    offsets = staged(file_offsets(first), "offsets")
    places = staged(first.where(wanted).select("_file", "_at"), "places")
    # the driver's file index holds the names of all files anyway
    files = [r["_file"] for r in places.select("_file").distinct().collect()]
    second = in_file(read().where(F.col("_metadata.file_path").isin(files)).select(*columns))
    found = staged(second.join(places, ["_file", "_at"], "left_semi").join(offsets, "_file").select(*columns, (F.col("_offset") + F.col("_at")).alias("pos")), "scoped")
    asked, got = places.count(), found.count()
    if asked != got:
        raise ContractError(f"{asked} positions noted, {got} rows read at them")
    return found


def key_digest(rows: DataFrame, key: str) -> tuple:
    """Number of rows and a digest of their keys in order of pos."""
    parts = [F.bit_xor(F.xxhash64(F.lit(seed), "pos", key)).alias(f"d{seed}") for seed in (1, 2)]
    return tuple(rows.agg(F.count("*").alias("n"), *parts).first())


def attach_in_order(features: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """features with the further columns of targets, row by row. Both have pos; the same keys in another order are refused."""
    ours, theirs = key_digest(features, key), key_digest(targets, key)
    if ours[0] != theirs[0]:
        raise ContractError(f"{ours[0]} rows of features, {theirs[0]} of targets")
    if ours != theirs:
        raise ContractError(f"{key} of targets differs from that of features, or its order does")
    return features.join(targets.drop(key), "pos")


def lockstep(lines: DataFrame, schema: T.StructType, header: str | None = None) -> DataFrame:
    """Lines of text (value) read twice at once: typed, a struct with null where a token doesn't parse, and raw, the tokens as they are written.

    Both come from the same row, so they can't get out of step, in a batch or in a stream. Lines that are the header are left out. Fields must not hold line breaks.
    """
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    kept = lines if header is None else lines.where(F.col("value") != header)
    plain = {"mode": "PERMISSIVE", "nullValue": "\x00", "emptyValue": ""}
    return kept.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE"}).alias("typed"), F.from_csv("value", raw.simpleString()[7:-1].replace(":", " "), plain).alias("raw"))


def lexical_audit(read: DataFrame, columns: list[str]) -> DataFrame:
    """field, kind of the raw token, n, and how many of them the typed reading couldn't parse; batch and streaming frames alike."""
    fields = [
        F.struct(F.lit(c).alias("field"), lexical_kind(F.col(f"raw.{c}")).alias("kind"), (F.col(f"typed.{c}").isNull() & (F.coalesce(F.col(f"raw.{c}"), F.lit("")) != "")).alias("failed")) for c in columns
    ]
    return read.select(F.inline(F.array(*fields))).groupBy("field", "kind").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
