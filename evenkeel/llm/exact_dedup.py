"""Exact deduplication with a heavy-hitter split.

One pass writes a small digest table. A Misra-Gries summary (Spark's approx_top_k: mergeable
frequent-items counters, a fixed number of them in each task) proposes frequent digests; an exact
count over all rows verifies them. The verified winners, at most ``tracked`` rows, are broadcast,
so rows of frequent digests are settled on the map side and never meet in one task. All other
digests are counted with map-side combining and joined back through an ordinary shuffle. The summary
overstates a count by 3.5 / ``tracked`` of all rows at most, and proposes half as many digests as it
tracks: what it misses is under that share, and a group of that size is still one row a task in the
counts and one that Spark's skew join splits.

Defined results: null text counts as empty; very long texts are hashed whole. Of equal texts the row with the largest doc_id stays;
null ids rank lowest; rows that also share the id are told apart by a row number given when the
digest table is written, so exactly one row of each group stays. An empty table gives no rows.
Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged

#: Counters of the summary.
TRACKED = 4096
#: Verified groups under this size are left to the shuffle.
HEAVY_ROWS = 64


def digest_table(docs: DataFrame) -> DataFrame:
    return staged(
        docs.select(
            F.col("doc_id"),
            F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "digests",
    )


def heavy_digests(digests: DataFrame, tracked: int = TRACKED, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """digest, top (doc_id, rid of the row that stays) and group_size of the verified frequent digests."""
    summary = digests.select(F.hex("digest").alias("d")).agg(
        F.expr(f"approx_top_k(d, {tracked // 2}, {tracked})").alias("found")
    )
    proposed = summary.select(F.explode("found").alias("f")).select(F.unhex("f.item").alias("digest"))
    # at most tracked / 2 rows
    return (
        digests.join(F.broadcast(proposed), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size"))
        .where(F.col("group_size") >= heavy_rows)
    )


def exact_groups(docs: DataFrame, tracked: int = TRACKED, heavy_rows: int = HEAVY_ROWS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs."""
    digests = digest_table(docs)
    winners = staged(heavy_digests(digests, tracked, heavy_rows).coalesce(1), "winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(rest.groupBy("digest").agg(F.max(F.struct("doc_id", "rid")).alias("top"), F.count("*").alias("group_size")), "digest")
    return heavy.unionByName(light).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("top.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
