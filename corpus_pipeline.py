"""A training corpus from documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents. Stage functions are maps, or shuffle keys and not texts, wherever the decision allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evenkeel.llm.common import read_table, staged
from evenkeel.llm.decontaminate import clean_documents
from evenkeel.llm.language import keep_identified
from evenkeel.llm.mixing import mixed_documents
from evenkeel.llm.sharding import build_tree, shard_of
from evenkeel.llm.simhash import first_of_each


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; texts without letters or far from all centroids go.

    Null and empty texts go; very long ones are read whole; nulls elsewhere stay. Repeated rows fare alike, ties
    between languages don't matter, further columns stay, and an empty table gives no rows. Without any label all rows go.
    """
    return keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, that of the smallest doc_id.

    Null and empty texts are one group; null ids rank last, and groups without ids or that share one are kept apart;
    of repeated rows one stays, of rows that share the smallest id that of the least text hash. Very long texts are
    read whole, further columns stay, and an empty table gives no rows.
    """
    return first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs.

    Null and empty texts have none and stay; very long texts are scanned whole; repeated rows fare alike. An empty
    benchmark drops nothing, further columns stay, and an empty table gives no rows.
    """
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, or up to three times.

    Null sources are one source, null texts have no words; equal rows are told apart by row numbers, so repeated ids
    and texts spoil no target. Very long texts are counted whole, further columns stay, and an empty table gives no rows.
    """
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard that each belongs to.

    The id alone decides: null ids share a shard, repeated rows too, and texts don't matter. Ties between draws go to
    the lower shard. A column named shard is replaced, others stay, and an empty table gives no rows.
    """
    return shard_of(docs, build_tree(), "shard")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("shard", shard),
]

#: Language ID and SimHash are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
