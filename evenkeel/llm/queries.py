"""Driver queries of the corpus operators and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, exact_dedup, filter_audit, html_extract, language, lot_matching, mixing, nearest, pii, sharding, simhash, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_centroid": language.op1_nearest_centroid,
    "op2_prefix_targets": chat_format.op2_prefix_targets,
    "op3_host_reputation": url_filter.op3_host_reputation,
    "op4_hash_tree_shards": sharding.op4_hash_tree_shards,
    "op5_tree_model_text": html_extract.op5_tree_model_text,
    "op6_simhash_anchors": simhash.op6_simhash_anchors,
    "op7_weak_supervision_pii": pii.op7_weak_supervision_pii,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_filter_bitmaps": filter_audit.op11_filter_bitmaps,
    "op12_hilbert_neighbours": nearest.op12_hilbert_neighbours,
    "op13_return_lots": lot_matching.op13_return_lots,
}

#: Classifiers, checksums, fingerprints and page models that SQL can't express are tested by brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_prefix_targets": chat_format.ORACLE_SQL,
    "op3_host_reputation": url_filter.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
    "op9_source_mix": mixing.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_filter_bitmaps": filter_audit.ORACLE_SQL,
    "op13_return_lots": lot_matching.ORACLE_SQL,
}
