"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Benchmark items are cut into windows of ten words (items of fewer words are one window). The
distinct windows are broadcast, keyed by hash. Each document's word hashes are exploded and
every position's window is hashed and probed in one generated loop; a hit is verified word for
word in the same join, so neither texts nor words are copied for windows that miss. Hits are
counted for each document after one shuffle of small rows; texts are never shuffled.

At most ``max_windows`` windows are broadcast at once; they are counted first. A larger benchmark is
taken in blocks of that size by window hash, each a scan of the documents with the same code. Items of fewer
words than a window are probed in the same pass as further keys of each position.

Defined results: null texts and texts without words have no windows and no hits. Very long texts are
scanned whole, their words held once. Repeated rows are judged one by one. Repeated item ids count once. An empty benchmark leaves every document
clean; an empty table gives no rows. Further columns are ignored by the report and kept by
``clean_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, read_table, row_key, staged

WINDOW = 10
#: Distinct windows that may be broadcast: some 200 bytes each.
MAX_WINDOWS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Stands for a document itself beside its windows.
SELF = 0


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """len, hash, gram and item_ids of each distinct window."""
    size = F.size("words")
    n = F.least(F.lit(window), size)
    return staged(
        benchmark.select("item_id", words(F.col("text")).alias("words"))
        .where(size > 0)
        .select("item_id", n.alias("len"), F.explode(F.sequence(F.lit(1), size - n + 1)).alias("at"), "words")
        .select("item_id", "len", F.slice("words", F.col("at"), F.col("len")).alias("gram"))
        .groupBy("len", "gram")
        .agg(F.collect_set("item_id").alias("item_ids"))
        .select("len", F.xxhash64(F.transform("gram", lambda w: F.xxhash64(w))).alias("hash"), "gram", "item_ids"),
        "benchmark-windows",
    )


def window_hits(docs: DataFrame, found: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without text, with n_words: one row with at 0 for each row of docs, and one for each hit, with
    the word it starts at (from 1), its len and item_ids."""
    kept = [c for c in docs.columns if c != "text"]
    lengths = sorted(r[0] for r in found.select("len").distinct().collect()) or [window]
    blocks = max(1, math.ceil(found.count() / max(1, max_windows)))
    if blocks > 1:  # every block is to see the same rows, generated row ids included
        docs = staged(docs, "decontaminate-rows")
    hashed = (
        docs.withColumn("__ek_words", words(F.col("text")))
        .drop("text")
        .withColumn("__ek_hashes", F.concat(F.array(F.lit(0).cast("long")), F.transform("__ek_words", lambda w: F.xxhash64(w))))
    )
    at = F.col("at")
    # the outer form keeps Catalyst from evaluating the array once more in a filter below
    exploded = hashed.select(*kept, "__ek_words", "__ek_hashes", F.posexplode_outer("__ek_hashes").alias("at", "__ek_one"))

    def key(n: int) -> Column:
        return F.when(at + n <= F.size("__ek_hashes"), F.xxhash64(F.slice("__ek_hashes", at + 1, F.lit(n))))

    if len(lengths) == 1:
        n = F.lit(lengths[0])
        probed = exploded.withColumn("__ek_key", F.when(at == 0, F.lit(SELF).cast("long")).otherwise(key(lengths[0])))
    else:
        n = F.col("__ek_probe.n")
        itself = F.array(F.struct(F.lit(0).alias("n"), F.lit(SELF).cast("long").alias("key")))
        probes = F.array(*[F.struct(F.lit(n).alias("n"), key(n).alias("key")) for n in lengths])
        probed = exploded.select(*kept, "__ek_words", "at", F.explode(F.when(at == 0, itself).otherwise(probes)).alias("__ek_probe")).withColumn("__ek_key", F.col("__ek_probe.key"))
    none = found.sparkSession.range(1).select(
        F.lit(SELF).cast("long").alias("b_hash"), F.lit(None).cast("int").alias("b_len"), F.lit(None).cast("array<string>").alias("b_gram"), F.lit(None).cast(found.schema["item_ids"].dataType).alias("item_ids")
    )
    # slice stops at the end of the words, so a gram of another length never fits by accident
    same = F.when(at == 0, F.col("b_gram").isNull()).otherwise((n == F.col("b_len")) & (F.slice("__ek_words", at, n) == F.col("b_gram")))
    out = None
    for block in range(blocks):
        build = found.where(F.pmod("hash", F.lit(blocks)) == block).select(F.col("hash").alias("b_hash"), F.col("len").alias("b_len"), F.col("gram").alias("b_gram"), "item_ids")
        build = build.unionByName(none) if block == 0 else build
        hits = probed.join(F.broadcast(build), (F.col("__ek_key") == F.col("b_hash")) & same).select(
            *kept, F.size("__ek_words").cast("long").alias("n_words"), "at", F.coalesce("b_len", F.lit(0)).alias("len"), "item_ids"
        )
        out = hits if out is None else out.unionByName(hits)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of docs."""
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    hits = window_hits(rows, benchmark_windows(benchmark, window), window, max_windows)
    per_row = hits.groupBy("rid", "doc_id", "n_words").agg(
        F.collect_set(F.when(F.col("at") > 0, F.struct("at", (F.col("at") + F.col("len")).alias("end")))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate(
        F.array_sort("spans"),
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["upto"], s["at"]))).cast("long").alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return per_row.select(
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs without the rows in which a benchmark window occurs."""
    found = benchmark_windows(benchmark, window)
    leaks = window_hits(docs.select("text", *row_key(docs)), found, window, max_windows).where(F.col("at") > 0).select("__ek_id", "__ek_text").distinct()
    # a file, so that its size decides whether it is broadcast or texts are shuffled
    leaks = staged(leaks, "decontaminate-leaks")
    ident, text = row_key(docs)
    here = docs.select("*", ident.alias("__ek_d_id"), text.alias("__ek_d_text"))
    return here.join(leaks, (F.col("__ek_d_text") == F.col("__ek_text")) & F.col("__ek_d_id").eqNullSafe(F.col("__ek_id")), "left_anti").select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH norm AS (
  SELECT doc_id, row_number() OVER () AS rid,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), items AS (
  SELECT item_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), wins AS (
  SELECT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM wins),
dwins AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM norm, lens WHERE len(w) >= n)
), hits AS (
  SELECT rid, d.i, d.n, item_id FROM dwins d JOIN wins b ON d.n = b.n AND d.gram = b.gram
), cover AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS s FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM norm LEFT JOIN cover USING (rid) LEFT JOIN found USING (rid)
"""
