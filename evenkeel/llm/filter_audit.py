"""Filter interaction audit over packed bitmaps.

Each partition keeps a NumPy bitset for every filter and every label, laid out by part: a part's rows
begin at a byte, so a part is a run of bytes. The rows that pass a set of filters are the AND-NOT of their
bitsets; its popcount by runs gives the counts of all parts at once. A partition emits one row for each of its
parts, with the counts of all subsets of the filters, and Spark sums these rows. Every prefix of every order is one of the
subsets, so all orders are read off the sums, and no row of documents is looked at twice.

``failures`` derives filters A to E from documents. Equal texts meet by digest only: the smallest doc_id of each digest is found with map-side
combining, staged, and joined back in a join that Spark may split.

Defined results: null text counts as empty, which fails A alone (and E where repeated); a null source is the part of the empty string; texts are
read whole, however long. A null doc_id neither fails E nor makes another row fail it, and has no labels; rows that share a doc_id don't
repeat each other, but repeat smaller ones. Of repeated labels one that says 1 is enough. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged

#: Of the query.
FILTERS = "ABCDE"
#: Parts whose counts a task holds before it emits them.
HELD_PARTS = 4096


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the booleans A to E (the row fails that filter), good and toxic of every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    thin = staged(
        docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"))
        .withColumn("words", words)
        .select(
            "doc_id",
            "part",
            F.unhex(F.sha2("text", 256)).alias("digest"),
            (F.size("words") < 50).alias("A"),
            (100 * F.size(F.array_distinct("words")) < 65 * F.size("words")).alias("B"),
            (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 5 * F.length("text")).alias("C"),
            F.col("text").rlike("[#$%&*|]").alias("D"),
        ),
        "audit",
    )
    first = staged(thin.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "audit-first")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    no = F.lit(False)
    return (
        thin.join(first.hint("merge"), "digest", "left")
        .join(marks, "doc_id", "left")
        .select("part", "A", "B", "C", "D", F.coalesce(F.col("doc_id") > F.col("first"), no).alias("E"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    )


def subset_counts(rows: DataFrame, filters: Sequence[str], outcomes: Sequence[str] = ()) -> DataFrame:
    """part, and arrays n and of each outcome: at s, how many rows fail none of the filters whose bits are set in s.

    ``filters`` and ``outcomes`` name boolean columns of rows without nulls; the bit of a filter is its place.
    """
    width, kinds = 1 << len(filters), 1 + len(outcomes)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def emit() -> pa.RecordBatch:
            flat = pa.array([v.ravel() for v in held.values()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), flat], ["part", "counts"])

        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            sizes = np.bincount(code, minlength=len(names))
            runs = (sizes + 7) // 8
            byte = np.cumsum(runs) - runs
            place = np.arange(len(code)) + np.repeat(8 * byte - (np.cumsum(sizes) - sizes), sizes)

            def bitset(column: np.ndarray) -> np.ndarray:
                flat = np.zeros(8 * int(runs.sum()), bool)
                flat[place] = column[order]
                return np.packbits(flat)

            columns = [bitset(batch.column(i + 1).to_numpy(zero_copy_only=False).astype(bool)) for i in range(len(filters) + len(outcomes))]
            fails, marks = columns[: len(filters)], columns[len(filters) :]
            passed = [bitset(np.ones(len(code), bool))]
            for s in range(1, width):
                bit = s.bit_length() - 1
                passed.append(passed[s ^ (1 << bit)] & ~fails[bit])
            counts = np.stack([[np.add.reduceat(np.bitwise_count(p if m is None else p & m), byte, dtype=np.int64) for p in passed] for m in (None, *marks)])
            for i, name in enumerate(names):
                held[name] = held.get(name, 0) + counts[:, :, i]
            if len(held) > HELD_PARTS:
                yield emit()
                held.clear()
        if held:
            yield emit()

    by_task = rows.select("part", *filters, *outcomes).mapInArrow(packed, "part string, counts array<bigint>")
    summed = by_task.groupBy("part").agg(*[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(kinds * width)])
    return summed.select("part", *[F.array(*[f"c{k * width + s}" for s in range(width)]).alias(name) for k, name in enumerate(("n", *outcomes))])


def prefix_audit(rows: DataFrame, filters: str, outcomes: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of the filters and step; filters are letters that name boolean columns of rows.

    filter, kept, removed, redundant, unique_fails, shapley and <outcome>_lost of each outcome.
    """
    size, full = len(filters), (1 << len(filters)) - 1
    bit = {f: 1 << i for i, f in enumerate(filters)}

    def shapley(f: str):
        without = [s for s in range(full + 1) if not s & bit[f]]
        return sum(factorial(s.bit_count()) * factorial(size - 1 - s.bit_count()) * (F.col("n")[s] - F.col("n")[s | bit[f]]) for s in without)

    counts = subset_counts(rows, filters, outcomes).withColumn("shares", F.array(*[shapley(f) for f in filters]))
    # the orders are a constant of the filters, the same for every part
    steps = (
        counts.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(filters)])))
        .withColumn("step", F.explode(F.array(*[F.lit(k + 1) for k in range(size)])))
        .withColumn("filter", F.expr("substring(filter_order, step, 1)"))
        .withColumn("at", F.instr(F.lit(filters), F.col("filter")) - 1)
        .withColumn("bit", F.expr("shiftleft(1, at)"))
        .withColumn("before", sum(F.when(F.instr("filter_order", f) < F.col("step"), b).otherwise(0) for f, b in bit.items()))
        .withColumn("after", F.expr("before | bit"))
    )
    removed = F.expr("n[before] - n[after]")
    return steps.select(
        "part",
        "filter_order",
        "step",
        "filter",
        F.expr("n[after]").alias("kept"),
        removed.alias("removed"),
        (F.expr("n[0] - n[bit]") - removed).alias("redundant"),
        F.expr(f"n[{full} ^ bit] - n[{full}]").alias("unique_fails"),
        *[F.expr(f"{o}[before] - {o}[after]").alias(f"{o}_lost") for o in outcomes],
        F.expr("shares[at]").alias("shapley"),
    )


def op11_filter_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = failures(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return prefix_audit(rows, FILTERS, ("good", "toxic"))


ORACLE_SQL = r"""
WITH marks AS (
    SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), t AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
    FROM documents
), d AS (
    SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text),
            regexp_matches(text, '[#$%&*|]'), coalesce(t.doc_id > first, false)] AS fails
    FROM t LEFT JOIN marks USING (doc_id)
), g AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY 1, 2
), letters AS (
    SELECT unnest([1, 2, 3, 4, 5]) AS i
), orders AS (
    SELECT [a.i, b.i, c.i, d.i, e.i] AS o
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), s AS (
    SELECT o, i AS step, o[i] AS f, o[1:i - 1] AS earlier FROM orders, letters
), r AS (
    SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, step, substr('ABCDE', f, 1) AS filter,
           sum(CASE WHEN NOT gone AND NOT fails[f] THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN NOT gone AND fails[f] THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN gone AND fails[f] THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails[f] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN NOT gone AND fails[f] THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN NOT gone AND fails[f] THEN toxic ELSE 0 END) AS toxic_lost
    FROM (SELECT *, len(list_filter(earlier, lambda x: fails[x])) > 0 AS gone FROM g, s)
    GROUP BY part, o, step, f
)
SELECT part, filter_order, step::int AS step, filter, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
       good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::bigint AS shapley
FROM r
"""
