"""Mixing sources to target weights by capped water-filling.

Each source asks for words in proportion to its weight, but may supply at most ``max_epochs``
times its own size; the excess of clamped sources is shared again by weight until no source is
above its cap. The fixed point has one water level: target = min(cap, weight * level). Sorting
the sources by cap / weight and running sums find that level in one pass over the small table of
sources.

A source whose target is r times its size repeats every document floor(r) times, and gives one
more copy to the documents that come first in a seeded hash order, up to the fractional rest.
The order hashes id and text, so documents that share an id are spread too. Sums over the
first bits of the hash and then over the next ones find the hash at which each source's extra copies end; only
rows that are equal in id and text share one, and of those as many get the copy as are due, in the order
of their row numbers. No step gathers a source, a bucket or a group of equal rows in one task, and
applying the decision is a map-side comparison.

Defined results: null text has size 0; null source is a source of its own, ranked last; sources of
size 0 get target 0; null ids hash as one value, and rows that share id and text are told apart by
row numbers, so a source's taken words end within half a document of its target whatever repeats. Very long texts
are counted in one pass without a list of their words. An empty table gives no rows. Further
columns are ignored by the sizes and kept by ``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Bits of the hash order, and by how many of them its sums are taken at once.
HASH_BITS = 60
BUCKET_BITS = 12
#: Of monotonically_increasing_id, the bits that number rows inside one partition.
ROW_BITS = 33

SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Runs of other characters than space and 09-0D: each run, with the spaces behind it, becomes one character."""
    ahead = F.ltrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.octet_length(F.regexp_replace(ahead, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "w")).cast("long")


def order_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A seeded 60-bit position, from MD5 so that any engine can repeat it."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    return docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        order_key(F.col("doc_id"), F.col("text"), seed).alias("h"),
        F.monotonically_increasing_id().alias("rid"),
    )


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources: source, source_size. Adds target, whole (full repeats) and part (words of the extra copy).

    One row for each source passes through single-task windows here.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1).alias("weight"),
        (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"),
    ).withColumn("fills_at", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("fills_at", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    levelled = weighed.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(onward),
    )
    # the first source that its level doesn't fill decides
    chosen = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(every)
    target = F.least(F.col("cap"), F.col("weight") * chosen["level"])
    return (
        levelled.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))
        .withColumn(
            "whole",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"),
        )
        .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    )


def _before_cut(parts: DataFrame, by: str) -> DataFrame:
    """parts: source, ``by``, words and left (words still due). The part of each source in which the words run out, and what is left there."""
    running = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    return (
        parts.withColumn("upto", F.sum("words").over(running))
        .where(F.col("upto") > F.col("left"))
        .groupBy("source")
        .agg(F.min(F.struct(by, (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"))).alias("c"))
        .select("source", f"c.{by}", "c.left")
    )


def _joined(rows: DataFrame, cut: DataFrame, *also: str) -> DataFrame:
    """rows with the columns of cut, on source and ``also``."""
    on = F.col("source").eqNullSafe(F.col("__ek_source"))
    for name in also:
        on = on & (F.col(name) == F.col(f"__ek_{name}"))
    renamed = cut.withColumnsRenamed({c: f"__ek_{c}" for c in ("source", *also)})
    return rows.join(renamed, on).drop("__ek_source", *[f"__ek_{c}" for c in also])


def plan_mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """One row for each source: its size, target, whole repeats, the hash at which extra copies end
    (cut_h) and how many rows of that hash still get one (cut_rows)."""
    first = F.shiftright("h", HASH_BITS - bucket_bits)
    second = F.shiftright("h", HASH_BITS - 2 * bucket_bits)
    buckets = staged(sizes.groupBy("source", first.alias("first")).agg(F.sum("size").alias("words")), "mix-buckets")
    targets = staged(water_fill(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs), "mix-targets")
    due = targets.select("source", F.col("part").alias("left"))
    cut = _before_cut(_joined(buckets, due), "first")
    inside = _joined(sizes.select("source", "size", "h", first.alias("first"), second.alias("second")), cut, "first")
    cut = _before_cut(inside.groupBy("source", "second").agg(F.sum("size").alias("words"), F.first("left").alias("left")), "second")
    inside = _joined(sizes.select("source", "size", "h", second.alias("second")), cut, "second")
    # one row for all copies of a document, so a window sees few; the sums of a bucket end in its last row at the latest
    here = inside.groupBy("source", "h").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("size").alias("size"), F.first("left").alias("left"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    # a document beyond whose middle the words run out gets no more
    each = here.withColumn("base", upto - F.col("words")).withColumn(
        "cut_rows", F.least(F.col("n"), F.greatest(F.lit(0), F.floor((2 * (F.col("left") - F.col("base")) + F.col("size")) / (2 * F.col("size")))))
    )
    ends = (
        each.where((F.col("size") > 0) & (F.col("cut_rows") < F.col("n")))
        .groupBy("source")
        .agg(F.min(F.struct("h", "cut_rows")).alias("c"))
        .select("source", F.col("c.h").alias("cut_h"), F.col("c.cut_rows").alias("cut_rows"))
    )
    later = cut.select("source", F.shiftleft(F.col("second") + 1, HASH_BITS - 2 * bucket_bits).alias("next_h"))
    ends = ends.withColumnsRenamed({"source": "e_source"})
    later = later.withColumnsRenamed({"source": "l_source"})
    return staged(
        targets.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left")
        .join(later, F.col("source").eqNullSafe(F.col("l_source")), "left")
        .select(
            "source", "source_size", "target", "whole",
            # nothing due beyond whole repeats: no hash is below 0
            F.coalesce("cut_h", "next_h", F.lit(0)).cast("long").alias("cut_h"),
            F.coalesce("cut_rows", F.lit(0)).cast("long").alias("cut_rows"),
        ),
        "mix-plan",
    )


def last_rows(tied: DataFrame, plan: DataFrame) -> DataFrame:
    """tied: source and rid of the rows at their source's cut_h. source and last: the rid of the last row that gets the extra copy.

    Rows are counted by the partition that numbered them; only the partition in which the count runs out is put in order.
    """
    rows = _joined(tied.select("source", "rid", F.shiftright("rid", ROW_BITS).alias("part")), plan.select("source", F.col("cut_rows").alias("left")))
    rows = rows.where(F.col("left") > 0)
    parts = rows.groupBy("source", "part", "left").agg(F.count("*").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    cut = parts.withColumn("before", running - F.col("words")).where((F.col("before") < F.col("left")) & (F.col("before") + F.col("words") >= F.col("left")))
    cut = cut.select("source", "part", (F.col("left") - F.col("before")).alias("nth"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("rid"))
    return (
        _joined(rows.select("source", "rid", "part"), cut, "part")
        .withColumn("place", place)
        .where(F.col("place") == F.col("nth"))
        .select("source", F.col("rid").alias("last"))
    )


def _with_plan(rows: DataFrame, plan: DataFrame, h: Column) -> DataFrame:
    """Adds __ek_source_size, __ek_target, __ek_whole, __ek_h, and __ek_side: -1, 0 or 1 before, at or beyond the source's cut."""
    p = plan.select(*[F.col(c).alias(f"__ek_{c}") for c in plan.columns])
    side = F.when(F.col("__ek_h") < F.col("__ek_cut_h"), -1).when(F.col("__ek_h") == F.col("__ek_cut_h"), 0).otherwise(1)
    return (
        rows.withColumn("__ek_h", h)
        .join(p, F.col("source").eqNullSafe(F.col("__ek_source")))
        .withColumn("__ek_side", side)
        .drop("__ek_source", "__ek_cut_h", "__ek_cut_rows", "__ek_h")
    )


def _extra_at_cut(tied: DataFrame, plan: DataFrame) -> DataFrame:
    """tied: rows at their source's cut, with rid as __ek_rid. Adds __ek_copies."""
    last = last_rows(tied.select("source", F.col("__ek_rid").alias("rid")), plan)
    last = last.select(F.col("source").alias("__ek_source"), F.col("last").alias("__ek_last"))
    extra = F.when(F.col("__ek_rid") <= F.col("__ek_last"), 1).otherwise(0)
    return tied.join(last, F.col("source").eqNullSafe(F.col("__ek_source")), "left").withColumn("__ek_copies", F.col("__ek_whole") + extra)


def _beside_cut(rows: DataFrame) -> DataFrame:
    extra = F.when(F.col("__ek_side") < 0, 1).otherwise(0)
    return rows.where(F.col("__ek_side") != 0).withColumn("__ek_copies", F.col("__ek_whole") + extra)


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sizes = staged(sized(docs), "mix-sizes")
    plan = plan_mix(sizes, **options)
    placed = _with_plan(sizes, plan, F.col("h")).withColumn("__ek_rid", F.col("rid"))
    tied = staged(placed.where(F.col("__ek_side") == 0), "mix-tied")
    out = ["doc_id", "size", F.col("__ek_source_size").alias("source_size"), F.col("__ek_target").alias("target"), (F.col("size") * F.col("__ek_copies")).alias("taken")]
    return _beside_cut(placed).select(*out).unionByName(_extra_at_cut(tied, plan).select(*out))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; the columns of docs and their order stay.

    Rows are decided where they are read, without a shuffle of texts; only those at a source's cut, one document
    and its exact copies, are staged first.
    """
    names = docs.columns
    plan = plan_mix(staged(sized(docs), "mix-sizes"), **options)
    placed = _with_plan(docs, plan, order_key(F.col("doc_id"), F.col("text")))
    tied = staged(placed.where(F.col("__ek_side") == 0).withColumn("__ek_rid", F.monotonically_increasing_id()), "mix-tied")

    def repeated(rows: DataFrame) -> DataFrame:
        copies = F.explode(F.array_repeat(F.lit(True), F.col("__ek_copies").cast("int")))
        return rows.where(F.col("__ek_copies") > 0).select(*names, copies.alias("__ek_copy")).select(*names)

    return repeated(_beside_cut(placed)).unionByName(repeated(_extra_at_cut(tied, plan)))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(read_table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT source, source_size, source_size * 3.0::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM totals
), levels AS (
  SELECT a.source, a.cap / a.weight AS fills_at,
         ((SELECT sum(source_size) FROM totals)::DOUBLE
            - coalesce((SELECT sum(b.cap) FROM weighed b WHERE b.cap / b.weight < a.cap / a.weight), 0))
           / (SELECT sum(b.weight) FROM weighed b WHERE b.cap / b.weight >= a.cap / a.weight) AS level
  FROM weighed a
), chosen AS (
  SELECT min_by(level, fills_at) AS level FROM levels WHERE level <= fills_at
), targets AS (
  SELECT source, source_size, least(cap, weight * level) AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, weight * level) / source_size) ELSE 0 END::BIGINT AS whole
  FROM weighed, chosen
), placed AS (
  SELECT s.*, t.source_size, t.target, t.whole,
         2 * sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) - s.size AS twice_middle
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN target - whole * source_size > 0
                              AND twice_middle <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
