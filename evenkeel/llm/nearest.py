"""Approximate nearest neighbours over shifted Hilbert orderings of projected vectors.

Equal vectors are one entry of the index, which keeps the smallest ids of its copies: a vector that a third of all rows share costs no more than one.
Each of ``ORDERINGS`` orderings projects the entries by its own seeded orthonormal directions, shifts them, and puts them on a Hilbert curve. Spark range-partitions all entries by
ordering and key, and positions follow from the partitions' sizes. A query looks at the entries of its own window, up to ``width`` positions either side, in every ordering: it is sent to
the blocks that its windows touch, each block scores its own rows in double precision and gives back its best few, and these are merged.

The width is fitted: for a bounded sample of entries the true neighbours are found by brute force over all entries, and the width is the smallest by which ``RECALL``
of these pairs are met in some ordering. So recall holds at every size, at the price that the data ask: vectors with structure are met in narrow windows, while vectors spread evenly over a
sphere (as in the given tables) need wide ones. Directions, scales and shifts are fitted on a bounded sample too; every entry is indexed.

Defined results: null vectors, zero vectors, those with null or non-finite components and rows without an id take no part; nor do vectors of another length than the commonest (the
longest of equally common ones), as no distance to the others is defined. Rows that repeat a vector are all candidates; a row isn't its own neighbour, but other rows of its
id are. Ties in distance go to the smaller vec_id. With fewer than ``k`` candidates all are returned. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, read_table, staged

#: Orderings, directions of each, bits of each direction.
ORDERINGS, DIRECTIONS, BITS = 8, 8, 7
#: Rows on which centre and scales are fitted, and those whose true neighbours fit the width. Both are expected sizes of samples by hash, cut at twice that.
FIT_ROWS, FIT_QUERIES = 4096, 128
#: Share of the true neighbours of the sample that the windows must hold.
RECALL = 0.97
#: Entries of a block.
BLOCK = 4096
SEED = 20240613


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )
    common = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("embedding") == (common["size"] if common else 0))


def entries_of(rows: DataFrame, asked: Column, k: int) -> DataFrame:
    """entry, embedding, ids (the k + 1 smallest of the rows that share it) and asked (whether a query does)."""
    copies = Window.partitionBy("embedding", "asked").orderBy("vec_id")
    few = rows.withColumn("asked", asked).withColumn("nth", F.row_number().over(copies)).where(F.col("nth") <= k + 1)
    return staged(
        few.groupBy("embedding")
        .agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked"))
        .withColumn("entry", F.monotonically_increasing_id()),
        "entries",
    )


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each row's cell on the Hilbert curve through the grid of 2**bits cells a side."""
    x = np.ascontiguousarray(cells.T).astype(np.int64)
    sides = len(x)
    # undo the curve's turns from the coarsest grid to the finest
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(sides):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
    # Gray code of the cells
    for i in range(1, sides):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(sides):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Orderings fitted on a sample: directions, centre, scale and shift of each."""

    def __init__(self, sample: np.ndarray, orderings: int = ORDERINGS):
        size = sample.shape[1]
        rng = np.random.default_rng(SEED)
        self.sides = min(DIRECTIONS, size)
        blocks = []
        while sum(b.shape[1] for b in blocks) < orderings * self.sides:
            blocks.append(np.linalg.qr(rng.standard_normal((size, size)))[0])
        self.directions = np.hstack(blocks)[:, : orderings * self.sides]
        seen = sample @ self.directions
        self.centre, self.scale = seen.mean(0), seen.std(0)
        self.scale[self.scale == 0] = 1
        self.shift = rng.uniform(-0.5, 0.5, len(self.scale))
        self.orderings = orderings

    def keys(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        # four deviations to either side; what lies beyond shares the outermost cells
        at = (((vectors @ self.directions - self.centre) / self.scale + self.shift) / 8 + 0.5) * (1 << BITS)
        cells = np.clip(at, 0, (1 << BITS) - 1).astype(np.int64)
        for t in range(self.orderings):
            yield hilbert_keys(cells[:, t * self.sides : (t + 1) * self.sides], BITS)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(queries: np.ndarray, rows: np.ndarray, allowed: np.ndarray, first: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its k nearest allowed rows and their distances, ties to the smaller first id."""
    near = (queries**2).sum(1)[:, None] + (rows**2).sum(1)[None] - 2 * (queries @ rows.T)
    slack = 1e-9 * (1 + np.abs(near).max(initial=0))
    near[~allowed] = np.inf
    for i, d in enumerate(near):
        found = np.flatnonzero(d < np.inf)
        if len(found) > k:
            found = found[d[found] <= np.partition(d[found], k - 1)[k - 1] + slack]
        exact = np.sqrt(((rows[found] - queries[i]) ** 2).sum(1))
        order = np.lexsort((first[found], exact))[:k]
        yield i, found[order], exact[order]


def _sample(entries: DataFrame, of: int, rows: int) -> list:
    keep = F.pmod(F.xxhash64("entry", F.lit(SEED)), F.lit(1 << 40)) < int(min(1.0, rows / max(of, 1)) * (1 << 40))
    return entries.where(keep).select("entry", "embedding").limit(2 * rows).collect()


def _index(entries: DataFrame, curves: Curves, parts: int) -> DataFrame:
    """ordering, pos (from 0 in each ordering), entry, first, asked and embedding, once for every ordering."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for t, keys in enumerate(curves.keys(_matrix(batch.column(3)))):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), *batch.columns], ["ordering", "key", "entry", "first", "asked", "embedding"])

    order = ["ordering", "key", "entry"]
    placed = staged(
        entries.select("entry", F.col("ids")[0].alias("first"), "asked", "embedding")
        .mapInArrow(key, "ordering int, key bigint, entry bigint, first bigint, asked boolean, embedding array<double>")
        .repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .drop("key")
        .withColumn("at", F.monotonically_increasing_id()),
        "curve",
    )
    # one row for each ordering in each partition
    runs = placed.groupBy("ordering", F.expr("shiftright(at, 33)").alias("pid")).agg(F.min("at").alias("from"), F.count("*").alias("n"))
    earlier = Window.partitionBy("ordering").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("ordering", "pid", "from", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return (
        placed.withColumn("pid", F.expr("shiftright(at, 33)"))
        .join(runs, ["ordering", "pid"])
        .select("ordering", F.expr("before + at - from").alias("pos"), "entry", "first", "asked", "embedding")
    )


def _fitted_width(entries: DataFrame, index: DataFrame, sample: list, k: int) -> int:
    """The smallest width by which RECALL of the sample's true neighbours are met."""
    names, points = np.array([r.entry for r in sample]), np.array([r.embedding for r in sample])

    def truth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy(zero_copy_only=False)
                found = [(int(names[i]), int(own[j]), float(s)) for i, rows, score in _best(points, _matrix(batch.column(1)), names[:, None] != own[None], own, k) for j, s in zip(rows, score)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["query", "entry", "score"])

    nearest = Window.partitionBy("query").orderBy("score", "entry")
    # FIT_QUERIES * 2 * k pairs at most
    pairs = (
        entries.select("entry", "embedding").mapInArrow(truth, "query bigint, entry bigint, score double").withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k)
    )
    pairs = staged(pairs.select("query", "entry"), "truth")
    place = index.select("ordering", "pos", "entry")
    met = (
        place.join(F.broadcast(pairs), "entry")
        .select("query", "entry", "ordering", "pos")
        .join(place.join(F.broadcast(pairs.select(F.col("query").alias("entry")).distinct()), "entry").select(F.col("entry").alias("query"), "ordering", F.col("pos").alias("own")), ["query", "ordering"])
        .groupBy("query", "entry")
        .agg(F.min(F.abs(F.col("pos") - F.col("own"))).alias("off"))
    )
    offs = np.sort([r.off for r in met.select("off").collect()])
    return max(k, int(offs[int(np.ceil(RECALL * len(offs))) - 1])) if len(offs) else k


def _searched(index: DataFrame, width: int, k: int, block: int) -> DataFrame:
    """query and entry, score: of every block that a query's window touches, its k nearest."""
    rows = index.select("ordering", F.expr(f"pos div {block}").alias("block"), F.lit(0).alias("side"), "pos", "entry", "first", "embedding")
    asked = index.where("asked").select(
        "ordering", F.explode(F.expr(f"sequence(greatest(pos - {width}, 0) div {block}, (pos + {width}) div {block})")).alias("block"), F.lit(1).alias("side"), "pos", "entry", "first", "embedding"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            cuts = np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(place)]):
                piece = batch.slice(lo, hi - lo)
                pos, entry, first = (piece.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
                vectors, here = _matrix(piece.column(6)), tuple(place[lo, :2])
                if place[lo, 2] == 0:
                    if here != at:
                        at, held = here, []
                    held.append((pos, entry, first, vectors))
                    continue
                if here != at or not held:  # the window ends beyond the last entry
                    continue
                if len(held) > 1:
                    held = [tuple(np.concatenate(c) for c in zip(*held))]
                own_pos, own, own_first, own_vectors = held[0]
                for i in range(0, len(pos), 256):
                    part = slice(i, i + 256)
                    allowed = (np.abs(pos[part, None] - own_pos[None]) <= width) & (entry[part, None] != own[None])
                    found = [(entry[part][q], own[r], own_first[r], s) for q, rows, scores in _best(vectors[part], own_vectors, allowed, own_first, k) for r, s in zip(rows, scores)]
                    if found:
                        a, b, c, d = (np.array(x) for x in zip(*found))
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), pa.array(d)], ["query", "entry", "first", "score"])

    return (
        rows.unionByName(asked)
        .repartition("ordering", "block")
        .sortWithinPartitions("ordering", "block", "side")
        .mapInArrow(score, "query bigint, entry bigint, first bigint, score double")
    )


def nearest(vectors: DataFrame, asked: Column, k: int = 10, orderings: int = ORDERINGS, block: int = BLOCK, width: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of every row where ``asked`` holds; width is fitted unless given."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors)
    entries = entries_of(rows, asked, k)
    count = entries.count()
    if not count:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    fit = _sample(entries, count, FIT_ROWS)
    curves = Curves(np.array([r.embedding for r in fit]) if fit else np.zeros((1, len(entries.first().embedding))), orderings)
    parts = max(spark.sparkContext.defaultParallelism, count * orderings // (16 * block) + 1)
    index = staged(_index(entries, curves, parts), "index")
    if width is None:
        width = _fitted_width(entries, index, _sample(entries, count, FIT_QUERIES), k)
    best = Window.partitionBy("query").orderBy("score", "first", "entry")
    # a query's neighbour counts once, however many orderings meet it
    found = (
        _searched(index, width, k, block)
        .groupBy("query", "entry", "first")
        .agg(F.min("score").alias("score"))
        .withColumn("nth", F.row_number().over(best))
        .where(F.col("nth") <= k)
        .join(entries.select("entry", "ids"), "entry")
        .groupBy("query")
        .agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    )
    # copies of the query's own vector are at distance zero
    kept = entries.where("asked").select("embedding", F.col("entry").alias("query"), F.struct(F.lit(0.0).alias("score"), "ids").alias("own")).join(found, "query", "left")
    kept = kept.select("embedding", F.flatten(F.transform(F.concat(F.array("own"), F.coalesce("found", F.array().cast("array<struct<score:double,ids:array<bigint>>>"))), lambda e: F.transform(e.ids, lambda i: F.struct(e.score.alias("score"), i.alias("vec_id"))))).alias("near"))
    kept = staged(kept.select("embedding", F.slice(F.array_sort("near"), 1, k + 1).alias("near")), "near")
    queries = rows.where(asked).join(kept.hint("merge"), "embedding")
    # without the query's own row, which is in the list only where its id is among the smallest
    mine = F.array_position("near", F.struct(F.lit(0.0).alias("score"), F.col("vec_id")))
    others = F.filter("near", lambda e, i: (i + 1 != F.col("mine")) & (i < k + F.when(F.col("mine") > 0, 1).otherwise(0)))
    return (
        queries.withColumn("mine", mine)
        .select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "e"))
        .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
    )


def op12_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
