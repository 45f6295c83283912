"""SimHash near-deduplication by anchor-point covering.

Fingerprints of 64 bits are linked at two or fewer differing bits. The anchors are the words of a
covering code: two binary Golay codes [23, 12, 7] on bits 0-22 and 23-45, each perfect with
covering radius 3, and any value on the other 18 bits. So each fingerprint has one home
anchor at distance h <= 6, and replicates to every anchor within h + 2. Of two linked fingerprints
let x be the one nearer to its home; y then lies within h(x) + 2 <= h(y) + 2 of that anchor, so
comparing the residents of each anchor with its visitors loses no pair. That is at most some 68
anchors a fingerprint, whatever the size of the corpus, over 2^24 anchors. At 3 * 10^10 distinct fingerprints
(100 TB) that is some 1,800 residents and 100,000 visitors an anchor, 3 * 10^15 comparisons of two words and
a shuffle of a third of the input. A Hamming code [15, 11] on 15 of the 18 free bits would make anchors
2,048 times as many but visits 2.6 times, and the shuffle as large as the input.

Only distinct fingerprints take part, so any number of copies costs one. An anchor with more
than ``cell`` residents is dealt into a grid of cells, each with a bounded share of its residents
and visitors. A cell hands on a spanning forest of its links, never all pairs of a group.
Components come from alternating large-star and small-star steps, each checkpointed.

Defined results: null and empty texts, and texts without words, have fingerprint zero and are
linked like any other. Very long texts are hashed whole, CHUNK shingles at a time. Repeated rows share fingerprint and component. component_id is the smallest
doc_id reachable; null ids rank last there. An empty table gives no rows. Further columns are ignored by
the report and kept by ``first_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, checkpointed, read_table, row_key, staged

SHINGLE = 3
SEED = 42
THRESHOLD = 2
BLOCK = 23
BLOCK_MASK = (1 << BLOCK) - 1
#: Generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the Golay code.
GOLAY = 0b110001110101
#: Residents of one cell.
CELL = 20_000
#: Shingles whose bits are summed at once.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The SimHash of a whole text: bit i is set where over half of the shingle hashes set it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + SHINGLE - 1]
        grams = zip(*(part[k:] for k in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [part]
        hashes = np.array([digest(join(g), SEED) for g in grams], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprint_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array((fingerprint(t.as_py()) for t in batch), type=pa.int64(), size=len(batch))


def fingerprints(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns and fp of every row; Python gets nothing but the text."""
    bounded_batches(docs.sparkSession)
    return docs.select(*keys, F.arrow_udf(_fingerprint_batches, "bigint")(F.col("text")).alias("fp"))


@cache
def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The syndrome of each single bit; for each syndrome the error patterns that lead to anchors
    at least distance + THRESHOLD, nearest first, and their weights (99 where there is none)."""
    bit, value = [], 1
    for _ in range(BLOCK):
        bit.append(value)
        value <<= 1
        if value & 0x800:
            value ^= GOLAY
    found: list[list[tuple[int, int]]] = [[] for _ in range(2048)]
    level = [(0, 0, 0)]
    for weight in range(6):
        for error, syndrome, _ in level:
            if not found[syndrome] or weight <= found[syndrome][0][0] + THRESHOLD:
                found[syndrome].append((weight, error))
        level = [(e | 1 << k, s ^ bit[k], k + 1) for e, s, at in level for k in range(at, BLOCK)]
    wide = max(map(len, found))
    errors = np.zeros((2048, wide), dtype=np.int64)
    weights = np.full((2048, wide), 99, dtype=np.int16)
    for s, patterns in enumerate(found):
        for k, (w, e) in enumerate(patterns):
            errors[s, k], weights[s, k] = e, w
    return np.array(bit, dtype=np.int64), errors, weights


def _syndrome(block: np.ndarray, bit: np.ndarray) -> np.ndarray:
    out = np.zeros_like(block)
    for k in range(BLOCK):
        out ^= np.where(block >> k & 1, bit[k], 0)
    return out


def anchors_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For int64 fingerprints: the row of each visit, its anchor, and whether that is the home."""
    bit, errors, weights = _code()
    a, b = fps & BLOCK_MASK, fps >> BLOCK & BLOCK_MASK
    sa, sb = _syndrome(a, bit), _syndrome(b, bit)
    total = weights[sa][:, :, None] + weights[sb][:, None, :]
    row, i, j = np.nonzero(total <= total[:, :1, :1] + THRESHOLD)
    anchor = (a[row] ^ errors[sa[row], i]) | (b[row] ^ errors[sb[row], j]) << BLOCK
    return row, anchor, (i == 0) & (j == 0)


def _visit_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fps = batch["fp"].to_numpy()
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            row, anchor, home = anchors_of(part)
            yield pd.DataFrame({"anchor": anchor, "home": home, "fp": part[row]})


def _forest(fp: np.ndarray, homes: int, of: list[tuple[int, int]]) -> None:
    """Adds to ``of`` the links of a spanning forest of one cell, whose first rows are its residents."""
    label = np.arange(len(fp))
    for h in range(homes):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[h]) <= THRESHOLD)
        labels, first = np.unique(label[near], return_index=True)
        if len(labels) > 1:
            of.extend((int(fp[h]), int(fp[near[k]])) for k in first if near[k] != h and label[near[k]] != label[h])
            merged = np.zeros(len(fp), dtype=bool)
            merged[labels] = True
            label[merged[label]] = labels[0]


def _link_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by cell, residents first; a cell may go over several batches."""
    rest: list[np.ndarray] = []

    def settle(rows: np.ndarray) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        change = np.flatnonzero((np.diff(rows[:, :3], axis=0) != 0).any(axis=1)) + 1
        starts = np.concatenate([[0], change])
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))
        lively = (rows[starts, 3] == 0) & (sizes > 1)
        for at, n in zip(starts[lively].tolist(), sizes[lively].tolist(), strict=True):
            cell = rows[at : at + n]
            homes = int((cell[:, 3] == 0).sum())
            _forest(cell[:, 4], homes, found)
        links = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": links.min(axis=1, initial=2**63 - 1), "b": links.max(axis=1, initial=-(2**63))})

    for batch in batches:
        rows = np.column_stack([batch[c].to_numpy(dtype=np.int64) for c in ("anchor", "part", "side", "visitor", "fp")])
        if not len(rows):
            continue
        differs = (rows[:, :3] != rows[-1, :3]).any(axis=1)
        last = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if rest and (last or (rest[0][0, :3] != rows[0, :3]).any()):
            same = int((~(rows[:, :3] == rest[0][0, :3]).all(axis=1)).argmax()) if last else 0
            yield settle(np.concatenate([*rest, rows[:same]]))
            rest, rows, last = [], rows[same:], last - same
        if last > 0:
            yield settle(rows[:last])
            rows = rows[last:]
        rest.append(rows)
    if rest:
        yield settle(np.concatenate(rest))


def links(distinct: DataFrame, cell: int = CELL) -> DataFrame:
    """distinct: fp. Pairs a < b of linked fingerprints that connect whatever is linked."""
    visits = distinct.select("fp").mapInPandas(_visit_batches, "anchor bigint, home boolean, fp bigint")
    # anchors with many residents; one row for each ``cell`` fingerprints at most
    homes = distinct.select("fp").mapInPandas(_home_batches, "anchor bigint")
    hot = homes.groupBy("anchor").count().where(F.col("count") > cell).select(F.col("anchor").alias("hot"), F.ceil(F.col("count") / cell).cast("int").alias("grid"))
    # a file, so that its size decides whether it is broadcast
    hot = staged(hot, "simhash-hot")
    side = F.coalesce(F.col("grid"), F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), side).cast("int")
    every = F.sequence(F.lit(0), side - 1)
    # a resident meets the visitors of every column of its row; each visitor is in one column of every row
    cells = F.when(
        F.col("home"),
        F.concat(F.transform(every, lambda c: F.struct(mine.alias("part"), c.alias("side"), F.lit(0).alias("visitor")))),
    ).otherwise(F.array().cast("array<struct<part:int,side:int,visitor:int>>"))
    visiting = F.transform(every, lambda r: F.struct(r.alias("part"), mine.alias("side"), F.lit(1).alias("visitor")))
    dealt = (
        visits.join(hot, F.col("anchor") == F.col("hot"), "left")
        .select("anchor", "fp", "home", "grid", F.explode(F.when(F.col("grid").isNull(), F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("side"), F.when(F.col("home"), 0).otherwise(1).alias("visitor")))).otherwise(F.concat(cells, visiting))).alias("cell"))
        .select("anchor", "cell.part", "cell.side", "cell.visitor", "fp")
    )
    return (
        dealt.repartition("anchor", "part", "side")
        .sortWithinPartitions("anchor", "part", "side", "visitor")
        .mapInPandas(_link_batches, "a bigint, b bigint")
        .where(F.col("a") < F.col("b"))
        .distinct()
    )


def _home_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bit, errors, _ = _code()
    for batch in batches:
        fps = batch["fp"].to_numpy()
        a, b = fps & BLOCK_MASK, fps >> BLOCK & BLOCK_MASK
        home = (a ^ errors[_syndrome(a, bit), 0]) | (b ^ errors[_syndrome(b, bit), 0]) << BLOCK
        yield pd.DataFrame({"anchor": home})


def components(pairs: DataFrame) -> DataFrame:
    """node, root of every node of the pairs a, b; the root is the least node of the component."""
    state = checkpointed(pairs.select("a", "b"))
    seen = None
    while True:
        both = state.union(state.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).withColumnRenamed("u", "w")
        large = both.join(least, F.col("u") == F.col("w")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        joined = large.join(down, F.col("u") == F.col("w"))
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("w", "m")).distinct()
        state = checkpointed(small.select(F.col("v").alias("a"), F.col("u").alias("b")))
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return state.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now


def component_ids(prints: DataFrame, cell: int = CELL) -> DataFrame:
    """prints: doc_id, fp. fp, root and component_id of each distinct fingerprint; only the root tells components apart."""
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(distinct, cell))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    prints = staged(fingerprints(docs, "doc_id"), "simhash-prints")
    named = component_ids(prints, cell).withColumnRenamed("fp", "c_fp")
    return prints.join(named, F.col("fp") == F.col("c_fp")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_of_each(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id; the columns of docs stay.

    The rows that go are named by id and text hash and leave by an anti join. Where the smallest id
    itself has several rows, those with the least text hash stay as one. Components without any id,
    and unlinked ones that share their smallest id, are told apart by their roots.
    """
    keyed = docs.select("text", *row_key(docs), F.col("doc_id"))
    prints = staged(fingerprints(keyed, "doc_id", "__ek_id", "__ek_text"), "simhash-prints")
    named = component_ids(prints, cell).withColumnRenamed("fp", "c_fp")
    rows = staged(prints.join(named, F.col("fp") == F.col("c_fp")).select("__ek_id", "__ek_text", "root", "component_id"), "simhash-rows")
    first = rows.where(F.col("__ek_id").eqNullSafe(F.col("component_id"))).groupBy("root", "component_id").agg(F.min("__ek_text").alias("f_text"), F.count("*").alias("n"))
    first = staged(first, "simhash-first")
    f = first.select(F.col("root").alias("f_root"), F.col("component_id").alias("f_id"), "f_text")
    # files, so that their size decides whether they are broadcast or texts are shuffled
    goes = staged(
        rows.join(f, F.col("root") == F.col("f_root"))
        .where(~(F.col("__ek_id").eqNullSafe(F.col("f_id")) & (F.col("__ek_text") == F.col("f_text"))))
        .select("__ek_id", "__ek_text")
        .distinct(),
        "simhash-goes",
    )
    ident, text = row_key(docs)
    here = docs.select("*", ident.alias("__ek_d_id"), text.alias("__ek_d_text"))
    same = (F.col("__ek_d_text") == F.col("__ek_text")) & F.col("__ek_d_id").eqNullSafe(F.col("__ek_id"))
    kept = here.join(goes, same, "left_anti")
    again = staged(first.where(F.col("n") > 1).select(F.col("component_id").alias("__ek_id"), F.col("f_text").alias("__ek_text")), "simhash-again")
    once = kept.join(again, same, "left_semi").dropDuplicates(["__ek_d_id", "__ek_d_text"])
    return kept.join(again, same, "left_anti").unionByName(once).select(*docs.columns)


def op6_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
