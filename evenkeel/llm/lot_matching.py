"""Return lots matched to sold lots, best price first, by composed time chunks.

For one client and item, let S(r) be the units left in the r best lots. A shipped lot among them adds its units; a return of n
units makes S(r) max(S(r) - n, 0), whatever the other thresholds do, because returns take the best lots first. So any stretch of time
acts on S(r) as a max-plus map x -> max(x + a(r), b(r)): a is units shipped within the r best less units returned, b is what is left when the stretch starts
without stock. Both change at the stretch's own lots only, so the maps of all thresholds are held by its lots: their units, and what is left of each.

1. Events (lots when shipped, returns when they come back) of clients and items with a return are dealt over range partitions by client, item
   and time, so that one hot client and item spreads over many tasks. A group that lies inside a task is one chunk. A group at either end of the task may go
   on in the next one, and a group of over ``chunk_events`` events is cut: such a chunk is replayed from no stock, which gives what it leaves of each lot.
2. Lots of such chunks are put into blocks of ranks, again by a range partitioning. A tree of ``FAN`` chunks a node composes maps
   upwards and hands stocks downwards (a parallel prefix scan). Running sums over ranks are taken within a block and carried from block to
   block by the blocks' totals, so a node of any size is spread over its blocks. A chunk is handed only lots that its
   returns take from: those whose better lots run out, which shows where its map of these meets its floor.
3. Every chunk replays independently, from the stock at its start.

Each level handles every lot once, so the work grows as lots times the logarithm of chunks. What grows in one task is one row per chunk (its returns,
to number those of later chunks) or per block of one client and item, never rows of lots.

Defined results: rows without client, item, amount, shipping time, quantity or sale take no part, nor do amounts that aren't finite or quantities below one; a
null discount is none; a null line_no is left out of the checksum's text and ranks first. Repeated rows are lots of their own; rows that tie in all columns are
interchangeable, so the result is the same as a multiset. Sales that repeat an id give a lot each. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, staged

#: Events that a chunk holds at most; a task's share of all events is of this order too.
CHUNK_EVENTS = 100_000
#: Tasks over which events are dealt at most; beyond, tasks grow and chunks don't.
MAX_TASKS = 50_000
#: Children of a node of the tree.
FAN = 16
#: Stands for a null line_no, below all others.
NO_LINE = -(1 << 31) - 1

OWNER = ["client_id", "item_id"]
EVENT = ["day", "kind", "sale_id", "line_no", "q", "c", "d", "n"]
PIECE = ["return_no", "piece_no", "return_day", "return_sale_id", "lot_sale_id", "lot_line_no", "units", "lot_left", "refund_cents", "margin_cents"]
#: Best first: whole cents a unit, then 62 bits of its fraction (exact for quantities below 2^31), both negated; the last two tell rows apart that tie.
RANK = ["hi", "lo", "day", "sale_id", "line_no", "q", "c", "d", "at", "seq"]
RETURNED, SHIPPED, STOCK, NUMBER = 0, 1, -1, -2


def sold_lots(lines: DataFrame, sales: DataFrame) -> DataFrame:
    """client_id, item_id, sale_id, line_no, q, c, d, day shipped, and of returned lots back (the day) and n (units)."""
    bought = sales.where("client_id is not null and sale_id is not null").select("sale_id", "client_id")
    mark = F.crc32(F.concat_ws(":", F.col("sale_id").cast("string"), F.col("line_no").cast("string")))
    own = lines.where(
        "sale_id is not null and item_id is not null and amount is not null and shipped_at is not null and quantity >= 1 and abs(amount) < 1e13 and not isnan(amount)"
    ).select(
        "sale_id",
        F.coalesce(F.col("line_no").cast("bigint"), F.lit(NO_LINE)).alias("line_no"),
        "item_id",
        F.col("quantity").cast("bigint").alias("q"),
        F.floor(100 * F.col("amount") + 0.5).alias("c"),
        F.floor(100 * F.coalesce(F.col("discount"), F.lit(0.0)) + 0.5).alias("d"),
        F.unix_date(F.to_date("shipped_at")).cast("bigint").alias("day"),
        F.when(F.col("flag") == "returned", mark).alias("h"),
    )
    return own.join(bought.hint("merge"), "sale_id").select(
        *OWNER, "sale_id", "line_no", "q", "c", "d", "day", F.expr("day + 1 + h % 31").alias("back"), F.expr("1 + h % (q + 30)").alias("n")
    )


def lot_events(lots: DataFrame, lots_back: DataFrame) -> DataFrame:
    """One row per shipped lot and one per return, of owners with a return; lots_back is lots cut down to returned ones."""
    owners = staged(lots_back.select(*OWNER).distinct(), "owners")
    shipped = F.struct(F.col("day"), F.lit(SHIPPED).cast("bigint").alias("kind"), F.lit(0).cast("bigint").alias("n"))
    came_back = F.struct(F.col("back").alias("day"), F.lit(RETURNED).cast("bigint").alias("kind"), F.col("n"))
    return (
        lots.join(owners.hint("shuffle_hash"), OWNER, "left_semi")
        .withColumn("event", F.explode(F.when(F.col("back").isNull(), F.array(shipped)).otherwise(F.array(shipped, came_back))))
        .select(*OWNER, "event.day", "event.kind", "sale_id", "line_no", "q", "c", "d", "event.n")
    )


def _rank(q: int, c: int) -> tuple[int, int]:
    return -(c // q), -(((c % q) << 62) // q)


def replay(events: list[tuple], stock: list[list], number: int) -> tuple[list[tuple], list[list], int]:
    """Pieces of the returns among events, the lots shipped in them as [key, left], and the last return's number.

    events are (day, kind, sale_id, line_no, q, c, d, n) in order, stock a heap of [key, left]; number counts earlier returns.
    """
    pieces, shipped = [], []
    for day, kind, sale, line, q, c, d, n in events:
        if kind == SHIPPED:
            lot = [(*_rank(q, c), day, sale, line, q, c, d), q]
            shipped.append(lot)
            heappush(stock, lot)
            continue
        number += 1
        done = piece = paid = 0
        while done < n:
            piece += 1
            if not stock:
                refund = n * c * (100 - d) // (100 * q) - paid
                pieces.append((number, piece, day, sale, None, None, n - done, None, refund, None))
                break
            lot = stock[0]
            key, left = lot
            take = min(n - done, left)
            size, cents = key[5], key[6]
            cost = (size - left + take) * cents // size - (size - left) * cents // size
            done += take
            refund = done * c * (100 - d) // (100 * q) - paid
            paid += refund
            lot[1] = left - take  # the least of the heap stays the least
            if not lot[1]:
                heappop(stock)
            pieces.append((number, piece, day, sale, key[3], key[4], take, lot[1], refund, refund - cost))
    return pieces, shipped, number


BASE = [*OWNER, *EVENT]
CHUNK = [*BASE, "pid", "cut", "seq", "split", "hi", "lo", "left"]


def chunked(events: DataFrame, chunk_events: int, parts: int) -> DataFrame:
    """events by chunk (pid, cut) with their place in it; split where the chunk may not hold its whole group, and then
    with each lot's rank and what the chunk leaves of it when it starts without stock."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        seen = 0

        def emit(part: pa.Table, cut: int, split: bool) -> Iterator[pa.RecordBatch]:
            nonlocal seen
            n = part.num_rows
            same = lambda v: pa.array(np.full(n, v, np.int64))
            own = [same(pid), same(cut), pa.array(np.arange(seen, seen + n)), same(int(split))]
            seen += n
            if split:
                shipped = iter(replay(list(zip(*[c.to_pylist() for c in part.columns[2:]])), [], 0)[1])
                lots = [(*lot[0][:2], lot[1]) if lot else (None, None, None) for lot in (next(shipped) if k == SHIPPED else None for k in part.column(3).to_pylist())]
                own += [pa.array(c, pa.int64()) for c in zip(*lots)]
            else:
                own += [pa.nulls(n, pa.int64())] * 3
            yield from pa.Table.from_arrays([*part.columns, *own], CHUNK).to_batches(max_chunksize=10_000)

        owner, outer, cut = None, True, 0  # the group at hand, whether it is the task's first, and its chunks so far
        held: list[pa.RecordBatch] = []

        def close(last: bool) -> Iterator[pa.RecordBatch]:
            if held:
                yield from emit(pa.Table.from_batches(held), cut, outer or last or cut > 0)

        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(1)])
            ends = np.r_[starts[1:], len(names)]
            k = 0
            while k < len(starts):
                lo, hi = int(starts[k]), int(ends[k])
                if tuple(names[lo]) != owner:
                    yield from close(False)
                    held, cut, outer, owner = [], 0, owner is None, tuple(names[lo])
                    # small groups that begin and end inside the batch go on as they are, in one piece
                    small = np.flatnonzero(ends[k:-1] - starts[k:-1] > chunk_events)
                    upto = k + (int(small[0]) if len(small) else len(starts) - 1 - k)
                    if not outer and upto > k:
                        yield from emit(pa.Table.from_batches([batch.slice(lo, int(ends[upto - 1]) - lo)]), 0, False)
                        k, owner = upto, ()
                        continue
                while lo < hi:
                    room = chunk_events - sum(b.num_rows for b in held)
                    if room <= 0:
                        yield from emit(pa.Table.from_batches(held), cut, True)
                        held, cut, room = [], cut + 1, chunk_events
                    held.append(batch.slice(lo, min(room, hi - lo)))
                    lo += min(room, hi - lo)
                k += 1
        yield from close(True)

    return (
        events.select(*BASE)
        .repartitionByRange(parts, *BASE)
        .sortWithinPartitions(*BASE)
        .mapInArrow(scan, ", ".join(f"{k} bigint" for k in CHUNK))
    )


def _composed(rows: DataFrame, returned: DataFrame) -> tuple[DataFrame, list[Column], list[Column]]:
    """Units in the r best lots before child 0, 1, ... and after the last one, for r with and without each row's own lot.

    rows have stock (at the node's start), came and left (of a child's lots); a node has FAN children. The totals of the blocks before
    come as a row of their own, the first of its block, so that one running sum serves both.
    """
    node, cell = [*OWNER, "parent"], [*OWNER, "parent", "blk"]
    child = F.expr(f"node % {FAN}")
    zero = F.lit(0).cast("bigint")
    of = lambda j, c: F.when(F.col("child") == j, F.col(c)).otherwise(zero)
    sums = [F.col("stock"), *[of(j, c) for c in ("came", "left") for j in range(FAN)]]
    units = F.array(*[F.sum(F.when(child == j, F.col("units")).otherwise(zero)) for j in range(FAN)])
    totals = returned.groupBy(*OWNER, F.expr(f"node div {FAN}").alias("parent")).agg(units.alias("units"))
    earlier = Window.partitionBy(*node).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*cell).agg(*[F.sum(v).alias(f"s{k}") for k, v in enumerate(sums)])
    base = F.array(*[F.coalesce(F.sum(f"s{k}").over(earlier), zero) for k in range(len(sums))])
    heads = blocks.select(*cell, base.alias("base")).join(totals, node, "left")
    heads = heads.select(*cell, "base", F.coalesce("units", F.array(*[zero] * FAN)).alias("units"))
    # dealt by block before the sums are spelled out
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition(*cell)
    own = [F.coalesce(F.col("base")[k], v) for k, v in enumerate(sums)]
    up_to = Window.partitionBy(*cell).orderBy(F.col("base").isNull(), *RANK).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (
        dealt.select("*", *[v.alias(f"o{k}") for k, v in enumerate(own)])
        .select("*", *[F.sum(f"o{k}").over(up_to).alias(f"u{k}") for k in range(len(sums))], F.max("units").over(up_to).alias("_units"))
        .where(F.col("base").isNull())
        .withColumn("units", F.col("_units"))
    )

    def states(less: bool) -> list[Column]:
        at = lambda k: F.col(f"u{k}") - F.col(f"o{k}") if less else F.col(f"u{k}")
        found = [at(0)]
        for j in range(FAN):
            found.append(F.greatest(found[-1] + at(1 + j) - F.col("units")[j], at(1 + FAN + j)))
        return found

    return summed, states(False), states(True)


def _dealt(lots: DataFrame) -> DataFrame:
    return lots.withColumn("parent", F.expr(f"node div {FAN}")).withColumn("child", F.expr(f"cast(node % {FAN} as int)"))


def _up(lots: DataFrame, returned: DataFrame) -> DataFrame:
    """The maps of nodes from those of their children."""
    rows = _dealt(lots).withColumn("stock", F.lit(0).cast("bigint"))
    summed, own, less = _composed(rows, returned)
    return summed.select(*OWNER, "blk", *RANK, F.col("parent").alias("node"), "came", (own[FAN] - less[FAN]).alias("left"))


def _down(stock: DataFrame | None, lots: DataFrame, returned: DataFrame) -> DataFrame:
    """Lots in stock at the start of every child that it takes from, from those at the start of its parent."""
    nothing = F.lit(0).cast("bigint")
    rows = _dealt(lots).withColumn("stock", nothing)
    if stock is not None:
        kept = stock.withColumnRenamed("node", "parent").withColumn("child", F.lit(None).cast("int")).withColumn("came", nothing).withColumn("left", nothing)
        rows = rows.drop("node").unionByName(kept)
    else:
        rows = rows.drop("node")
    summed, own, less = _composed(rows, returned)
    # a child takes from a lot where its map of the better lots meets its floor, so that they run out
    short = [less[j + 1] > less[j] + F.col(f"u{1 + j}") - F.col(f"o{1 + j}") - F.col("units")[j] for j in range(FAN)]
    held = F.array(*[F.struct(F.lit(j).alias("child"), (own[j] - less[j]).alias("stock"), short[j].alias("short")) for j in range(FAN)])
    reached = F.filter(held, lambda h: (h.stock > 0) & h.short)
    return summed.select(*OWNER, "blk", *RANK, "parent", F.explode(reached).alias("h")).select(
        *OWNER, "blk", *RANK, (F.col("parent") * FAN + F.col("h.child")).alias("node"), "h.stock"
    )


def stock_at_start(lots: DataFrame, returned: DataFrame, nodes: int) -> DataFrame | None:
    """client_id, item_id, node, the lot's columns and stock of every lot that a chunk finds and takes from.

    lots: owner, blk, RANK, node (the chunk), came, left; returned: owner, node, units. Chunks are numbered below ``nodes``. None for one chunk.
    """
    levels = 0
    while FAN**levels < nodes:
        levels += 1
    maps, back = [lots], [returned]
    for _ in range(levels - 1):
        maps.append(staged(_up(maps[-1], back[-1]), "lot-maps"))
        back.append(back[-1].groupBy(*OWNER, F.expr(f"node div {FAN}").alias("node")).agg(F.sum("units").alias("units")))
    stock = None
    for level in reversed(range(levels)):
        stock = staged(_down(stock, maps[level], back[level]), "lot-stock")
    return stock


def _replayed(rows: DataFrame, parts: int) -> DataFrame:
    """Pieces of every chunk: rows are its number of earlier returns, its stock and its events."""
    columns, made = ["node", *OWNER, "seq", *EVENT], [*OWNER, *PIECE]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, number, stock, events = None, 0, [], []
        done: list[tuple] = []

        def close() -> None:
            heapify(stock)
            done.extend((*chunk[1:], *p) for p in replay(events, stock, number)[0])

        def emit() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(done), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done[i : i + 10_000])], made)
            done.clear()

        for batch in batches:
            for row in zip(*[column.to_pylist() for column in batch.columns]):
                if row[:3] != chunk:
                    if chunk is not None:
                        close()
                    chunk, number, stock, events = row[:3], 0, [], []
                kind, n = row[5], row[11]
                if kind == NUMBER:
                    number = n
                elif kind == STOCK:
                    day, _, sale, line, q, c, d = row[4:11]
                    stock.append([(*_rank(q, c), day, sale, line, q, c, d), n])
                else:
                    events.append(row[4:])
            if len(done) >= 10_000:
                yield from emit()
        if chunk is not None:
            close()
        yield from emit()

    # a node's rows are one task's share of all events at most, so nodes fill tasks evenly
    return (
        rows.select(*columns)
        .repartitionByRange(parts, "node")
        .sortWithinPartitions("node", *OWNER, "seq")
        .mapInArrow(scan, ", ".join(f"{k} bigint" for k in made))
    )


def match_returns(lots: DataFrame, lots_back: DataFrame, chunk_events: int = CHUNK_EVENTS) -> DataFrame:
    """One row per piece of every return; see sold_lots for the columns of lots and lots_back (its returned ones)."""
    spark = lots.sparkSession
    events = staged(lot_events(lots, lots_back), "lot-events")
    parts = max(spark.sparkContext.defaultParallelism, min(MAX_TASKS, events.count() // chunk_events + 1))
    found = staged(chunked(events, chunk_events, parts), "lot-chunks")
    ends = found.agg(F.max("pid").alias("pid"), F.max("cut").alias("cut")).first()
    cuts = 1 + (ends.cut or 0)
    found = found.withColumn("node", F.expr(f"pid * {cuts} + cut"))
    rows = found.select("node", *OWNER, "seq", *EVENT)
    split = found.where("split = 1")
    back = staged(split.where(F.col("kind") == RETURNED).groupBy(*OWNER, "node").agg(F.sum("n").alias("units"), F.count("*").alias("returns")), "lot-returns")
    ranked = staged(
        split.where(F.col("kind") == SHIPPED)
        .withColumn("at", F.col("node"))
        .select(*OWNER, *RANK, "node", F.col("q").alias("came"), "left")
        .repartitionByRange(parts, *OWNER, *RANK)
        .withColumn("blk", F.spark_partition_id()),
        "lot-ranks",
    )
    earlier = Window.partitionBy(*OWNER).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    number = back.select(*OWNER, "node", F.lit(NUMBER).alias("kind"), F.coalesce(F.sum("returns").over(earlier), F.lit(0)).alias("n"))
    rows = rows.unionByName(number.withColumn("seq", F.lit(-2)), allowMissingColumns=True)
    stock = stock_at_start(ranked, back.select(*OWNER, "node", "units"), (1 + (ends.pid or 0)) * cuts)
    if stock is not None:
        rows = rows.unionByName(
            stock.select(*OWNER, "node", "day", "sale_id", "line_no", "q", "c", "d", F.col("stock").alias("n"), F.lit(STOCK).alias("kind"), F.lit(-1).alias("seq")), allowMissingColumns=True
        )
    line = F.when(F.col("lot_line_no") != NO_LINE, F.col("lot_line_no")).alias("lot_line_no")
    return _replayed(rows, parts).select(*OWNER, *[line if k == "lot_line_no" else F.col(k) for k in PIECE])


def op13_return_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, sales = read_table(spark, sf_dir, "sale_lines"), read_table(spark, sf_dir, "sales")
    return match_returns(sold_lots(lines, sales), sold_lots(lines.where("flag = 'returned'"), sales))


#: The units in the r best lots are a walk reflected at zero: running sums of units shipped within them less units returned, less the least such sum so far where
#: it is negative. What a return takes from lot r is what it takes from the r best less what it takes from the r - 1 best. CRC-32 is spelled out byte by byte.
ORACLE_SQL = """
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), l AS (
    SELECT client_id, item_id, s.sale_id, coalesce(line_no, -2147483649)::BIGINT AS line_no, quantity::BIGINT AS q, floor(100 * amount + 0.5)::BIGINT AS c, floor(100 * coalesce(discount, 0) + 0.5)::BIGINT AS d,
           date_diff('day', DATE '1970-01-01', shipped_at::DATE) AS day, flag = 'returned' AS back, concat_ws(':', s.sale_id, line_no) AS mark, row_number() OVER () AS rid
    FROM sale_lines JOIN sales s USING (sale_id)
    WHERE client_id IS NOT NULL AND item_id IS NOT NULL AND amount IS NOT NULL AND shipped_at IS NOT NULL AND quantity >= 1 AND abs(amount) < 1e13 AND NOT isnan(amount)
), b AS (
    SELECT l.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(mark, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) AS h
    FROM l, crc WHERE coalesce(back, false)
), owners AS (
    SELECT DISTINCT client_id, item_id FROM b
), lots AS (
    SELECT l.*, row_number() OVER (PARTITION BY client_id, item_id ORDER BY c / q::DOUBLE DESC, day, sale_id, line_no, q, c, d, rid) AS r FROM l JOIN owners USING (client_id, item_id)
), events AS (
    SELECT client_id, item_id, day, 1 AS kind, sale_id, line_no, q, c, d, r, q AS step FROM lots
    UNION ALL SELECT client_id, item_id, day + 1 + h % 31, 0, sale_id, line_no, q, c, d, NULL, -(1 + h % (q + 30)) FROM b
), e AS (
    SELECT *, row_number() OVER (PARTITION BY client_id, item_id ORDER BY day, kind, sale_id, line_no, q, c, d, r) AS e FROM events
), returns AS (
    SELECT *, row_number() OVER (PARTITION BY client_id, item_id ORDER BY e) AS return_no FROM e WHERE kind = 0
), p AS (
    SELECT lots.client_id, lots.item_id, lots.r, e.e, e.kind, sum(CASE WHEN e.kind = 0 OR e.r <= lots.r THEN step ELSE 0 END) OVER (PARTITION BY lots.client_id, lots.item_id, lots.r ORDER BY e.e) AS p
    FROM lots JOIN e ON e.client_id = lots.client_id AND e.item_id = lots.item_id
), s AS (
    SELECT client_id, item_id, r, e, kind, p - least(0, min(p) OVER (PARTITION BY client_id, item_id, r ORDER BY e)) AS s FROM p
), u AS (
    SELECT client_id, item_id, r, e, kind, s, lag(s, 1, 0) OVER (PARTITION BY client_id, item_id, r ORDER BY e) - s AS gone FROM s
), k AS (
    SELECT client_id, item_id, r, e, gone - lag(gone, 1, 0) OVER w AS units, s - lag(s, 1, 0) OVER w AS lot_left FROM u WHERE kind = 0 WINDOW w AS (PARTITION BY client_id, item_id, e ORDER BY r)
), m AS (
    SELECT *, row_number() OVER w AS piece_no, sum(units) OVER w AS done FROM k WHERE units > 0 WINDOW w AS (PARTITION BY client_id, item_id, e ORDER BY r)
), pieces AS (
    SELECT m.client_id, m.item_id, x.return_no, m.piece_no, x.day, x.sale_id, l.sale_id AS lot_sale_id, l.line_no AS lot_line_no, m.units, m.lot_left,
           done * x.c * (100 - x.d) // (100 * x.q) - (done - units) * x.c * (100 - x.d) // (100 * x.q) AS refund,
           (l.q - m.lot_left) * l.c // l.q - (l.q - m.lot_left - units) * l.c // l.q AS cost
    FROM m JOIN returns x ON x.client_id = m.client_id AND x.item_id = m.item_id AND x.e = m.e JOIN lots l ON l.client_id = m.client_id AND l.item_id = m.item_id AND l.r = m.r
    UNION ALL
    SELECT x.client_id, x.item_id, x.return_no, coalesce(f.n, 0) + 1, x.day, x.sale_id, NULL, NULL, -x.step - coalesce(f.done, 0), NULL,
           -x.step * x.c * (100 - x.d) // (100 * x.q) - coalesce(f.done, 0) * x.c * (100 - x.d) // (100 * x.q), NULL
    FROM returns x LEFT JOIN (SELECT client_id, item_id, e, count(*) AS n, sum(units) AS done FROM m GROUP BY ALL) f ON f.client_id = x.client_id AND f.item_id = x.item_id AND f.e = x.e
    WHERE -x.step > coalesce(f.done, 0)
)
SELECT client_id, item_id, return_no, piece_no::BIGINT AS piece_no, day::BIGINT AS return_day, sale_id AS return_sale_id, lot_sale_id, nullif(lot_line_no, -2147483649) AS lot_line_no, units::BIGINT AS units,
       lot_left::BIGINT AS lot_left, refund::BIGINT AS refund_cents, (refund - cost)::BIGINT AS margin_cents
FROM pieces
"""
