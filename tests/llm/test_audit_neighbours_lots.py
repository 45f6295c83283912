"""Filter audit against counting order by order, neighbours against brute force, returned lots against a plain replay."""

import datetime as dt
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from evenkeel.llm import filter_audit, lot_matching, nearest

SF = "/root/testdata/sf0.001"


# filter audit


def naive_audit(docs, labels, filters="ABCDE"):
    """Counts each step of each order over all rows."""
    text = {}
    for d in docs:
        if d["doc_id"] is not None:
            t = d["text"] or ""
            text[t] = min(text.get(t, d["doc_id"]), d["doc_id"])
    rows = []
    for d in docs:
        t = d["text"] or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": d["doc_id"] is not None and t in text and d["doc_id"] > text[t],
        }
        own = [x for x in labels if d["doc_id"] is not None and x[0] == d["doc_id"]]
        rows.append((d["source"] or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        share = defaultdict(int)
        for order in permutations(filters):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                share[f] += len(gone)
                out[part, "".join(order), step] = (
                    f,
                    len(left),
                    len(gone),
                    sum(r[1][f] for r in mine) - len(gone),
                    sum(r[1][f] and sum(r[1].values()) == 1 for r in mine),
                    sum(r[2] for r in gone),
                    sum(r[3] for r in gone),
                )
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v, share[v[0]])
    return out


def audited(docs, labels):
    made = filter_audit.prefix_audit(filter_audit.failures(docs, labels), "ABCDE", ("good", "toxic")).collect()
    names = ["filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in made}


def test_audit_of_messy_rows(spark, messy):
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 1), (6, 1, None), (9, 0, 1), (None, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert audited(messy, table) == naive_audit(messy.collect(), labels)


def test_audit_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audited(nothing, labels) == {}


def test_bitmaps_of_many_parts_and_odd_sizes(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 5)
    rng = random.Random(5)
    rows = [(f"p{rng.randint(0, 30)}", *[rng.random() < 0.4 for _ in range(4)]) for _ in range(900)]
    made = filter_audit.subset_counts(spark.createDataFrame(rows, "part string, x boolean, y boolean, z boolean, good boolean").repartition(3), "xyz", ["good"])
    for r in made.collect():
        mine = [q for q in rows if q[0] == r["part"]]
        for s in range(8):
            alive = [q for q in mine if not any(q[1 + i] for i in range(3) if s >> i & 1)]
            assert (r["n"][s], r["good"][s]) == (len(alive), sum(q[4] for q in alive))


# neighbours


def naive_neighbours(rows, k, asked=lambda i: i % 100 == 0):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for at, (i, v) in enumerate(ok):
        if asked(i):
            near = sorted((math.sqrt(float(((v - w) ** 2).sum())), j) for other, (j, w) in enumerate(ok) if other != at)
            out.setdefault(i, []).append(near[:k])
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


def test_neighbours_of_few_rows_are_exact(spark):
    rng = np.random.default_rng(1)
    same = rng.standard_normal(6).round(3).tolist()
    rows = [(int(i), rng.standard_normal(6).round(3).tolist()) for i in range(150)] + [(1000 + i, same) for i in range(40)]
    rows += [(300, None), (400, [0.0] * 6), (500, [1.0, None] + [0.0] * 4), (600, [math.nan] + [1.0] * 5), (700, [math.inf] + [1.0] * 5), (None, same), (800, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("entry", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3)
    got = found(nearest.nearest(df, F.col("vec_id") % 100 == 0, width=500, block=16))
    want = naive_neighbours([r for r in rows if r[1] is None or len(r[1]) == 6], 10)
    assert set(got) == set(want) == {0, 100, 1000}
    for i, (near,) in want.items():
        assert [j for _, j in got[i]] == [j for _, j in near]
        assert np.allclose([s for s, _ in got[i]], [s for s, _ in near], atol=1e-12)


def test_fewer_candidates_than_asked_and_none(spark):
    kind = "vec_id bigint, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], kind)
    assert [j for _, j in found(nearest.nearest(df, F.col("vec_id") == 0))[0]] == [2, 1]
    assert nearest.nearest(spark.createDataFrame([], kind), F.col("vec_id") == 0).count() == 0
    assert nearest.nearest(spark.createDataFrame([(0, [0.0, 0.0])], kind), F.col("vec_id") == 0).count() == 0
    assert nearest.nearest(spark.createDataFrame([(0, [2.0])], kind), F.col("vec_id") == 0).count() == 0


def test_hilbert_curve_moves_one_cell_at_a_time():
    for sides, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * sides), axis=-1).reshape(-1, sides)
        keys = nearest.hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(len(cells)))
        path = cells[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_given_vectors(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = found(nearest.op12_hilbert_neighbours(spark, f"/root/testdata/{sf}"))
    want = naive_neighbours([(r["vec_id"], r["embedding"]) for r in df.collect()], 10)
    assert set(got) == set(want)
    hits = sum(len({j for _, j in got[i]} & {j for _, j in near}) for i, (near,) in want.items())
    assert hits >= 0.9 * 10 * len(want)
    for near in got.values():
        assert near == sorted(near) and len(near) == 10


# lots


def naive_lots(lines, sales):
    """The contract read plainly: every return walks over the group's lots in order of price."""
    client = defaultdict(list)
    for s, c in sales:
        client[s].append(c)
    groups = defaultdict(list)
    for sale, line, item, q, amount, discount, flag, at in lines:
        if None in (sale, item, amount, at, q) or q < 1:
            continue
        day = (at - dt.datetime(1970, 1, 1)).days
        for c in client.get(sale, ()):
            if c is not None:
                groups[c, item].append((day, sale, line, q, math.floor(100 * amount + 0.5), math.floor(100 * (discount or 0) + 0.5), flag))
    out = []
    for owner, own in groups.items():
        first = lambda line: -math.inf if line is None else line
        lots = sorted(([*r[:6], r[3]] for r in own), key=lambda r: (-Fraction(r[4], r[3]), r[0], r[1], first(r[2]), *r[3:6]))
        back = []
        for day, sale, line, q, c, d, flag in own:
            if flag == "returned":
                h = zlib.crc32(":".join(str(x) for x in (sale, line) if x is not None).encode())
                back.append((day + 1 + h % 31, sale, line, q, c, d, 1 + h % (q + 30)))
        back.sort(key=lambda r: (r[0], r[1], first(r[2]), *r[3:]))
        for number, (day, sale, line, q, c, d, n) in enumerate(back, 1):
            worth = lambda k: k * c * (100 - d) // (100 * q)  # noqa: B023, E731
            done = piece = 0
            for lot in lots:
                if done == n:
                    break
                if lot[0] < day and lot[6]:
                    take, gone = min(n - done, lot[6]), lot[3] - lot[6]
                    cost = (gone + take) * lot[4] // lot[3] - gone * lot[4] // lot[3]
                    refund = worth(done + take) - worth(done)
                    lot[6] -= take
                    done, piece = done + take, piece + 1
                    out.append((*owner, number, piece, day, sale, lot[1], lot[2], take, lot[6], refund, refund - cost))
            if done < n:
                out.append((*owner, number, piece + 1, day, sale, None, None, n - done, None, worth(n) - worth(done), None))
    return out


LINES = "sale_id bigint, line_no int, item_id bigint, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, vendor_id bigint, node int, day int, units int, at int"
COLUMNS = ["client_id", "item_id", *lot_matching.PIECE]


def matched(spark, lines, sales, **more):
    extra = (7, 1, 2, 3, 4)
    lines = spark.createDataFrame([(*r, *extra) for r in lines], LINES).repartition(3)
    sales = spark.createDataFrame([(*s, "x") for s in sales], "sale_id bigint, client_id bigint, status string")
    made = lot_matching.match_returns(lot_matching.sold_lots(lines, sales), lot_matching.sold_lots(lines.where("flag = 'returned'"), sales), **more)
    return ordered([tuple(r[c] for c in COLUMNS) for r in made.collect()])


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, v or 0) for v in r])


def shop(seed, n):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    lines = []
    for _ in range(n):
        row = (rng.randint(0, n // 3), rng.randint(1, 3), rng.choice([1, 1, 1, 1, 2, 3]), rng.randint(1, 9), rng.randint(1, 900) / 100, rng.randint(0, 10) / 100, rng.choice(["kept", "returned", "swapped"]), start + dt.timedelta(days=rng.randint(0, 60)))
        lines += [row] * rng.choice([1, 1, 1, 2])
    broken = [(1, 1, None, 3, 1.0, 0.0, "returned", start), (2, 1, 1, None, 1.0, 0.0, "returned", start), (3, 1, 1, 2, None, 0.0, "kept", start), (4, 1, 1, 2, 1.0, 0.0, "returned", None)]
    broken += [(None, 1, 1, 2, 1.0, 0.0, "returned", start), (5, None, 1, 2, 1.0, None, "returned", start), (6, 1, 1, 0, 1.0, 0.0, "returned", start), (n * 9, 1, 1, 2, 1.0, 0.0, "returned", start)]
    sales = [(s, rng.choice([10, 10, 10, 11, None])) for s in range(n // 3 + 1)] + [(2, 12), (None, 10)]
    return lines + broken, sales


@pytest.mark.parametrize("chunk", [100_000, 25])
def test_lots_of_one_hot_group(spark, chunk):
    lines, sales = shop(3, 500)
    assert matched(spark, lines, sales, chunk_events=chunk) == ordered(naive_lots(lines, sales))


def test_lots_over_a_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(lot_matching, "FAN", 4)
    lines, sales = shop(4, 300)
    assert matched(spark, lines, sales, chunk_events=20) == ordered(naive_lots(lines, sales))


def test_no_lots_and_no_returns(spark):
    assert matched(spark, [], []) == []
    assert matched(spark, [(1, 1, 1, 2, 1.0, 0.0, "kept", dt.datetime(2024, 1, 1))], [(1, 1)]) == []


def test_lots_of_the_given_tables(spark):
    con = duckdb.connect()
    lines = con.execute(f"SELECT sale_id, line_no, item_id, quantity, amount, discount, flag, shipped_at FROM '{SF}/sale_lines.parquet'").fetchall()
    sales = con.execute(f"SELECT sale_id, client_id FROM '{SF}/sales.parquet'").fetchall()
    got = lot_matching.op13_return_lots(spark, SF)
    assert ordered([tuple(r[c] for c in COLUMNS) for r in got.collect()]) == ordered(naive_lots(lines, sales))


def test_maps_compose_to_the_stock_that_a_replay_finds(spark):
    """stock_at_start against replaying everything before each chunk: the lots that the chunk takes from."""
    rng = random.Random(8)
    events = []
    for day in range(120):
        if rng.random() < 0.6:
            events.append((day, lot_matching.SHIPPED, day, 1, rng.randint(1, 6), rng.randint(1, 500), 0, 0))
        else:
            events.append((day, lot_matching.RETURNED, day, 1, 1, 100, 0, rng.randint(1, 8)))
    chunks = [events[i : i + 7] for i in range(0, len(events), 7)]
    lots, back, want = [], [], {}
    held = []
    for k, chunk in enumerate(chunks):
        units = sum(e[7] for e in chunk if e[1] == lot_matching.RETURNED)
        before = [(lot, lot[1]) for lot in held]
        _, shipped, _ = lot_matching.replay(chunk, [], 0)
        for seq, (key, left) in enumerate(shipped):
            lots.append((1, 1, *key, k, seq, k, key[5], left, key[0] % 3))
        back.append((1, 1, k, units))
        lot_matching.replay(chunk, held, 0)
        want |= {(k, lot[0][3]): left for lot, left in before if lot[1] < left}
    names = ", ".join(f"{c} bigint" for c in [*lot_matching.OWNER, *lot_matching.RANK, "node", "came", "left", "blk"])
    # blocks are ranges of ranks
    order = sorted(lots, key=lambda r: r[2:12])
    lots = [(*r[:-1], i // 9) for i, r in enumerate(order)]
    got = lot_matching.stock_at_start(spark.createDataFrame(lots, names), spark.createDataFrame(back, "client_id bigint, item_id bigint, node bigint, units bigint"), len(chunks))
    assert {(r["node"], r["sale_id"]): r["stock"] for r in got.collect()} == want
