"""Runs, walks, entity profiles and their matching."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import choose, flag, r6, safe_ratio, wilson_upper
from ..operators import matching, nearest_pairs
from ..operators import sequences as ops
from ..operators.grouped import mix
from ..sources.stage import staged
from ..sources.tables import FIRST_SEASON, LAST_SEASON
from .registry import query

ORDER = ["ts", "event_id"]
FAMILIES = ["breaking", "fastball", "offspeed"]
_RUN_SQL = """+ s AS (SELECT *, CASE WHEN lag(family) OVER w = family THEN 0 ELSE 1 END AS start FROM h WINDOW w AS (PARTITION BY uid ORDER BY ts, event_id)), r AS (SELECT *, sum(start) OVER (PARTITION BY uid ORDER BY ts, event_id) AS run FROM s)""".replace(" WINDOW w AS (PARTITION BY uid ORDER BY ts, event_id)", "").replace("OVER w", "OVER (PARTITION BY uid ORDER BY ts, event_id)")


#: Tolerance of supports, and the share of transitions that proves a mode.
TIE, LEAST_SHARE = 1e-9, 0.95


@query(
    f"{_RUN_SQL}, g AS (SELECT uid, run, count(*) AS n, arg_min(balls, event_id) AS first_balls, count(DISTINCT hand) AS hands FROM r GROUP BY uid, run) SELECT CASE WHEN n = 1 THEN '1' WHEN n = 2 THEN '2' WHEN n <= 4 THEN '3-4' ELSE '5+' END AS size, count(*) AS runs, sum(first_balls)::BIGINT AS balls, max(hands) AS hands FROM g GROUP BY 1",
    "h",
)
def run_segments(t) -> DataFrame:
    r = ops.run_ids(t.history, "uid", ORDER, F.col("family"))
    g = r.groupBy("uid", "run").agg(F.count("*").alias("n"), F.min_by("balls", "event_id").alias("first_balls"), F.countDistinct("hand").alias("hands"))
    size = choose([(F.col("n") == 1, "1"), (F.col("n") == 2, "2"), (F.col("n") <= 4, "3-4")], "5+")
    return g.groupBy(size.alias("size")).agg(F.count("*").alias("runs"), F.sum("first_balls").alias("balls"), F.max("hands").alias("hands"))


@query(
    """+ p AS (SELECT uid, family, row_number() OVER (PARTITION BY uid ORDER BY ts, event_id) AS k FROM h), g AS (SELECT uid, k - lag(k) OVER (PARTITION BY uid ORDER BY k) AS gap FROM p WHERE family = 'offspeed')
    SELECT least(gap, 10)::INT AS gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1""",
    "h",
)
def marker_gaps(t) -> DataFrame:
    """Distances between marker rows of an entity."""
    w = Window.partitionBy("uid")
    p = t.history.select("uid", "family", F.row_number().over(w.orderBy(*ORDER)).alias("k")).where(F.col("family") == "offspeed")
    gap = F.col("k") - F.lag("k").over(w.orderBy("k"))
    gaps = p.select(gap.alias("gap")).where(F.col("gap").isNotNull())
    return gaps.groupBy(F.least("gap", F.lit(10)).alias("gap")).agg(F.count("*").alias("n"))


@query("+ d AS (SELECT uid, value < lag(value) OVER (PARTITION BY uid ORDER BY ts, event_id) AS down FROM h) SELECT uid, count(*) FILTER (down) AS decreases, count(*) AS n FROM d GROUP BY uid", "h")
def source_decreases(t) -> DataFrame:
    down = F.col("value") < F.lag("value").over(Window.partitionBy("uid").orderBy(*ORDER))
    return t.history.select("uid", down.alias("down")).groupBy("uid").agg(F.count_if("down").alias("decreases"), F.count("*").alias("n"))


@query(
    """+ d AS (SELECT entity, season, CASE WHEN lag(season) OVER (PARTITION BY entity ORDER BY id) = season THEN 0 ELSE 1 END AS start FROM f), g AS (SELECT entity, sum(start) AS runs, count(DISTINCT season) AS seasons FROM d GROUP BY entity)
    SELECT (runs > seasons)::INT AS interleaved, count(*) AS entities, sum(runs)::BIGINT AS runs FROM g GROUP BY 1""",
    "f",
)
def season_runs(t) -> DataFrame:
    """Season runs in source order within an entity; more runs than seasons means interleaving."""
    r = ops.run_ids(t.frame, "entity", ["id"], F.col("season"))
    g = r.groupBy("entity").agg(F.max("run").alias("runs"), F.countDistinct("season").alias("seasons"))
    return g.groupBy(flag(F.col("runs") > F.col("seasons")).alias("interleaved")).agg(F.count("*").alias("entities"), F.sum("runs").alias("runs"))


_CODE = "(balls * 100 + strikes * 10 + outs)"
_WALK_SQL = f"+ w AS (SELECT uid, season, list({_CODE} ORDER BY ts, event_id) AS walk FROM h GROUP BY uid, season)"


def _walks(t) -> DataFrame:
    code = (F.col("balls") * 100 + F.col("strikes") * 10 + F.col("outs")).cast("long")
    return ops.walks(t.history.withColumn("code", code), ["uid", "season"], ORDER, "code")


@query(f"{_WALK_SQL} SELECT uid, season, len(walk)::INT AS steps, sha256(array_to_string(walk, ',')) AS digest FROM w", "h")
def walk_hash(t) -> DataFrame:
    return _walks(t).select("uid", "season", "steps", F.sha2(F.array_join(F.transform("walk", lambda c: c.cast("string")), ","), 256).alias("digest"))


@query(
    f"""+ w AS (SELECT uid, strftime(ts, '%Y-%m-%d') AS day, list({_CODE} ORDER BY ts, event_id) AS walk FROM h GROUP BY 1, 2),
    c AS (SELECT a.uid, a.day, b.uid AS other, len(a.walk) AS steps FROM w a JOIN w b ON a.day = b.day AND a.walk = b.walk WHERE a.uid % 2 = 0 AND b.uid % 2 = 1)
    SELECT uid, day, min(other) AS other, max(steps)::INT AS steps FROM c GROUP BY uid, day HAVING count(*) = 1""",
    "h",
)
def walk_match(t) -> DataFrame:
    """Whole-day walks of two sources that are equal: met by hash, verified code by code, one candidate only."""
    code = (F.col("balls") * 100 + F.col("strikes") * 10 + F.col("outs")).cast("long")
    rows = t.history.select("uid", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "event_id", code.alias("code"))
    w = ops.walks(rows, ["uid", "day"], ORDER, "code").withColumn("digest", F.xxhash64("walk"))
    a = w.where("uid % 2 = 0")
    b = w.where("uid % 2 = 1").select(F.col("uid").alias("other"), "day", "digest", F.col("walk").alias("b_walk"))
    c = a.join(b, ["day", "digest"]).where(F.col("walk") == F.col("b_walk"))
    made = c.groupBy("uid", "day").agg(F.min("other").alias("other"), F.max("steps").alias("steps"), F.count("*").alias("n"))
    return made.where(F.col("n") == 1).drop("n")


_LCP_SQL = f"""+ w AS (SELECT uid, season, arg_min(month(ts), event_id)::INT AS month, arg_min(isodow(ts) - 1, event_id)::INT AS dow, list({_CODE} ORDER BY event_id) AS walk FROM h GROUP BY uid, season),
    p AS (SELECT a.uid, a.season, a.month, a.dow, a.walk AS x, b.walk AS y FROM w a LEFT JOIN w b ON b.uid % 2 = 1 AND a.season = b.season AND a.month = b.month AND a.dow = b.dow WHERE a.uid % 2 = 0),
    l AS (SELECT uid, season, month, dow, len(x) AS steps, (x = y)::INT AS same, CASE WHEN y IS NULL THEN 0 ELSE coalesce(nullif(list_position(list_transform(generate_series(1, least(len(x), len(y))), lambda i: x[i] = y[i]), false), 0) - 1, least(len(x), len(y))) END AS lcp FROM p),
    g AS (SELECT uid, season, month, dow, steps::BIGINT AS steps, coalesce(sum(same), 0)::BIGINT AS exact, max(lcp)::INT AS lcp FROM l GROUP BY ALL)"""


def _longest_prefixes(t) -> DataFrame:
    """Walks of one source against those of the other that begin in the same season and month and on the same weekday."""
    code = F.col("balls") * 100 + F.col("strikes") * 10 + F.col("outs")
    first = Window.partitionBy("uid", "season").orderBy("event_id")
    start = lambda c: F.first(c).over(first)
    rows = t.history.select("uid", "season", "event_id", code.alias("code"), start(F.month("ts")).alias("month"), start(F.weekday("ts")).alias("dow"))
    placed = ops.prefix_rows(rows, ["uid", "season"], ["event_id"], "code")
    return ops.longest_prefix(placed.where("uid % 2 = 0"), placed.where("uid % 2 = 1"), ["uid"], ["season", "month", "dow"])


@query(f"{_LCP_SQL} SELECT uid, season, month, dow, steps, lcp, exact, (exact = 1)::INT AS unique_match, round(lcp / steps, 6) AS share FROM g", "h")
def walk_lcp(t) -> DataFrame:
    """The longest common prefix with any same-day walk of the other source; a walk that is equal to exactly one is matched."""
    g = _longest_prefixes(t)
    return g.select("uid", "season", "month", "dow", "steps", "lcp", "exact", flag(F.col("exact") == 1).alias("unique_match"), r6(F.col("lcp") / F.col("steps")).alias("share"))


@query(
    f"""{_LCP_SQL} SELECT season, t / 100.0::DOUBLE AS threshold, count(*) FILTER (lcp * 100 >= t * steps) AS walks, coalesce(sum(steps) FILTER (lcp * 100 >= t * steps), 0)::BIGINT AS row_count,
    round(coalesce(sum(steps) FILTER (lcp * 100 >= t * steps), 0) / sum(steps), 6) AS coverage FROM g, (SELECT unnest([50, 75, 90, 100]) AS t) GROUP BY season, t""",
    "h",
)
def walk_coverage(t) -> DataFrame:
    """Share of rows in walks that a prefix covers to at least each threshold."""
    g = _longest_prefixes(t).select("season", "steps", "lcp", F.explode(F.array(*[F.lit(k) for k in (50, 75, 90, 100)])).alias("k"))
    covered = F.col("lcp") * 100 >= F.col("k") * F.col("steps")
    rows = F.sum(F.when(covered, F.col("steps")).otherwise(0))
    return g.groupBy("season", (F.col("k") / 100).alias("threshold")).agg(F.count_if(covered).alias("walks"), rows.alias("row_count"), r6(rows / F.sum("steps")).alias("coverage"))


@query(
    f"""+ c AS (SELECT uid % 2 AS side, season, {_CODE} AS code, count(*) AS n FROM h GROUP BY ALL) SELECT coalesce(a.season, b.season) AS season, sum(least(coalesce(a.n, 0), coalesce(b.n, 0)))::BIGINT AS shared, sum(coalesce(a.n, 0))::BIGINT AS left_n, sum(coalesce(b.n, 0))::BIGINT AS right_n
    FROM (SELECT * FROM c WHERE side = 0) a FULL JOIN (SELECT * FROM c WHERE side = 1) b ON a.season = b.season AND a.code = b.code GROUP BY 1""",
    "h",
)
def multiset_overlap(t) -> DataFrame:
    code = F.col("balls") * 100 + F.col("strikes") * 10 + F.col("outs")
    n = lambda side: F.count_if(F.col("uid") % 2 == side)
    c = t.history.groupBy("season", code.alias("code")).agg(n(0).alias("a"), n(1).alias("b"))
    return c.groupBy("season").agg(F.sum(F.least("a", "b")).alias("shared"), F.sum("a").alias("left_n"), F.sum("b").alias("right_n"))


@query(
    """+ p AS (SELECT uid, family, value, row_number() OVER (PARTITION BY uid ORDER BY ts, event_id) AS k FROM h) SELECT a.uid, count(*) AS aligned, round(avg((a.family = b.family)::INT), 6) AS agree, round(avg(abs(a.value - b.value)), 6) AS gap
    FROM p a JOIN p b ON b.uid = a.uid + 1 AND a.k = b.k WHERE a.uid % 2 = 0 GROUP BY a.uid""",
    "h",
)
def positional_align(t) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("uid").orderBy(*ORDER))
    p = t.history.select("uid", "family", "value", k.alias("k"))
    b = p.select((F.col("uid") - 1).alias("uid"), "k", F.col("family").alias("f2"), F.col("value").alias("v2"))
    j = p.where("uid % 2 = 0").join(b, ["uid", "k"])
    return j.groupBy("uid").agg(F.count("*").alias("aligned"), r6(F.avg(flag(F.col("family") == F.col("f2")))).alias("agree"), r6(F.avg(F.abs(F.col("value") - F.col("v2")))).alias("gap"))


_MAJORITY_SQL = """+ n AS (SELECT pid, bid % 9 AS other, count(*) AS n FROM m GROUP BY ALL), j AS (SELECT pid, other, n, n / sum(n) OVER (PARTITION BY pid)::DOUBLE AS confidence, row_number() OVER (PARTITION BY pid ORDER BY n DESC, other) AS k FROM n)"""


def _majority(t) -> DataFrame:
    return ops.majority(t.main.select("pid", (F.col("bid") % 9).alias("other")), "pid", "other")


@query(f"{_MAJORITY_SQL} SELECT pid, other, n, round(confidence, 6) AS confidence, count(*) OVER (PARTITION BY other) AS mapped_here FROM j WHERE k = 1", "m")
def majority_map(t) -> DataFrame:
    return _majority(t).select("pid", "other", "n", r6("confidence").alias("confidence"), F.count("*").over(Window.partitionBy("other")).alias("mapped_here"))


@query(f"{_MAJORITY_SQL}, g AS (SELECT pid, confidence >= 0.13 AS safe FROM j WHERE k = 1) SELECT count(DISTINCT g.pid) FILTER (safe) AS mapped, count(DISTINCT g.pid) AS entities, round(avg(safe::INT), 6) AS row_coverage FROM m JOIN g ON g.pid = m.pid", "m")
def map_coverage(t) -> DataFrame:
    g = _majority(t).select("pid", (F.col("confidence") >= 0.13).alias("safe"))
    j = t.main.select("pid").join(g, "pid")
    return j.agg(F.count_distinct(F.when(F.col("safe"), F.col("pid"))).alias("mapped"), F.countDistinct("pid").alias("entities"), r6(F.avg(flag(F.col("safe")))).alias("row_coverage"))


@query(
    """+ n AS (SELECT season >= 2023 AS late, pid, bid % 9 AS other, count(*) AS n FROM m GROUP BY ALL), b AS (SELECT late, pid, other, row_number() OVER (PARTITION BY late, pid ORDER BY n DESC, other) AS k FROM n)
    SELECT count(*) AS entities, count(*) FILTER (x.other = y.other) AS stable FROM b x JOIN b y ON x.pid = y.pid AND x.k = 1 AND y.k = 1 AND NOT x.late AND y.late""",
    "m",
)
def map_stability(t) -> DataFrame:
    """How many entities keep their partner across two origins."""
    rows = t.main.select("season", "pid", (F.col("bid") % 9).alias("other"))
    a = ops.majority(rows.where("season < 2023"), "pid", "other").select("pid", "other")
    b = ops.majority(rows.where("season >= 2023"), "pid", "other").select("pid", F.col("other").alias("later"))
    return a.join(b, "pid").agg(F.count("*").alias("entities"), F.count_if(F.col("other") == F.col("later")).alias("stable"))


_SNAP_SQL = """+ s AS (SELECT pid, season, n_p, max(n_p) OVER (PARTITION BY pid, season) AS top, prev5 FROM m), snap AS (SELECT pid, season, max(n_p) AS n, min(prev5) AS lo, max(prev5) AS hi, count(*) AS ties FROM s WHERE n_p = top GROUP BY pid, season)"""


def _snapshots(t) -> DataFrame:
    top = t.main.groupBy("pid", "season").agg(F.max("n_p").alias("n"))
    rows = t.main.select("pid", "season", F.col("n_p").alias("n"), "prev5").join(top, ["pid", "season", "n"])
    return rows.groupBy("pid", "season", "n").agg(F.min("prev5").alias("lo"), F.max("prev5").alias("hi"), F.count("*").alias("ties"))


@query(f"{_SNAP_SQL} SELECT pid, season, n, ties, round(hi, 6) AS share, (hi - lo > 0.000001)::INT AS conflict FROM snap", "m")
def snapshot_max(t) -> DataFrame:
    """The row of largest support of each entity and season; a conflict where tied rows disagree."""
    return _snapshots(t).select("pid", "season", "n", "ties", r6("hi").alias("share"), flag(F.col("hi") - F.col("lo") > 1e-6).alias("conflict"))


@query(
    """+ s AS (SELECT pid, season, min(n_p) AS lo, max(n_p) AS hi FROM m GROUP BY ALL), d AS (SELECT pid, lo, lag(hi) OVER (PARTITION BY pid ORDER BY season) AS before FROM s)
    , c AS (SELECT count(*) FILTER (lo >= before - 1e-9) AS cumulative, count(*) FILTER (lo < before - 1e-9) AS reset, count(before) AS n FROM d)
    SELECT cumulative, reset, CASE WHEN n = 0 THEN 'INSUFFICIENT_TRANSITIONS' WHEN cumulative >= 0.95 * n OR reset >= 0.95 * n THEN 'PASS' ELSE 'MATERIALIZATION_NOT_PROVEN' END AS status,
           CASE WHEN n > 0 AND cumulative >= 0.95 * n THEN 'CUMULATIVE' WHEN n > 0 AND reset >= 0.95 * n THEN 'SEASON_RESET' END AS mode FROM c""",
    "m",
)
def asof_mode(t) -> DataFrame:
    """Whether as-of counts go on across seasons or start over; proven by 95 % of an entity's adjacent seasons or not at all."""
    s = t.main.groupBy("pid", "season").agg(F.min("n_p").alias("lo"), F.max("n_p").alias("hi"))
    d = s.withColumn("before", F.lag("hi").over(Window.partitionBy("pid").orderBy("season")))
    c = d.agg(F.count_if(F.col("lo") >= F.col("before") - TIE).alias("cumulative"), F.count_if(F.col("lo") < F.col("before") - TIE).alias("reset"), F.count("before").alias("n"))
    enough = lambda k: (F.col("n") > 0) & (F.col(k) >= LEAST_SHARE * F.col("n"))
    proven = enough("cumulative") | enough("reset")
    status = F.when(F.col("n") == 0, "INSUFFICIENT_TRANSITIONS").when(proven, "PASS").otherwise("MATERIALIZATION_NOT_PROVEN")
    return c.select("cumulative", "reset", status.alias("status"), F.when(enough("cumulative"), "CUMULATIVE").when(enough("reset"), "SEASON_RESET").alias("mode"))


@query(
    f"""{_SNAP_SQL}, c AS (SELECT pid, season, sum(n) OVER (PARTITION BY pid ORDER BY season) AS n, hi FROM snap), d AS (SELECT pid, season, n, hi, lag(n) OVER (PARTITION BY pid ORDER BY season) AS n1, lag(hi) OVER (PARTITION BY pid ORDER BY season) AS p1 FROM c)
    SELECT pid, season, round((n * hi - n1 * p1) / (n - n1)::DOUBLE, 6) AS share FROM d WHERE n1 IS NOT NULL AND n > n1 AND n * hi >= n1 * p1""",
    "m",
)
def decumulate(t) -> DataFrame:
    """Season shares from cumulative ones; negative ones are left out as impossible."""
    w = Window.partitionBy("pid").orderBy("season")
    c = _snapshots(t).select("pid", "season", F.sum("n").over(w).alias("n"), "hi")
    d = c.select("*", F.lag("n").over(w).alias("n1"), F.lag("hi").over(w).alias("p1"))
    gain = F.col("n") * F.col("hi") - F.col("n1") * F.col("p1")
    made = d.where(F.col("n1").isNotNull() & (F.col("n") > F.col("n1")) & (gain >= 0))
    return made.select("pid", "season", r6(safe_ratio(gain, (F.col("n") - F.col("n1")).cast("double"))).alias("share"))


_SHARE = ", ".join(f"count(*) FILTER (family = '{f}') / count(*)::DOUBLE AS {f}" for f in FAMILIES)
_PROFILE_SQL = f"+ pr AS (SELECT uid, season, any_value(hand) AS hand, count(*) AS support, {_SHARE} FROM h WHERE family <> 'other' GROUP BY uid, season)"


def _profiles(t) -> DataFrame:
    rows = t.history.where("family <> 'other'")
    support = rows.groupBy("uid", "season").agg(F.min("hand").alias("hand"), F.count("*").alias("support"))
    return mix(rows, ["uid", "season"], "family", FAMILIES).join(support, ["uid", "season"])


@query(f"{_PROFILE_SQL} SELECT uid, season, hand, support, {', '.join(f'round({f}, 6) AS {f}' for f in FAMILIES)} FROM pr", "h")
def entity_profile(t) -> DataFrame:
    return _profiles(t).select("uid", "season", "hand", "support", *[r6(f).alias(f) for f in FAMILIES])


_TV = "0.5 * (" + " + ".join(f"abs(a.{f} - b.{f})" for f in FAMILIES) + ")"
_DTV = "0.5 * (" + " + ".join(f"abs((a.{f} - a.p_{f}) - (b.{f} - b.p_{f}))" for f in FAMILIES) + ")"
_DISTANCE_SQL = f"""{_PROFILE_SQL}, ad AS (SELECT *, lag(season) OVER (PARTITION BY uid ORDER BY season) AS ps, {', '.join(f'lag({f}) OVER (PARTITION BY uid ORDER BY season) AS p_{f}' for f in FAMILIES)} FROM pr),
    pd AS (SELECT a.uid, b.uid AS other, greatest(max({_TV}), max(CASE WHEN a.ps = a.season - 1 AND b.ps = b.season - 1 THEN {_DTV} END)) AS d, count(*) AS seasons
    FROM ad a JOIN ad b ON a.hand = b.hand AND a.season = b.season AND a.uid % 4 < 2 AND b.uid % 4 >= 2 GROUP BY a.uid, b.uid HAVING count(*) >= 2 AND count(CASE WHEN a.ps = a.season - 1 AND b.ps = b.season - 1 THEN 1 END) >= 1)"""


SEASONS = range(FIRST_SEASON, LAST_SEASON + 1)


def _variation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Half the L1 distance of every pair of two sets of shares."""
    total = np.zeros((len(a), len(b)))
    for f in range(a.shape[1]):
        gap = np.subtract(a[:, None, f], b[None, :, f])
        total += np.abs(gap, out=gap)
    return np.multiply(total, 0.5, out=total)


def _season_distances(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest season distance or change of it of every pair of two sets of vectors of shares by season, and how many seasons both have; infinite where that is
    under two or no two are adjacent."""
    x, y = (v.reshape(-1, len(SEASONS), len(FAMILIES)) for v in (x, y))
    turns = [v[:, 1:] - v[:, :-1] for v in (x, y)]
    worst = np.full((len(x), len(y)), np.nan)
    both = []
    for a, b in ((x, y), turns):
        known = [(~np.isnan(v[:, :, 0])).astype(float) for v in (a, b)]
        both.append(known[0] @ known[1].T)
        for s in range(a.shape[1]):
            if known[0][:, s].any() and known[1][:, s].any():
                np.fmax(worst, _variation(a[:, s], b[:, s]), out=worst)
    return np.where((both[0] >= 2) & (both[1] >= 1), worst, np.inf), both[0].astype(np.int64)


def _judged(t, judge, schema: str) -> DataFrame:
    """Pairs of hand-compatible entities of two sources: each entity is one row of shares by season, and a season's distance needs both in it."""
    p = _profiles(t)
    shares = F.array(*[F.max(F.when(F.col("season") == s, F.col(f))) for s in SEASONS for f in FAMILIES])
    e = staged(p.groupBy(F.col("uid").alias("id"), "hand").agg(shares.alias("v")), "profiles")
    return nearest_pairs.compared(e.where("id % 4 < 2"), e.where("id % 4 >= 2"), "hand", judge, schema)


@query(f"{_DISTANCE_SQL} SELECT uid, other, round(d, 6) AS d, seasons FROM pd", "h")
def profile_distance(t) -> DataFrame:
    return _judged(t, nearest_pairs.within(_season_distances), "uid bigint, other bigint, d double, seasons bigint").select("uid", "other", r6("d").alias("d"), "seasons")


@query(
    f"""{_DISTANCE_SQL}, q AS (SELECT uid, other, round(d, 9) AS d FROM pd), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY d, other) AS l, row_number() OVER (PARTITION BY other ORDER BY d, uid) AS r, lead(d) OVER (PARTITION BY uid ORDER BY d, other) - d AS margin FROM q)
    SELECT uid, other, round(d, 6) AS d, round(margin, 6) AS margin, CASE WHEN margin <= 1e-12 THEN 'ambiguous' ELSE 'accepted' END AS status FROM r WHERE l = 1 AND r = 1""",
    "h",
)
def mutual_best(t) -> DataFrame:
    # the two nearest of each left and the nearest of each right of a block are all that can be among the nearest of all
    q = _judged(t, nearest_pairs.nearest(_season_distances, 2, 9, both=True), "uid bigint, other bigint, d double").distinct()
    return ops.mutual_best(q, "uid", "other", "d").select("uid", "other", r6("d").alias("d"), r6("margin").alias("margin"), "status")


_SELF_SQL = f"""{_PROFILE_SQL}, qy AS (SELECT * FROM pr WHERE season = 2023), rf AS (SELECT uid, hand, {', '.join(f'sum({f} * support) / sum(support) AS {f}' for f in FAMILIES)} FROM pr WHERE season <= 2021 GROUP BY uid, hand),
    dd AS (SELECT a.uid, b.uid AS other, round({_TV}, 9) AS d FROM qy a JOIN rf b ON a.hand = b.hand), rr AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY d, other) AS k, lead(d) OVER (PARTITION BY uid ORDER BY d, other) - d AS margin FROM dd)"""


@query(f"{_SELF_SQL} SELECT CASE WHEN margin <= 1e-12 THEN 'ambiguous' WHEN uid = other THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n FROM rr WHERE k = 1 GROUP BY 1", "h")
def self_identify(t) -> DataFrame:
    """Last season's profile against the seasons two and more before, among entities of equal hand."""
    p = _profiles(t)
    q = staged(p.where("season = 2023").select(F.col("uid").alias("id"), "hand", F.array(*FAMILIES).alias("v")), "queries")
    mean = lambda f: F.sum(F.col(f) * F.col("support")) / F.sum("support")
    ref = staged(p.where("season <= 2021").groupBy(F.col("uid").alias("id"), "hand").agg(F.array(*[mean(f) for f in FAMILIES]).alias("v")), "references")

    # the two nearest of each block are all that can be among the two nearest
    d = nearest_pairs.compared(q, ref, "hand", nearest_pairs.nearest(lambda x, y: (_variation(x, y),), 2, 9), "uid bigint, other bigint, d double")
    w = Window.partitionBy("uid").orderBy("d", "other")
    best = d.select("*", F.row_number().over(w).alias("k"), (F.lead("d").over(w) - F.col("d")).alias("margin")).where(F.col("k") == 1)
    outcome = choose([(F.col("margin") <= 1e-12, "ambiguous"), (F.col("uid") == F.col("other"), "correct")], "wrong")
    return best.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    """+ u AS (SELECT uid, season <= 2021 AS early, unnest(['balls', 'strikes', 'family']) AS channel, unnest([balls::VARCHAR, strikes::VARCHAR, family]) AS token FROM h), n AS (SELECT uid, channel, token, count(*) FILTER (early) AS a, count(*) FILTER (NOT early) AS b FROM u GROUP BY ALL),
    s AS (SELECT uid, channel, 0.5 * sum(abs(a / ta::DOUBLE - b / tb::DOUBLE)) AS tv FROM (SELECT *, sum(a) OVER (PARTITION BY uid, channel) AS ta, sum(b) OVER (PARTITION BY uid, channel) AS tb FROM n) WHERE ta > 0 AND tb > 0 GROUP BY uid, channel),
    x AS (SELECT uid, max(tv) AS worst FROM s GROUP BY uid) SELECT channel, round(quantile_cont(tv, 0.5), 6) AS med, round((SELECT quantile_cont(worst, 0.5) FROM x), 6) AS worst_med FROM s GROUP BY channel""",
    "h",
)
def context_tv(t) -> DataFrame:
    """Context histograms of the same entity in two periods: distance by channel, and of the worst channel."""
    channels = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("string").alias("token")) for c in ("balls", "strikes", "family")])
    u = t.history.select("uid", (F.col("season") <= 2021).alias("early"), F.inline(channels))
    n = u.groupBy("uid", "channel", "token").agg(F.count_if("early").alias("a"), F.count_if(~F.col("early")).alias("b"))
    w = Window.partitionBy("uid", "channel")
    n = n.select("*", F.sum("a").over(w).alias("ta"), F.sum("b").over(w).alias("tb")).where("ta > 0 AND tb > 0")
    s = n.groupBy("uid", "channel").agg((0.5 * F.sum(F.abs(F.col("a") / F.col("ta") - F.col("b") / F.col("tb")))).alias("tv"))
    worst = s.groupBy("uid").agg(F.max("tv").alias("worst")).agg(r6(F.percentile("worst", F.lit(0.5))).alias("worst_med"))
    return s.groupBy("channel").agg(r6(F.percentile("tv", F.lit(0.5))).alias("med")).crossJoin(F.broadcast(worst))


@query(
    "SELECT event_id, round(avg(value) OVER (PARTITION BY uid ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS recent5, count(*) OVER (PARTITION BY uid ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n FROM h",
    "h",
)
def recent_k(t) -> DataFrame:
    w = Window.partitionBy("uid").orderBy(*ORDER).rowsBetween(-5, -1)
    return t.history.select("event_id", r6(F.avg("value").over(w)).alias("recent5"), F.count("*").over(w).alias("n"))


REQUESTED = 5


@query(
    f"""+ e AS (SELECT DISTINCT uid, balls AS l, event_id // 7 % 6 AS r FROM h WHERE value > 20), k AS (SELECT * FROM e WHERE l <> r),
    n AS (SELECT uid, count(DISTINCT l) AS lefts, count(DISTINCT r) AS rights FROM e GROUP BY uid), q AS (SELECT uid, count(DISTINCT l) AS eligible, count(*) AS edges FROM k GROUP BY uid),
    o AS (SELECT uid, l, r FROM k UNION ALL SELECT DISTINCT uid, v.l, NULL FROM e, (SELECT unnest([0, 1, 2, 3]) AS l) v),
    c AS (SELECT a.uid, list_filter([(0, a.r), (1, b.r), (2, c.r), (3, d.r)], lambda x: x[2] IS NOT NULL) AS pairs FROM o a JOIN o b ON b.uid = a.uid AND b.l = 1 JOIN o c ON c.uid = a.uid AND c.l = 2 JOIN o d ON d.uid = a.uid AND d.l = 3 WHERE a.l = 0),
    u AS (SELECT uid, pairs, len(pairs) AS size FROM c WHERE len(pairs) = len(list_distinct(list_transform(pairs, lambda x: x[2])))),
    b AS (SELECT uid, max(size) AS size FROM u GROUP BY uid),
    s AS (SELECT u.uid, u.size, substr(sha256('[' || array_to_string(list_transform(pairs, lambda x: '(' || x[1] || ', ' || x[2] || ')'), ', ') || ']'), 1, 16) AS id FROM u JOIN b ON b.uid = u.uid AND b.size = u.size)
    SELECT n.uid, lefts, rights, coalesce(eligible, 0) AS eligible_lefts, coalesce(edges, 0) AS edge_count, max(size)::INT AS cardinality, count(*) AS finite_space, least(count(*) - 1, {REQUESTED}) AS generated, count(*) - 1 <= {REQUESTED} AS exhausted
    FROM n JOIN s ON s.uid = n.uid LEFT JOIN q ON q.uid = n.uid GROUP BY n.uid, lefts, rights, eligible, edges""",
    "h",
)
def null_matchings(t) -> DataFrame:
    """How many largest matchings of each entity's graph of states and slots there are, no state in the slot of its own number, and how many others than the canonical one are drawn."""
    allowed = t.history.where("value > 20").select("uid", F.col("balls").cast("long").alias("left"), (F.floor(F.col("event_id") / 7) % 6).alias("right"))
    graphs = matching.null_graphs(allowed, "uid", derangement=True)
    _, summary = matching.null_matchings(graphs, "uid", REQUESTED, "null")
    return graphs.select("uid", "lefts", "rights", "eligible_lefts", F.size("edges").cast("long").alias("edge_count")).join(summary, "uid")


TRIALS, CLOSE = 200, 0.05
#: Digits to which differences of means are judged: sums of the same values in another order differ by some 1e-13.
JUDGED = 11
#: Means whose difference is nearer to CLOSE than this share of their size are summed again in the order of events.
DOUBT = 1e-9
_NULL_SQL = f"""+ e AS (SELECT uid, avg(value) AS mean FROM h GROUP BY uid), t AS (SELECT unnest(generate_series(0, {TRIALS - 1})) AS trial),
    l AS (SELECT trial, uid, mean, row_number() OVER (PARTITION BY trial ORDER BY sha256(concat_ws('|', 'null/left', trial, uid)), uid) AS k FROM e, t),
    r AS (SELECT trial, uid, mean, row_number() OVER (PARTITION BY trial ORDER BY sha256(concat_ws('|', 'null/right', trial, uid)), uid) AS k FROM e, t),
    p AS (SELECT l.trial, l.uid AS a, r.uid AS b, l.mean AS x, r.mean AS y FROM l JOIN r ON l.trial = r.trial AND l.k = r.k), ok AS (SELECT trial FROM p GROUP BY trial HAVING count(*) FILTER (a = b) = 0),
    acc AS (SELECT trial, count(*) AS pairs, count(*) FILTER (abs(x - y) < {CLOSE}) AS accepted FROM p JOIN ok USING (trial) GROUP BY trial)"""


def _close(x: Column, y: Column) -> Column:
    """Whether two means differ by less than CLOSE; a difference of exactly CLOSE doesn't count, in whatever order the values were summed."""
    return F.round(F.abs(x - y), JUDGED) < CLOSE


def _means_in_order(history: DataFrame, users: DataFrame) -> DataFrame:
    """uid and mean of the users, each summed one value after the other as events are numbered, which gives the same sum however rows are dealt."""
    upto = Window.partitionBy("uid").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = history.where(F.col("value").isNotNull()).join(users, "uid", "left_semi")
    sums = values.select("uid", F.sum("value").over(upto).alias("s"), F.count("*").over(upto).alias("n"))
    return sums.groupBy("uid").agg((F.max_by("s", "n") / F.max("n")).alias("mean"))


def _accepts(history: DataFrame, pairs: DataFrame) -> DataFrame:
    """trial, its pairs and those of close means. Sums in another order differ in their last digits, which decide pairs that are as far apart as the bound: these alone are
    judged by means summed in order, as the SQL's are where one thread reads the events."""

    def joined(pairs: DataFrame, means: DataFrame) -> DataFrame:
        return pairs.join(means.select(F.col("uid").alias("left"), F.col("mean").alias("x")), "left").join(means.select(F.col("uid").alias("right"), F.col("mean").alias("y")), "right")

    x, y = F.col("x"), F.col("y")
    doubtful = F.abs(F.abs(x - y) - CLOSE) <= DOUBT * (1 + F.abs(x) + F.abs(y))
    told = joined(pairs, history.groupBy("uid").agg(F.avg("value").alias("mean"))).withColumn("_doubt", F.coalesce(doubtful, F.lit(False)))
    # a row for each trial, and one for each pair in doubt
    named = [F.when(F.col("_doubt"), F.col(c)).alias(c) for c in ("left", "right")]
    told = staged(told.groupBy("trial", "_doubt", *named).agg(F.count("*").alias("pairs"), F.count_if(_close(x, y)).alias("accepted")), "accepted")
    doubt = told.where("_doubt").select("trial", "left", "right", "pairs")
    users = doubt.select(F.col("left").alias("uid")).union(doubt.select("right")).distinct()
    judged = joined(doubt, _means_in_order(history, users)).select("trial", "pairs", F.when(F.abs(x - y) < CLOSE, F.col("pairs")).otherwise(0).alias("accepted"))
    return told.where("NOT _doubt").select("trial", "pairs", "accepted").union(judged).groupBy("trial").agg(F.sum("pairs").alias("pairs"), F.sum("accepted").alias("accepted"))


def _null_accepts(t) -> DataFrame:
    users = t.history.select("uid").distinct()
    return _accepts(t.history, matching.null_permutations(users, users, "uid", TRIALS, "null", derangement=True))


@query(f"{_NULL_SQL} SELECT trial, pairs, accepted FROM acc", "h")
def null_permutations(t) -> DataFrame:
    """Pairs of close means in every null assignment that maps no entity to itself."""
    return _null_accepts(t)


@query(
    f"""{_NULL_SQL}, s AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (accepted > 0)::DOUBLE AS k, quantile_cont(accepted, 0.95) AS p95, max(accepted) AS most, max(pairs) AS pairs FROM acc)
    SELECT n::BIGINT AS unique_trials, {TRIALS} AS requested_trials, k::BIGINT AS false_accepts, round(k / n, 6) AS rate,
    round(least(1, (k / n + 1.6448536269514722::DOUBLE ** 2 / (2 * n) + 1.6448536269514722::DOUBLE * sqrt((k / n * (1 - k / n) + 1.6448536269514722::DOUBLE ** 2 / (4 * n)) / n)) / (1 + 1.6448536269514722::DOUBLE ** 2 / n)), 6) AS upper,
    round(p95, 6) AS accepted_p95, most AS accepted_max, pairs, (least(1, (k / n + 1.6448536269514722::DOUBLE ** 2 / (2 * n) + 1.6448536269514722::DOUBLE * sqrt((k / n * (1 - k / n) + 1.6448536269514722::DOUBLE ** 2 / (4 * n)) / n)) / (1 + 1.6448536269514722::DOUBLE ** 2 / n)) <= 0.01)::INT AS passes,
    (SELECT array_to_string(list(accepted || ':' || c ORDER BY accepted), ',') FROM (SELECT accepted, count(*) AS c FROM acc GROUP BY accepted)) AS histogram FROM s""",
    "h",
)
def false_accepts(t) -> DataFrame:
    """Summary of null trials: how many accept anything, the upper bound of that rate, and how many pairs they accept."""
    trials = _null_accepts(t)
    histogram = trials.groupBy("accepted").agg(F.count("*").alias("c"))
    # one row for each count of accepted pairs
    text = histogram.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("accepted", "c"))), lambda e: F.concat_ws(":", e["accepted"], e["c"])), ",").alias("histogram"))
    made = trials.agg(F.count("*").alias("n"), F.count_if(F.col("accepted") > 0).alias("k"), F.percentile("accepted", F.lit(0.95)).alias("p95"), F.max("accepted").alias("most"), F.max("pairs").alias("pairs"))
    upper = F.least(F.lit(1.0), wilson_upper(F.col("k"), F.col("n")))
    return made.crossJoin(F.broadcast(text)).select(
        F.col("n").alias("unique_trials"), F.lit(TRIALS).alias("requested_trials"), F.col("k").alias("false_accepts"), r6(F.col("k") / F.col("n")).alias("rate"), r6(upper).alias("upper"),
        r6("p95").alias("accepted_p95"), F.col("most").alias("accepted_max"), "pairs", flag(upper <= 0.01).alias("passes"), "histogram",
    )
