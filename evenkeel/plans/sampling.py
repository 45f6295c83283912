"""Samples, splits, out-of-fold encodings and bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag, r6, wilson_upper
from ..operators.encode import shrunk_encoding
from ..operators.sampling import quotas, redrawn, resampled, systematic, unit_hash
from ..sources.stage import staged
from .registry import query

BUDGET = 500
_QUOTA_SQL = f"""+ s AS (SELECT season, status, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT sum(n)::BIGINT AS t FROM s), w AS (SELECT season, status, n, n * {BUDGET} // t AS whole, n * {BUDGET} % t AS rest FROM s, t),
    q AS (SELECT season, status, n, (whole + (row_number() OVER (ORDER BY rest DESC, season, status) <= {BUDGET} - sum(whole) OVER ())::INT)::BIGINT AS quota FROM w)"""


def _quota(t) -> DataFrame:
    return quotas(t.frame.groupBy("season", "status").agg(F.count("*").alias("n")), ["season", "status"], BUDGET)


@query(f"{_QUOTA_SQL} SELECT * FROM q", "f")
def strat_quota(t) -> DataFrame:
    return _quota(t)


@query(
    f"""{_QUOTA_SQL}, p AS (SELECT season, status, (2 * unnest(generate_series(0, quota - 1)) + 1) * n // (2 * quota) AS k FROM q WHERE quota > 0),
    r AS (SELECT season, status, id, row_number() OVER (PARTITION BY season, status ORDER BY id) - 1 AS k FROM f) SELECT r.season, r.status, r.id FROM r JOIN p ON p.season = r.season AND p.status = r.status AND p.k = r.k""",
    "f",
)
def systematic_sample(t) -> DataFrame:
    return systematic(t.frame.select("season", "status", "id"), ["season", "status"], ["id"], _quota(t))


@query("SELECT id, digest FROM (SELECT id, sha256('sample' || chr(1) || id) AS digest FROM f) ORDER BY digest, id LIMIT 200", "f")
def hash_sample(t) -> DataFrame:
    """The 200 rows with the smallest digests: a sample of fixed size."""
    digest = F.sha2(F.concat(F.lit("sample\x01"), F.col("id").cast("string")), 256)
    return t.frame.select("id", digest.alias("digest")).orderBy("digest", "id").limit(200)


_U = "('0x' || substr(sha256({parts}), 1, 7))::BIGINT / 268435456.0::DOUBLE"


@query(f"+ u AS (SELECT season, {_U.format(parts="concat_ws('|', 'split', id)")} AS u FROM f) SELECT season, count(*) AS n, count(*) FILTER (u < 0.05) AS held, round(avg(u), 6) AS mean FROM u GROUP BY season", "f")
def hash_split(t) -> DataFrame:
    u = unit_hash(F.lit("split"), F.col("id").cast("string"))
    return t.frame.select("season", u.alias("u")).groupBy("season").agg(F.count("*").alias("n"), F.count_if(F.col("u") < 0.05).alias("held"), r6(F.avg("u")).alias("mean"))


@query(
    """+ d AS (SELECT id, entity, id % 5 AS fold, (status = 'F')::INT AS y FROM f), g AS (SELECT avg(y) AS mean FROM d), s AS (SELECT entity, fold, sum(y) AS sy, count(*) AS n FROM d GROUP BY ALL),
    a AS (SELECT entity, sum(sy) AS sy, sum(n) AS n FROM s GROUP BY entity)
    SELECT d.id, round(CASE WHEN a.n > s.n THEN (a.sy - s.sy) / (a.n - s.n)::DOUBLE ELSE mean END, 6) AS encoded, round((a.sy - s.sy + 10 * mean) / (a.n - s.n + 10)::DOUBLE, 6) AS smoothed
    FROM d JOIN a ON a.entity = d.entity JOIN s ON s.entity = d.entity AND s.fold = d.fold, g""",
    "f",
)
def oof_target_encode(t) -> DataFrame:
    """Totals less the row's own fold; entities seen in no other fold get the mean; a smoothed variant beside."""
    d = t.frame.select("id", "entity", (F.col("id") % 5).alias("fold"), flag(F.col("status") == "F").alias("y"))
    parts = d.groupBy("entity", "fold").agg(F.sum("y").alias("sy"), F.count("*").alias("n"))
    w = Window.partitionBy("entity")
    other = parts.select("entity", "fold", (F.sum("sy").over(w) - F.col("sy")).alias("sy"), (F.sum("n").over(w) - F.col("n")).alias("n"))
    rows = d.join(other, ["entity", "fold"]).crossJoin(F.broadcast(d.agg(F.avg("y").alias("mean"))))
    encoded = F.when(F.col("n") > 0, F.try_divide(F.col("sy"), F.col("n"))).otherwise(F.col("mean"))
    return rows.select("id", r6(encoded).alias("encoded"), r6((F.col("sy") + 10 * F.col("mean")) / (F.col("n") + 10)).alias("smoothed"))


_FOLDS = 5


@query(
    f"""+ d AS (SELECT id, entity, (status = 'F')::INT AS y, row_number() OVER (PARTITION BY status = 'F' ORDER BY id) - 1 AS place, count(*) FILTER (status <> 'F') OVER () AS zeros FROM f),
    q AS (SELECT y, fold, count(*) AS k FROM (SELECT y, (place + CASE y WHEN 1 THEN zeros ELSE 0 END) % {_FOLDS} AS fold FROM d) GROUP BY ALL), u AS (SELECT y, fold, sum(k) OVER (PARTITION BY y ORDER BY fold) AS upto FROM q),
    x AS (SELECT d.id, d.entity, d.y, min(u.fold) AS fold FROM d JOIN u ON u.y = d.y AND d.place < u.upto GROUP BY ALL),
    s AS (SELECT fold, entity, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS sy FROM x GROUP BY ALL), o AS (SELECT a.fold, s.entity, sum(n) AS n, sum(sy) AS sy FROM s, (SELECT unnest(generate_series(0, {_FOLDS - 1})) AS fold) a WHERE s.fold <> a.fold GROUP BY ALL),
    g AS (SELECT fold, sum(sy) / sum(n) AS mean FROM o GROUP BY fold), e AS (SELECT o.fold, entity, n, sy / n AS m, mean, mean * (1 - mean) AS v, sy * (1 - sy / n) AS ss FROM o JOIN g ON g.fold = o.fold)
    SELECT x.id, x.fold, round(coalesce(CASE WHEN v = 0 THEN e.mean ELSE (v * n / (v * n + ss / n)) * m + (1 - v * n / (v * n + ss / n)) * e.mean END, g.mean), 6) AS encoded FROM x JOIN g ON g.fold = x.fold LEFT JOIN e ON e.fold = x.fold AND e.entity = x.entity""",
    "f",
)
def eb_target_encode(t) -> DataFrame:
    """Out-of-fold target means, each shrunk to the fold's mean by the variances of target and entity; contiguous folds within each class."""
    d = t.frame.select("id", "entity", flag(F.col("status") == "F").alias("y"))
    return shrunk_encoding(d, "id", "entity", "y", _FOLDS).select("id", "fold", r6("encoded").alias("encoded"))


#: The reference's counts: of rows and clusters, and of pooled folds.
REPLICATES, POOLED_REPLICATES, CLUSTER_REPLICATES = 10_000, 1_000, 10_000
_W = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 ELSE 6 END"


def _resampled_sql(cell: str, carry: str, key: str, by: str, sums: str, replicates: int) -> str:
    """CTEs up to d: by, b, size and the weighted sums of replicates 0 to replicates - 1. cell: a query of cells with their n; carry: its columns but n."""
    number = lambda p: f"(('0x' || substr(h, {p}, 7))::BIGINT + 0.5::DOUBLE) / 268435456.0::DOUBLE"
    return f"""cell AS ({cell}), unit AS (SELECT *, unnest(CASE WHEN n < 30 THEN generate_series(1, n) ELSE [0] END) AS i FROM cell),
    digest AS (SELECT *, sha256(concat_ws('|', 'boot', k, {key}, i)) AS h FROM unit, (SELECT unnest(generate_series(0, {(replicates - 1) // 4})) AS k)),
    lane AS (SELECT {carry}, n, i, k * 4 + j AS b, CASE j WHEN 0 THEN {number(1)} WHEN 1 THEN {number(15)} WHEN 2 THEN {number(29)} ELSE {number(43)} END AS u,
      CASE j WHEN 0 THEN {number(8)} WHEN 1 THEN {number(22)} WHEN 2 THEN {number(36)} ELSE {number(50)} END AS v FROM digest, (SELECT unnest([0, 1, 2, 3]) AS j)),
    z AS (SELECT *, sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS z FROM lane WHERE b < {replicates}),
    wt AS (SELECT *, CASE WHEN i > 0 THEN {_W} ELSE greatest(floor(n + sqrt(n) * z + (z * z - 1) / 6 + 0.5), 0) END AS w FROM z),
    d AS (SELECT {by}, sum(w) AS size, {sums} FROM wt GROUP BY {by})"""


_CELL_SUMS = "sum(w * y) AS sy, sum(w * (p0 - y) ** 2) AS s0, sum(w * (p1 - y) ** 2) AS s1"
_CELL_KEY = "y, round(p0 * 1e6)::BIGINT, round(p1 * 1e6)::BIGINT"
_GAIN = "1e5 * (s0 - s1) / size / ((sy / size) * (1 - sy / size))"


def _cells(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "y", "p0", "p1").agg(F.count("*").alias("n"))


def cell_key(by: list[str]):
    """The name of a cell: its ``by``, outcome and predictions in millionths."""
    micro = lambda p: F.round(F.col(p) * 1e6).cast("long").cast("string")
    return F.concat_ws("|", *[F.col(c).cast("string") for c in by], F.col("y").cast("string"), micro("p0"), micro("p1"))


def _draws(cells: DataFrame, by: list[str], first: int, last: int) -> DataFrame:
    """by, b and gain of each replicate; null for a resample of a single class."""
    sq = lambda p: (F.col(p) - F.col("y")) * (F.col(p) - F.col("y"))
    d = resampled(cells, by, cell_key(by), "n", {"sy": F.col("y"), "s0": sq("p0"), "s1": sq("p1")}, first, last)
    r = F.try_divide(F.col("sy"), F.col("size"))
    return d.withColumn("gain", F.try_divide(F.try_divide(1e5 * (F.col("s0") - F.col("s1")), F.col("size")), r * (1 - r)))


def lower_bound(rows: DataFrame, replicates: int = REPLICATES, point: float = 0.05) -> DataFrame:
    """lb5, med and replicates of the skill gained by p1 over p0 on rows (y, p0, p1), resamples of one class drawn anew."""
    cells = staged(_cells(rows, []), "cells")
    d = redrawn(lambda a, b: _draws(cells, [], a, b), F.col("gain").isNotNull(), replicates)
    q = lambda p: F.round(F.percentile("gain", F.lit(p)), 4)
    return d.agg(q(point).alias("lb5"), q(0.5).alias("med"), F.count("*").alias("replicates"))


@query(
    f"""+ {_resampled_sql("SELECT y, p0, p1, count(*) AS n FROM m WHERE season = 2023 GROUP BY ALL", "y, p0, p1", _CELL_KEY, "b", _CELL_SUMS, REPLICATES + 1000)},
    ok AS (SELECT {_GAIN} AS gain, row_number() OVER (ORDER BY b) AS k FROM d WHERE sy > 0 AND sy < size) SELECT round(quantile_cont(gain, 0.05), 4) AS lb5, round(quantile_cont(gain, 0.5), 4) AS med, count(*) AS replicates FROM ok WHERE k <= {REPLICATES}""",
    "m",
)
def bootstrap_rows(t, replicates: int = REPLICATES) -> DataFrame:
    """Paired resamples of rows: rows of equal outcome and predictions are one cell, drawn a Poisson number of times."""
    return lower_bound(t.main.where("season = 2023").select("y", "p0", "p1"), replicates)


@query(
    f"""+ {_resampled_sql("SELECT season, y, p0, p1, count(*) AS n FROM m WHERE season IN (2022, 2023) GROUP BY ALL", "season, y, p0, p1", f"season, {_CELL_KEY}", "season, b", _CELL_SUMS, POOLED_REPLICATES)},
    s AS (SELECT season, count(*) AS rows_in FROM m WHERE season IN (2022, 2023) GROUP BY season),
    p AS (SELECT b, sum(rows_in * {_GAIN}) / sum(rows_in) AS gain FROM d JOIN s USING (season) GROUP BY b)
    SELECT round(quantile_cont(gain, 0.05), 4) AS p5, round(quantile_cont(gain, 0.5), 4) AS p50, round(quantile_cont(gain, 0.95), 4) AS p95, count(*) AS replicates FROM p""",
    "m",
)
def bootstrap_pooled(t, replicates: int = POOLED_REPLICATES) -> DataFrame:
    """Gains of two folds, weighted by the folds' sizes within each replicate."""
    cells = staged(_cells(t.main.where("season IN (2022, 2023)"), ["season"]), "cells")
    sizes = cells.groupBy("season").agg(F.sum("n").alias("rows_in"))
    d = _draws(cells, ["season"], 0, replicates).join(F.broadcast(sizes), "season")
    p = d.groupBy("b").agg((F.sum(F.col("rows_in") * F.col("gain")) / F.sum("rows_in")).alias("gain"))
    return p.agg(*[F.round(F.percentile("gain", F.lit(q / 100)), 4).alias(f"p{q}") for q in (5, 50, 95)], F.count("*").alias("replicates"))


@query(
    f"""+ {_resampled_sql("SELECT pid, 1 AS n, count(*)::DOUBLE AS rows_in, sum(y) AS cy, sum((p0 - y) ** 2) AS c0, sum((p1 - y) ** 2) AS c1 FROM m WHERE season = 2023 GROUP BY pid", "pid, rows_in, cy, c0, c1", "pid", "b", "sum(w * rows_in) AS total, sum(w * cy) AS sy, sum(w * c0) AS s0, sum(w * c1) AS s1", CLUSTER_REPLICATES + 1000)},
    g AS (SELECT {_GAIN.replace("size", "total")} AS gain, row_number() OVER (ORDER BY b) AS k FROM d WHERE sy > 0 AND sy < total) SELECT round(quantile_cont(gain, 0.05), 4) AS lb5, round(quantile_cont(gain, 0.5), 4) AS med, count(*) AS replicates FROM g WHERE k <= {CLUSTER_REPLICATES}""",
    "m",
)
def bootstrap_cluster(t, replicates: int = CLUSTER_REPLICATES) -> DataFrame:
    """Clusters are summed first, so replicates multiply clusters and not rows."""
    y = F.col("y")
    sq = lambda p: F.sum((F.col(p) - y) * (F.col(p) - y))
    c = t.main.where("season = 2023").groupBy("pid").agg(F.lit(1).alias("n"), F.count("*").alias("rows_in"), F.sum("y").alias("cy"), sq("p0").alias("c0"), sq("p1").alias("c1"))
    sums = {"total": F.col("rows_in"), "sy": F.col("cy"), "s0": F.col("c0"), "s1": F.col("c1")}
    r = F.try_divide(F.col("sy"), F.col("total"))
    gain = F.try_divide(F.try_divide(1e5 * (F.col("s0") - F.col("s1")), F.col("total")), r * (1 - r)).alias("gain")
    clusters = staged(c, "clusters")
    d = redrawn(lambda a, b: resampled(clusters, [], F.col("pid").cast("string"), "n", sums, a, b).select("b", gain), F.col("gain").isNotNull(), replicates)
    return d.agg(F.round(F.percentile("gain", F.lit(0.05)), 4).alias("lb5"), F.round(F.percentile("gain", F.lit(0.5)), 4).alias("med"), F.count("*").alias("replicates"))


@query(
    """+ s AS (SELECT entity % 50 AS g, sum((status = 'F')::INT)::DOUBLE AS k, count(*)::DOUBLE AS n FROM f GROUP BY 1)
    SELECT g, round((k / n + 1.6448536269514722::DOUBLE * 1.6448536269514722::DOUBLE / (2 * n) + 1.6448536269514722::DOUBLE * sqrt((k / n) * (1 - k / n) / n + 1.6448536269514722::DOUBLE * 1.6448536269514722::DOUBLE / (4 * n * n))) / (1 + 1.6448536269514722::DOUBLE * 1.6448536269514722::DOUBLE / n), 6) AS upper FROM s""",
    "f",
)
def wilson_bound(t) -> DataFrame:
    s = t.frame.groupBy((F.col("entity") % 50).alias("g")).agg(F.sum(flag(F.col("status") == "F")).alias("k"), F.count("*").alias("n"))
    return s.select("g", r6(wilson_upper(F.col("k"), F.col("n"))).alias("upper"))


@query(
    f"+ u AS (SELECT entity % 200 AS trial, {_U.format(parts="concat_ws('|', 'null', id)")} AS d FROM f), t AS (SELECT trial, min(d) AS least FROM u GROUP BY trial) SELECT round(quantile_cont(least, 0.05), 6) AS threshold, count(*) AS trials FROM t",
    "f",
)
def null_threshold(t) -> DataFrame:
    """A quantile of the least distance of each null trial."""
    u = unit_hash(F.lit("null"), F.col("id").cast("string"))
    trials = t.frame.groupBy((F.col("entity") % 200).alias("trial")).agg(F.min(u).alias("least"))
    return trials.agg(r6(F.percentile("least", F.lit(0.05))).alias("threshold"), F.count("*").alias("trials"))
