"""Drift between seasons, correlations and entity turnover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag, r6
from ..operators import drift as ops
from ..operators import scoring
from ..operators.fit import with_constants
from ..operators.grouped import shares, total_variation
from ..operators.ranking import average_ranks, exact_quantiles, ordinal_positions
from .profiles import _LONG_SQL, _long
from .registry import query


@query(
    f"""{_LONG_SQL}, s AS (SELECT metric, avg(value) FILTER (season = 2023) AS m1, var_samp(value) FILTER (season = 2023) AS v1, count(value) FILTER (season = 2023) AS n1,
      avg(value) FILTER (season = 2024) AS m2, var_samp(value) FILTER (season = 2024) AS v2, count(value) FILTER (season = 2024) AS n2,
      var_pop(value) FILTER (season = 2023) AS w1, var_pop(value) FILTER (season = 2024) AS w2, avg(value) AS mf, stddev_pop(value) AS sf FROM l GROUP BY metric)
    SELECT metric, round((m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS pooled_sample, round((m2 - mf) / sf, 6) AS full_panel, round((m2 - m1) / sqrt((w1 + w2) / 2), 6) AS pooled_population FROM s""",
    "m",
)
def drift_smd(t) -> DataFrame:
    old, new = (F.when(F.col("season") == s, F.col("value")) for s in (2023, 2024))
    s = _long(t).groupBy("metric").agg(
        *[f(c).alias(f"{name}{i}") for i, c in ((1, old), (2, new)) for name, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count), ("w", F.var_pop))],
        F.avg("value").alias("mf"),
        F.stddev_pop("value").alias("sf"),
    )
    c = F.col
    return s.select(
        "metric",
        r6(ops.smd_pooled_sample(c("m1"), c("v1"), c("n1"), c("m2"), c("v2"), c("n2"))).alias("pooled_sample"),
        r6(ops.smd_full_panel(c("m2"), c("mf"), c("sf"))).alias("full_panel"),
        r6(ops.smd_pooled_population(c("m1"), c("w1"), c("m2"), c("w2"))).alias("pooled_population"),
    )


@query(
    """+ r AS (SELECT game_type, y, row_number() OVER (PARTITION BY game_type ORDER BY prev1 NULLS LAST, rk, price) AS k FROM m),
    s AS (SELECT game_type, avg(k) FILTER (y = 1) AS a, avg(k) FILTER (y = 0) AS b, count(*) AS n FROM r GROUP BY game_type)
    SELECT game_type, round(2 * (a - b) / n, 6) AS rank_biserial FROM s""",
    "m",
)
def rank_biserial(t) -> DataFrame:
    """From ordinal ranks, nulls last; equal values are ordered by the row key."""
    order = [F.col("prev1").asc_nulls_last(), F.col("rk"), F.col("price")]
    r = ordinal_positions(t.main.select("game_type", "y", "prev1", "rk", "price"), ["game_type"], order, "k")
    mean = lambda y: F.avg(F.when(F.col("y") == y, F.col("k")))
    return r.groupBy("game_type").agg(r6(2 * (mean(1) - mean(0)) / F.count("*")).alias("rank_biserial"))


@query(
    """+ c AS (SELECT season, balls * 3 + strikes AS s, count(*) AS n FROM m GROUP BY ALL), p AS (SELECT season, s, n / sum(n) OVER (PARTITION BY season)::DOUBLE AS p FROM c)
    SELECT season, round(0.5 * sum(d), 6) AS tv FROM (
      SELECT coalesce(a.season, b.season + 1) AS season, abs(coalesce(a.p, 0) - coalesce(b.p, 0)) AS d FROM p a FULL JOIN p b ON a.s = b.s AND a.season = b.season + 1)
    WHERE season BETWEEN 2020 AND 2025 GROUP BY season""",
    "m",
)
def tv_distance(t) -> DataFrame:
    p = shares(t.main.withColumn("s", F.col("balls") * 3 + F.col("strikes")), ["season"], "s")
    before = p.withColumn("season", F.col("season") + 1)
    return total_variation(p, before, "s", ["season"]).where(F.col("season").between(2020, 2025)).select("season", r6("tv").alias("tv"))


@query(
    """+ s AS (SELECT family, season, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n FROM h GROUP BY family, season)
    SELECT b.family, b.season, round(b.mu - a.mu, 6) AS delta, round((b.mu - a.mu) / a.sd, 6) AS scaled, round(b.sd / a.sd, 6) AS sd_ratio, b.n - a.n AS dn FROM s a JOIN s b ON a.family = b.family AND b.season = a.season + 1""",
    "h",
)
def season_shift(t) -> DataFrame:
    s = t.history.groupBy("family", "season").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"), F.count("*").alias("n"))
    w = Window.partitionBy("family").orderBy("season")
    prev = {c: F.lag(c).over(w) for c in ("season", "mu", "sd", "n")}
    s = s.select("*", *[p.alias(f"p_{c}") for c, p in prev.items()]).where(F.col("p_season") == F.col("season") - 1)
    gap = F.col("mu") - F.col("p_mu")
    return s.select("family", "season", r6(gap).alias("delta"), r6(gap / F.col("p_sd")).alias("scaled"), r6(F.col("sd") / F.col("p_sd")).alias("sd_ratio"), (F.col("n") - F.col("p_n")).alias("dn"))


GRID = (0.1, 0.5, 0.9)
CATEGORIES, ENTITIES = ("game_type", "tb", "dow", "inning"), ("pid", "bid")
_SIDES = "unnest([season, season + 1]) AS season, unnest([1, -1]) AS side"

_BOUNDARY_SQL = f"""{_LONG_SQL}, s AS (SELECT metric, season, avg(value) AS mu, var_pop(value) AS v, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.9) AS q90, avg((value IS NULL)::INT) AS gone FROM l WHERE season < 2025 GROUP BY metric, season),
    n AS (SELECT n.metric, n.season, (n.mu - o.mu) / sqrt((n.v + o.v) / 2) AS smd, n.q10 - o.q10 AS q10, n.q50 - o.q50 AS q50, n.q90 - o.q90 AS q90, 100 * (n.gone - o.gone) AS pp FROM s n JOIN s o ON n.metric = o.metric AND n.season = o.season + 1),
    c AS (UNPIVOT (SELECT season, {", ".join(f"{c}::VARCHAR AS {c}" for c in CATEGORIES)} FROM m WHERE season < 2025) ON {", ".join(CATEGORIES)} INTO NAME col VALUE val),
    cn AS (SELECT col, season, val, count(*) / sum(count(*)) OVER (PARTITION BY col, season) AS share FROM c GROUP BY col, season, val),
    cs AS (SELECT col, val, share, {_SIDES} FROM cn), cd AS (SELECT col, season, val, sum(side * share) AS d, max(side) AS later, min(side) AS earlier FROM cs GROUP BY col, season, val),
    e AS (SELECT season, 'pid' AS col, count(DISTINCT pid) AS k FROM m WHERE season < 2025 GROUP BY season UNION ALL SELECT season, 'bid', count(DISTINCT bid) FROM m WHERE season < 2025 GROUP BY season),
    b AS (SELECT 'numeric_smd' AS family, metric AS key, season, round(smd, 6) AS change FROM n
      UNION ALL SELECT 'quantile_change', metric || ':' || p, season, round(q, 6) FROM (SELECT metric, season, unnest(['0.1', '0.5', '0.9']) AS p, unnest([q10, q50, q90]) AS q FROM n)
      UNION ALL SELECT 'missing_rate_pp', metric, season, round(pp, 6) FROM n
      UNION ALL SELECT 'categorical_tv', col, season, round(0.5 * sum(abs(d)), 6) FROM cd GROUP BY col, season HAVING max(later) = 1 AND min(earlier) = -1
      UNION ALL SELECT 'entity_change', x.col, x.season, round((x.k - o.k) / o.k::DOUBLE, 6) FROM e x JOIN e o ON x.col = o.col AND x.season = o.season + 1)"""


def _boundaries(t) -> DataFrame:
    """family, key, season and change of each season against the one before: five families."""
    s = _long(t).where(F.col("season") < 2025).groupBy("metric", "season").agg(
        F.avg("value").alias("mu"), F.var_pop("value").alias("v"), F.percentile("value", F.array(*[F.lit(p) for p in GRID])).alias("q"), F.avg(flag(F.col("value").isNull())).alias("gone")
    )
    w = Window.partitionBy("metric").orderBy("season")
    s = s.select("*", *[F.lag(c).over(w).alias(f"o_{c}") for c in ("season", "mu", "v", "q", "gone")]).where(F.col("o_season") == F.col("season") - 1)
    row = lambda family, key, change: F.struct(F.lit(family).alias("family"), key.alias("key"), r6(change).alias("change"))
    numeric = s.select("season", F.inline(F.array(
        row("numeric_smd", F.col("metric"), ops.smd_pooled_population(F.col("o_mu"), F.col("o_v"), F.col("mu"), F.col("v"))),
        *[row("quantile_change", F.concat("metric", F.lit(f":{p}")), F.get("q", F.lit(i)) - F.get("o_q", F.lit(i))) for i, p in enumerate(GRID)],
        row("missing_rate_pp", F.col("metric"), 100 * (F.col("gone") - F.col("o_gone"))),
    )))
    rows = t.main.where(F.col("season") < 2025)
    # a season's shares stand for its own boundary and, negative, for the next one
    counted = rows.select("season", *[F.col(c).cast("string").alias(c) for c in CATEGORIES]).unpivot(["season"], list(CATEGORIES), "key", "val").groupBy("key", "season", "val").count()
    counted = counted.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy("key", "season")))
    sides = F.inline(F.array(*[F.struct((F.col("season") + k).alias("at"), F.lit(1 - 2 * k).alias("side")) for k in (0, 1)]))
    gaps = counted.select("key", "val", "share", sides).groupBy("key", "at", "val").agg(F.sum(F.col("side") * F.col("share")).alias("d"), F.max("side").alias("later"), F.min("side").alias("earlier"))
    tv = gaps.groupBy("key", "at").agg((0.5 * F.sum(F.abs("d"))).alias("tv"), F.max("later").alias("later"), F.min("earlier").alias("earlier")).where("later = 1 AND earlier = -1")
    many = rows.groupBy("season").agg(*[F.count_distinct(c).alias(c) for c in ENTITIES])
    before = Window.orderBy("season")
    many = many.select("*", F.lag("season").over(before).alias("o_season"), *[F.lag(c).over(before).alias(f"o_{c}") for c in ENTITIES]).where(F.col("o_season") == F.col("season") - 1)
    entities = many.select("season", F.inline(F.array(*[row("entity_change", F.lit(c), (F.col(c) - F.col(f"o_{c}")) / F.col(f"o_{c}")) for c in ENTITIES])))
    tv = tv.select(F.col("at").alias("season"), F.lit("categorical_tv").alias("family"), "key", r6("tv").alias("change"))
    return numeric.unionByName(tv).unionByName(entities).select("family", "key", "season", "change")


@query(f"{_BOUNDARY_SQL} SELECT * FROM b", "m")
def boundary_families(t) -> DataFrame:
    return _boundaries(t)


@query(
    f"""{_BOUNDARY_SQL}, p AS (SELECT family, key, max(abs(change)) AS past, count(*) - count(change) AS nulls FROM b WHERE season < 2024 GROUP BY family, key)
    SELECT b.family, b.key, change, past, (nulls = 0 AND abs(change) > past)::INT AS exceeds FROM b JOIN p ON b.family = p.family AND b.key = p.key WHERE season = 2024""",
    "m",
)
def boundary_exceeds(t) -> DataFrame:
    """The last boundary against the largest of all before it."""
    past = F.when(F.col("season") < 2024, F.col("change"))
    made = _boundaries(t).groupBy("family", "key").agg(
        F.max(F.when(F.col("season") == 2024, F.col("change"))).alias("change"),
        F.max(F.abs(past)).alias("past"),
        F.count_if((F.col("season") < 2024) & F.col("change").isNull()).alias("nulls"),
    )
    return made.select("family", "key", "change", "past", flag(ops.boundary_exceeds(F.col("change"), F.col("past"), F.col("nulls"))).alias("exceeds"))


# fixed values: how much worse the 95 % point of each family may get
GUARDRAILS = {"categorical_tv": 0.005, "numeric_smd": 0.02, "quantile_change": 0.02, "missing_rate_pp": 0.05, "entity_change": 0.01}


@query(
    f"""{_BOUNDARY_SQL}, p AS (SELECT family, key, abs(max(change) FILTER (season = 2023)) AS cur, abs(max(change) FILTER (season = 2024)) AS cand FROM b GROUP BY family, key),
    f AS (SELECT family, count(*) FILTER (cur IS NOT NULL AND cand IS NOT NULL) AS n, count(*) FILTER (cur IS NOT NULL AND cand IS NULL) AS lost,
      quantile_cont(cur, 0.5) FILTER (cand IS NOT NULL) AS cm, quantile_cont(cand, 0.5) FILTER (cur IS NOT NULL) AS nm, quantile_cont(cur, 0.95) FILTER (cand IS NOT NULL) AS c95, quantile_cont(cand, 0.95) FILTER (cur IS NOT NULL) AS n95 FROM p GROUP BY family),
    g AS (SELECT *, CASE family {" ".join(f"WHEN '{k}' THEN {v}" for k, v in GUARDRAILS.items())} END AS rail FROM f),
    gated AS (SELECT *, CASE WHEN lost > 0 OR n = 0 THEN 'FAIL_CLOSED' WHEN nm <= cm + 1e-12 AND n95 <= c95 + rail THEN 'PASS' ELSE 'FAIL' END AS status FROM g)
    SELECT family, n, round(cm, 6) AS current_med, round(nm, 6) AS candidate_med, round(c95, 6) AS current_p95, round(n95, 6) AS candidate_p95, status, (status = 'PASS' AND nm < cm - 1e-12)::INT AS strict,
      CASE WHEN cm IS NULL OR nm IS NULL OR cm <= 1e-12 THEN 'FAIL_CLOSED' WHEN nm <= cm * 0.75 + 1e-12 THEN 'PASS' ELSE 'FAIL' END AS reduced,
      CASE WHEN bool_or(status = 'FAIL_CLOSED') OVER () THEN 'FAIL_CLOSED' WHEN bool_and(status = 'PASS') OVER () AND sum((status = 'PASS' AND nm < cm - 1e-12)::INT) OVER () >= 3 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM gated""",
    "m",
)
def family_gate(t) -> DataFrame:
    """The distances of the last boundary against those of the one before, by family; the verdict asks all families and three strict gains."""
    at = lambda s: F.abs(F.max(F.when(F.col("season") == s, F.col("change"))))
    pairs = _boundaries(t).groupBy("family", "key").agg(at(2023).alias("current"), at(2024).alias("candidate"))
    every = Window.partitionBy()
    strict = flag(F.col("strict"))
    verdict = F.when(F.bool_or(F.col("status") == "FAIL_CLOSED").over(every), "FAIL_CLOSED").when(
        F.bool_and(F.col("status") == "PASS").over(every) & (F.sum(strict).over(every) >= 3), "PASS"
    ).otherwise("FAIL")
    gate = scoring.family_gate(pairs, GUARDRAILS)
    return gate.select(
        "family", "n", *[r6(c).alias(c) for c in ("current_med", "candidate_med", "current_p95", "candidate_p95")], "status", strict.alias("strict"),
        scoring.relative_reduction(F.col("current_med"), F.col("candidate_med"), 0.25).alias("reduced"), verdict.alias("verdict"),
    )


@query("SELECT season, id FROM (SELECT season, id, row_number() OVER (PARTITION BY season ORDER BY id) AS k FROM f WHERE status = 'F') WHERE k <= 100", "f")
def bounded_first_n(t) -> DataFrame:
    """The first hundred true positions of each season in source order."""
    k = F.row_number().over(Window.partitionBy("season").orderBy("id"))
    return t.frame.where(F.col("status") == "F").withColumn("k", k).where(F.col("k") <= 100).select("season", "id")


@query(
    """+ b AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY id) <= 200 AS inside FROM f), g AS (SELECT avg(amount) AS mf, stddev_pop(amount) AS sf FROM f)
    SELECT season, round((avg(amount) FILTER (inside) - max(mf)) / max(sf), 6) AS smd, round(count(DISTINCT entity) FILTER (inside) / count(DISTINCT entity)::DOUBLE, 6) AS coverage, count(*) FILTER (inside) AS n
    FROM b, g GROUP BY season""",
    "f",
)
def bounded_vs_full(t) -> DataFrame:
    placed = ordinal_positions(t.frame, ["season"], [F.col("id")])
    rows = with_constants(placed.withColumn("inside", F.col("position") < 200), t.frame, mf=F.avg("amount"), sf=F.stddev_pop("amount"))
    part = lambda c: F.when(F.col("inside"), F.col(c))
    return rows.groupBy("season").agg(
        r6(ops.smd_full_panel(F.avg(part("amount")), F.max("mf"), F.max("sf"))).alias("smd"), r6(F.count_distinct(part("entity")) / F.count_distinct("entity")).alias("coverage"), F.count_if("inside").alias("n")
    )


@query(
    "+ r AS (SELECT season, status, least(19, ((row_number() OVER (PARTITION BY season ORDER BY id) - 1) * 20) // count(*) OVER (PARTITION BY season)) AS bin FROM f) SELECT season, bin::INT AS bin, count(*) AS n, count(*) FILTER (status = 'F') AS hits FROM r GROUP BY season, bin",
    "f",
)
def rank_bins(t) -> DataFrame:
    placed = ordinal_positions(t.frame.select("season", "status", "id"), ["season"], [F.col("id")])
    bins = F.least(F.lit(19), F.floor(F.col("position") * 20 / F.col("total"))).cast("int")
    return placed.select("season", "status", bins.alias("bin")).groupBy("season", "bin").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "F").alias("hits"))


_PAIRS = [("rate", "prev1"), ("rate", "prev5"), ("rate", "li"), ("prev1", "prev5"), ("prev5", "price")]


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count({a} + {b}) AS n FROM m" for a, b in _PAIRS) + ")",
    "m",
)
def corr_matrix(t) -> DataFrame:
    """All pairs in one pass, then one row each."""
    one = t.main.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.corr(a, b)).alias("r"), F.count(F.col(a) + F.col(b)).alias("n")).alias(f"p{i}") for i, (a, b) in enumerate(_PAIRS)])
    return one.select(F.inline(F.array(*[F.col(f"p{i}") for i in range(len(_PAIRS))])))


_RANKS_SQL = """+ r AS (SELECT season, rank() OVER (PARTITION BY season ORDER BY n_p) + (count(*) OVER (PARTITION BY season, n_p) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY season ORDER BY prev5) + (count(*) OVER (PARTITION BY season, prev5) - 1) / 2.0::DOUBLE AS b FROM m),
    s AS (SELECT season, corr(a, b) AS rho FROM r GROUP BY season)"""


def _spearman(t) -> DataFrame:
    rows = average_ranks(t.main.select("season", "n_p", "prev5"), "n_p", "a", ["season"])
    rows = average_ranks(rows, "prev5", "b", ["season"])
    return rows.groupBy("season").agg(F.corr("a", "b").alias("rho"))


@query(f"{_RANKS_SQL} SELECT season, round(rho, 6) AS rho FROM s", "m")
def spearman(t) -> DataFrame:
    return _spearman(t).select("season", r6("rho").alias("rho"))


@query(f"{_RANKS_SQL} SELECT count(*) FILTER (rho > 0) AS pos, count(*) FILTER (rho < 0) AS neg, (count(*) FILTER (rho <> 0) >= 4 AND greatest(count(*) FILTER (rho > 0), count(*) FILTER (rho < 0)) >= 0.8 * count(*) FILTER (rho <> 0))::INT AS stable FROM s", "m")
def sign_stability(t) -> DataFrame:
    pos, neg = F.count_if(F.col("rho") > 0), F.count_if(F.col("rho") < 0)
    return _spearman(t).agg(pos.alias("pos"), neg.alias("neg"), flag((pos + neg >= 4) & (F.greatest(pos, neg) >= 0.8 * (pos + neg))).alias("stable"))


@query(
    f"{_LONG_SQL}, s AS (SELECT metric, season, avg(value) AS mv, avg(y) AS my FROM l GROUP BY metric, season) SELECT metric, round(corr(mv, my), 6) AS r FROM s GROUP BY metric",
    "m",
)
def season_mean_corr(t) -> DataFrame:
    s = _long(t).groupBy("metric", "season").agg(F.avg("value").alias("mv"), F.avg("y").alias("my"))
    return s.groupBy("metric").agg(r6(F.corr("mv", "my")).alias("r"))


@query(
    f"""{_LONG_SQL}, s AS (SELECT metric, season, avg(value) AS mv FROM l GROUP BY metric, season), d AS (SELECT metric, season, sign(mv - lag(mv) OVER (PARTITION BY metric ORDER BY season)) AS g FROM s),
    e AS (SELECT metric, g, first_value(g) OVER (PARTITION BY metric ORDER BY season) AS first FROM d WHERE g IS NOT NULL) SELECT metric, round(avg((g = first)::INT), 6) AS monotone FROM e GROUP BY metric""",
    "m",
)
def season_mono(t) -> DataFrame:
    s = _long(t).groupBy("metric", "season").agg(F.avg("value").alias("mv"))
    w = Window.partitionBy("metric").orderBy("season")
    d = s.withColumn("g", F.signum(F.col("mv") - F.lag("mv").over(w))).where(F.col("g").isNotNull())
    return d.withColumn("first", F.first("g").over(w)).groupBy("metric").agg(r6(F.avg(flag(F.col("g") == F.col("first")))).alias("monotone"))


@query(
    """+ s AS (SELECT game_type, season, avg(y) AS r, ln(avg(y) / (1 - avg(y))) AS z FROM m WHERE season < 2024 GROUP BY ALL)
    SELECT game_type, round(regr_slope(r, season), 6) + 0.0 AS slope, round(regr_intercept(r, season) + 2024 * regr_slope(r, season), 6) AS next, round(regr_intercept(z, season) + 2024 * regr_slope(z, season), 6) AS next_logit FROM s GROUP BY game_type""",
    "m",
)
def trend_extrapolate(t) -> DataFrame:
    r = F.avg("y")
    s = t.main.where("season < 2024").groupBy("game_type", "season").agg(r.alias("r"), F.log(r / (1 - r)).alias("z"))
    ahead = lambda c: F.regr_intercept(c, F.col("season")) + 2024 * F.regr_slope(c, F.col("season"))
    return s.groupBy("game_type").agg((r6(F.regr_slope(F.col("r"), F.col("season"))) + 0.0).alias("slope"), r6(ahead(F.col("r"))).alias("next"), r6(ahead(F.col("z"))).alias("next_logit"))


@query("SELECT season, count(DISTINCT pid) AS pitchers, count(DISTINCT bid) AS batters, round(count(*) / count(DISTINCT pid)::DOUBLE, 6) AS per_pitcher FROM m GROUP BY season", "m")
def entity_coverage(t) -> DataFrame:
    return t.main.groupBy("season").agg(F.countDistinct("pid").alias("pitchers"), F.countDistinct("bid").alias("batters"), r6(F.count("*") / F.countDistinct("pid")).alias("per_pitcher"))


@query(
    """+ a AS (SELECT DISTINCT bid FROM m WHERE season = 2023 AND month <= 3), b AS (SELECT DISTINCT bid FROM m WHERE season = 2024 AND month <= 3)
    SELECT (SELECT count(*) FROM a) AS old, (SELECT count(*) FROM b) AS new, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_new""",
    "m",
)
def entity_overlap(t) -> DataFrame:
    seen = t.main.where((F.col("month") <= 3) & F.col("season").isin(2023, 2024)).groupBy("bid").agg(F.max(F.col("season") == 2023).alias("a"), F.max(F.col("season") == 2024).alias("b"))
    a, b = F.col("a"), F.col("b")
    return seen.agg(F.count_if(a).alias("old"), F.count_if(b).alias("new"), F.count_if(a & b).alias("both"), F.count_if(b & ~a).alias("only_new"))


@query(
    "+ d AS (SELECT entity, season, min(season) OVER (PARTITION BY entity) AS debut FROM (SELECT DISTINCT entity, season FROM f)) SELECT season, count(*) FILTER (season = debut) AS fresh, count(*) FILTER (season > debut) AS returning FROM d GROUP BY season",
    "f",
)
def id_turnover(t) -> DataFrame:
    d = t.frame.select("entity", "season").distinct().withColumn("debut", F.min("season").over(Window.partitionBy("entity")))
    return d.groupBy("season").agg(F.count_if(F.col("season") == F.col("debut")).alias("fresh"), F.count_if(F.col("season") > F.col("debut")).alias("returning"))


@query(
    "+ d AS (SELECT bid, min(season) AS debut FROM m GROUP BY bid) SELECT season, round(avg((season = debut)::INT), 6) AS rookie_share, round(avg(y) FILTER (season = debut), 6) AS rookie_rate FROM m JOIN d USING (bid) GROUP BY season",
    "m",
)
def debut_cohort(t) -> DataFrame:
    debut = t.main.groupBy("bid").agg(F.min("season").alias("debut"))
    rookie = F.col("season") == F.col("debut")
    return t.main.join(debut, "bid").groupBy("season").agg(r6(F.avg(flag(rookie))).alias("rookie_share"), r6(F.avg(F.when(rookie, F.col("y")))).alias("rookie_rate"))


@query(
    """+ s AS (SELECT pid, season, avg(y) AS r, count(*) AS n FROM m GROUP BY pid, season HAVING count(*) >= 50) SELECT a.season, count(*) AS pairs, round(corr(a.r, b.r), 6) AS r FROM s a JOIN s b ON a.pid = b.pid AND b.season = a.season + 1 GROUP BY a.season""",
    "m",
)
def id_repeatability(t) -> DataFrame:
    s = t.main.groupBy("pid", "season").agg(F.avg("y").alias("r"), F.count("*").alias("n")).where(F.col("n") >= 50)
    ahead = s.select("pid", (F.col("season") - 1).alias("season"), F.col("r").alias("next"))
    return s.join(ahead, ["pid", "season"]).groupBy("season").agg(F.count("*").alias("pairs"), r6(F.corr("r", "next")).alias("r"))


@query(
    """+ s AS (SELECT pid, avg(y) AS r, var_samp(y) AS v, count(*)::DOUBLE AS n FROM m GROUP BY pid HAVING count(*) >= 2), g AS (SELECT var_samp(r) AS between_v, sum(v * (n - 1)) / sum(n - 1) AS within_v, avg(n) AS k FROM s)
    SELECT round(between_v, 8) AS between_v, round(within_v, 8) AS within_v, round(greatest(0, between_v - within_v / k) / (greatest(0, between_v - within_v / k) + within_v), 8) AS icc FROM g""",
    "m",
)
def icc(t) -> DataFrame:
    s = t.main.groupBy("pid").agg(F.avg("y").alias("r"), F.var_samp("y").alias("v"), F.count("*").alias("n")).where(F.col("n") >= 2)
    g = s.agg(F.var_samp("r").alias("b"), (F.sum(F.col("v") * (F.col("n") - 1)) / F.sum(F.col("n") - 1)).alias("w"), F.avg("n").alias("k"))
    true = F.greatest(F.lit(0.0), F.col("b") - F.col("w") / F.col("k"))
    return g.select(F.round("b", 8).alias("between_v"), F.round("w", 8).alias("within_v"), F.round(true / (true + F.col("w")), 8).alias("icc"))


def _ids_sql() -> str:
    return "i AS (SELECT 'pid' AS kind, pid AS id, season, y FROM m UNION ALL SELECT 'bid', bid % 200, season, y FROM m), s AS (SELECT kind, id, season, avg(y) AS r, count(*) AS n FROM i GROUP BY ALL)"


def _ids(t) -> DataFrame:
    """kind, id, season, r and n of both kinds of entity."""
    each = F.inline(F.array(F.struct(F.lit("pid").alias("kind"), F.col("pid").alias("id")), F.struct(F.lit("bid").alias("kind"), (F.col("bid") % 200).alias("id"))))
    return t.main.select("season", "y", each)


@query(
    f"""+ {_ids_sql()}, u AS (SELECT kind, id, sum(n) AS used FROM s GROUP BY ALL), q AS (SELECT kind, quantile_cont(used, 0.4) AS low, quantile_cont(used, 0.6) AS high FROM u GROUP BY kind),
    g AS (SELECT u.kind, id, CASE WHEN used < low THEN 'low' WHEN used <= high THEN 'middle' ELSE 'high' END AS usage FROM u JOIN q ON q.kind = u.kind)
    SELECT a.kind, a.season, usage, count(*) AS ids, round(corr(a.r, b.r), 6) AS r FROM s a JOIN s b ON a.kind = b.kind AND a.id = b.id AND b.season = a.season + 1 JOIN g ON g.kind = a.kind AND g.id = a.id
    WHERE a.n >= 30 GROUP BY a.kind, a.season, usage HAVING count(*) >= 10""",
    "m",
)
def usage_repeatability(t) -> DataFrame:
    """Correlation of rates of adjacent seasons by how much an entity was used: below the 40 %, above the 60 % point, and between. Groups under ten entities are left out."""
    s = _ids(t).groupBy("kind", "id", "season").agg(F.avg("y").alias("r"), F.count("*").alias("n"))
    used = s.groupBy("kind", "id").agg(F.sum("n").alias("used"))
    q = F.col("q")
    usage = F.when(F.col("used") < q[0], "low").when(F.col("used") <= q[1], "middle").otherwise("high")
    # two rows, one a kind
    used = used.join(F.broadcast(exact_quantiles(used, ["kind"], "used", [0.4, 0.6])), "kind").select("kind", "id", usage.alias("usage"))
    ahead = s.select("kind", "id", (F.col("season") - 1).alias("season"), F.col("r").alias("next"))
    pairs = s.where("n >= 30").join(ahead, ["kind", "id", "season"]).join(used, ["kind", "id"])
    return pairs.groupBy("kind", "season", "usage").agg(F.count("*").alias("ids"), r6(F.corr("r", "next")).alias("r")).where("ids >= 10")


@query(
    f"""+ {_ids_sql()}, t AS (SELECT kind, var_samp(y) AS total FROM i GROUP BY kind), e AS (SELECT kind, id, avg(y) AS r FROM i GROUP BY ALL), b AS (SELECT kind, var_samp(r) AS between_v FROM e GROUP BY kind),
    w AS (SELECT kind, avg(v) AS within_v FROM (SELECT kind, id, var_samp(r) AS v FROM s GROUP BY kind, id) GROUP BY kind), d AS (SELECT i.kind, avg((y - r) ** 2) AS rest FROM i JOIN s ON s.kind = i.kind AND s.id = i.id AND s.season = i.season GROUP BY i.kind)
    SELECT kind, round(total, 8) AS total, round(between_v, 8) AS between_v, round(within_v, 8) AS within_v, round(rest, 8) AS rest, round(between_v / total, 8) AS icc_id, round(between_v / (between_v + within_v), 8) AS icc_season
    FROM t JOIN b USING (kind) JOIN w USING (kind) JOIN d USING (kind)""",
    "m",
)
def id_variance(t) -> DataFrame:
    """How much of the target's variance lies between entities, between an entity's seasons, and within a season."""
    ids, y = _ids(t), F.col("y")
    s = ids.groupBy("kind", "id", "season").agg(F.avg("y").alias("r"), F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(y * y).alias("sq"))
    n, rest = F.sum("n"), F.sum(F.col("sq") - F.col("sy") * F.col("r"))
    whole = s.groupBy("kind").agg(((F.sum("sq") - F.sum("sy") * F.sum("sy") / n) / (n - 1)).alias("total"), (rest / n).alias("rest"))
    of = s.groupBy("kind", "id").agg((F.sum("sy") / F.sum("n")).alias("r"), F.var_samp("r").alias("v"))
    between = of.groupBy("kind").agg(F.var_samp("r").alias("b"), F.avg("v").alias("w"))
    eighth = lambda c: F.round(c, 8)
    b, w = F.col("b"), F.col("w")
    return whole.join(between, "kind").select("kind", eighth("total").alias("total"), eighth(b).alias("between_v"), eighth(w).alias("within_v"), eighth("rest").alias("rest"), eighth(b / F.col("total")).alias("icc_id"), eighth(b / (b + w)).alias("icc_season"))
