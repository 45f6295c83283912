"""Column profiles, moments, outliers, missingness and integrity counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bias_corrected_kurtosis, bias_corrected_skew, choose, flag, r6
from ..operators.fit import with_constants
from ..operators.grouped import unpivoted
from ..operators.ranking import counted, counted_quantiles, running_totals
from .registry import query

REALS = ["rate", "prev1", "prev5", "li", "price"]
_LONG_SQL = "+ l AS (SELECT rk, season, game_type, y, unnest(['rate', 'prev1', 'prev5', 'li', 'price']) AS metric, unnest([rate, prev1, prev5, li, price]) AS value FROM m)"


#: Counts of few values, and what the shapes are called: fixed values, with their tests by skewness and kurtosis in order.
COUNTS = ["balls", "strikes", "outs"]
SHAPES = {
    "constant": "상수",
    "count": "저차원 이산 (카운트)",
    "inning": "이산 (1~13, 연장 포함)",
    "strong": "강한 우측 꼬리 (log 정규/지수적)",
    "right": "우측 꼬리",
    "left": "좌측 꼬리",
    "flat": "대략 정규/평평",
    "bell": "종 모양 (정규 근사)",
}
TAILS = [("strong", lambda s, k: s > 1.5), ("right", lambda s, k: s > 0.5), ("left", lambda s, k: s < -0.5), ("flat", lambda s, k: F.abs(k) < 1)]
_WIDE_SQL = "+ l AS (SELECT rk, unnest(['rate', 'prev1', 'prev5', 'li', 'price', 'balls', 'strikes', 'outs', 'inning']) AS metric, unnest([rate, prev1, prev5, li, price, balls, strikes, outs, inning]) AS value FROM m)"


def _long(t) -> DataFrame:
    return unpivoted(t.main.select("rk", "season", "game_type", "y", *REALS), ["rk", "season", "game_type", "y"], REALS)


@query(
    f"""{_LONG_SQL}, q AS (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY metric)
    SELECT metric, count(*) - count(value) AS missing, count(DISTINCT value) AS distinct_values, round(min(value), 6) AS lo, round(max(value), 6) AS hi, round(avg(value), 6) AS mean,
           round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.5), 6) AS med, round(quantile_cont(value, 0.99), 6) AS p99,
           count(*) FILTER (value < q1 - 1.5 * (q3 - q1)) AS low_out, count(*) FILTER (value > q3 + 1.5 * (q3 - q1)) AS high_out
    FROM l JOIN q USING (metric) GROUP BY metric""",
    "m",
)
def column_profile(t) -> DataFrame:
    """All of it from one table of distinct values and their numbers, but the missing."""
    rows = _long(t)
    counts = counted(rows, ["metric"], "value")
    q = counted_quantiles(counts, ["metric"], "value", [0.25, 0.75, 0.01, 0.5, 0.99])
    low, high = F.col("q")[0], F.col("q")[1]
    v, n = F.col("value"), F.col("n")
    centred = counts.join(F.broadcast(counts.groupBy("metric").agg((F.sum(v * n) / F.sum(n)).alias("mean"))), "metric")
    made = (
        centred.join(F.broadcast(q), "metric")
        .groupBy("metric", "q", "mean")
        .agg(
            F.count("*").alias("distinct_values"),
            r6(F.min(v)).alias("lo"),
            r6(F.max(v)).alias("hi"),
            r6(F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / (F.sum(n) - 1))).alias("sd"),
            F.sum(F.when(v < low - 1.5 * (high - low), n).otherwise(0)).alias("low_out"),
            F.sum(F.when(v > high + 1.5 * (high - low), n).otherwise(0)).alias("high_out"),
        )
    )
    missing = rows.groupBy("metric").agg(F.count_if(v.isNull()).alias("missing"))
    points = [r6(F.col("q")[i]).alias(name) for i, name in ((2, "p1"), (3, "med"), (4, "p99"))]
    return made.join(missing, "metric").select("metric", "missing", "distinct_values", "lo", "hi", r6("mean").alias("mean"), "sd", *points, "low_out", "high_out")


@query(
    f"""{_LONG_SQL}, q AS (SELECT season, metric, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM l GROUP BY season, metric)
    SELECT season, metric, round(q[1], 6) AS q05, round(q[2], 6) AS q25, round(q[3], 6) AS q50, round(q[4], 6) AS q75, round(q[5], 6) AS q95 FROM q""",
    "m",
)
def quantile_profile(t) -> DataFrame:
    points = (5, 25, 50, 75, 95)
    keys = ["season", "metric"]
    q = counted_quantiles(counted(_long(t), keys, "value"), keys, "value", [p / 100 for p in points])
    return q.select("season", "metric", *[r6(F.col("q")[i]).alias(f"q{p:02d}") for i, p in enumerate(points)])


@query(
    f"""{_WIDE_SQL}, c AS (SELECT metric, value, count(*) AS k FROM l WHERE value IS NOT NULL GROUP BY metric, value),
    top AS (SELECT metric, arg_max(value, (k, -value)) AS mode, max(k) AS k FROM c GROUP BY metric),
    s AS (SELECT metric, count(value)::DOUBLE AS n, avg(value) AS mu FROM l GROUP BY metric),
    p AS (SELECT metric, n, avg((value - mu) ** 2) AS m2, avg((value - mu) ** 3) AS m3, avg((value - mu) ** 4) AS m4 FROM l JOIN s USING (metric) GROUP BY metric, n)
    SELECT metric, round(m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2), 4) AS skew, round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6), 4) AS kurt,
           round(mode, 6) AS mode, round(k / n, 6) AS mode_share, CASE WHEN hi - lo < 1e-9 THEN '상수' WHEN metric IN ('balls', 'strikes', 'outs') THEN '저차원 이산 (카운트)' WHEN metric = 'inning' THEN '이산 (1~13, 연장 포함)'
           WHEN m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2) > 1.5 THEN '강한 우측 꼬리 (log 정규/지수적)' WHEN m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2) > 0.5 THEN '우측 꼬리' WHEN m3 / m2 ** 1.5 * sqrt(n * (n - 1)) / (n - 2) < -0.5 THEN '좌측 꼬리'
           WHEN abs((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2 ** 2 - 3) + 6)) < 1 THEN '대략 정규/평평' ELSE '종 모양 (정규 근사)' END AS shape FROM p JOIN top USING (metric) JOIN (SELECT metric, min(value) AS lo, max(value) AS hi FROM l GROUP BY metric) USING (metric)""",
    "m",
)
def describe_moments(t) -> DataFrame:
    """Bias-corrected skewness and kurtosis, the smallest of the most frequent values and its share, and the name of the distribution's shape."""
    columns = [*REALS, *COUNTS, "inning"]
    rows = unpivoted(t.main.select("rk", *[F.col(c).cast("double").alias(c) for c in columns]), ["rk"], columns).where(F.col("value").isNotNull())
    best = rows.groupBy("metric", "value").count().groupBy("metric").agg(F.max(F.struct("count", (-F.col("value")).alias("v"))).alias("top"))
    n = F.count("value").cast("double")
    made = rows.groupBy("metric").agg(
        bias_corrected_skew(n, F.skewness("value")).alias("s"), bias_corrected_kurtosis(n, F.kurtosis("value")).alias("k"), n.alias("n"), (F.max("value") - F.min("value")).alias("span")
    )
    shape = choose([(F.col("span") < 1e-9, SHAPES["constant"]), (F.col("metric").isin(COUNTS), SHAPES["count"]), (F.col("metric") == "inning", SHAPES["inning"]), *[(test(F.col("s"), F.col("k")), SHAPES[name]) for name, test in TAILS]], SHAPES["bell"])
    return made.join(best, "metric").select("metric", F.round("s", 4).alias("skew"), F.round("k", 4).alias("kurt"), r6(-F.col("top.v")).alias("mode"), r6(F.col("top.count") / F.col("n")).alias("mode_share"), shape.alias("shape"))


@query(
    f"""{_LONG_SQL}, q AS (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY metric),
    d AS (SELECT metric, quantile_cont(abs(value - med), 0.5) AS mad FROM l JOIN q USING (metric) GROUP BY metric),
    e AS (SELECT metric, list(v ORDER BY v)[1:3] AS vs FROM (SELECT DISTINCT metric, value AS v FROM l WHERE value IS NOT NULL) GROUP BY metric)
    SELECT metric, count(*) FILTER (value < q1 - 3 * (q3 - q1)) AS low3, count(*) FILTER (value > q3 + 3 * (q3 - q1)) AS high3,
           count(*) FILTER (mad > 0 AND abs(0.6745 * (value - med) / mad) > 3.5) AS mad_out, count(*) FILTER (value = 0) AS zeros,
           array_to_string(list_transform(vs, lambda x: round(x, 2)::DECIMAL(18,2)::VARCHAR), ',') AS lowest
    FROM l JOIN q USING (metric) JOIN d USING (metric) JOIN e USING (metric) GROUP BY metric, vs""",
    "m",
)
def outlier_mad(t) -> DataFrame:
    """Far fences, modified z-scores, zeros, and the three lowest distinct values, from one table of distinct values and their numbers."""
    counts = counted(_long(t), ["metric"], "value")
    q1, med, q3 = (F.col("q")[i] for i in range(3))
    v, n = F.col("value"), F.col("n")
    rows = counts.select("metric", "value", "n").join(F.broadcast(counted_quantiles(counts, ["metric"], "value", [0.25, 0.5, 0.75])), "metric")
    apart = rows.groupBy("metric", F.abs(v - med).alias("value")).agg(F.sum("n").alias("n"))
    mad = counted_quantiles(running_totals(apart, ["metric"], ["value"], ["n"]), ["metric"], "value", [0.5], "m").select("metric", F.col("m")[0].alias("mad"))
    place = F.row_number().over(Window.partitionBy("metric").orderBy("value"))
    low = counts.select("metric", "value").withColumn("k", place).where(F.col("k") <= 3)
    text = F.array_join(F.transform(F.array_sort(F.collect_list("value")), lambda x: F.round(x, 2).cast("decimal(18,2)").cast("string")), ",")
    lowest = low.groupBy("metric").agg(text.alias("lowest"))
    of = lambda c: F.sum(F.when(c, n).otherwise(0))
    made = rows.join(F.broadcast(mad), "metric").groupBy("metric").agg(
        of(v < q1 - 3 * (q3 - q1)).alias("low3"),
        of(v > q3 + 3 * (q3 - q1)).alias("high3"),
        of((F.col("mad") > 0) & (F.abs(0.6745 * F.try_divide(v - med, F.col("mad"))) > 3.5)).alias("mad_out"),
        of(v == 0).alias("zeros"),
    )
    return made.join(lowest, "metric")


@query(
    """SELECT family, count(*) AS n, count(value) AS present, count(*) FILTER (isinf(value)) AS infinite, round(min(value), 6) AS lo, round(max(value), 6) AS hi,
       round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.9), 6) AS p90 FROM h GROUP BY family""",
    "h",
)
def physics_core(t) -> DataFrame:
    v = F.col("value")
    return t.history.groupBy("family").agg(
        F.count("*").alias("n"), F.count(v).alias("present"), F.count_if(F.abs(v) == float("inf")).alias("infinite"), r6(F.min(v)).alias("lo"), r6(F.max(v)).alias("hi"),
        r6(F.avg(v)).alias("mean"), r6(F.stddev_samp(v)).alias("sd"), r6(F.percentile(v, F.lit(0.1))).alias("p10"), r6(F.percentile(v, F.lit(0.9))).alias("p90"),
    )


@query(
    """SELECT season, family, hand, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(avg((value > 30)::INT), 6) AS above, round(avg((family = CASE WHEN event_id % 3 = 0 THEN 'other' ELSE family END)::INT), 6) AS agree
       FROM h GROUP BY season, family, hand""",
    "h",
)
def physics_group(t) -> DataFrame:
    tag = F.when(F.col("event_id") % 3 == 0, "other").otherwise(F.col("family"))
    return t.history.groupBy("season", "family", "hand").agg(
        F.count("*").alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_samp("value")).alias("sd"), r6(F.avg(flag(F.col("value") > 30))).alias("above"), r6(F.avg(flag(tag == F.col("family")))).alias("agree")
    )


@query(
    "SELECT season, count(*) AS n, count(*) FILTER (rate IS NULL) AS rate_missing, count(*) FILTER (prev1 IS NULL) AS prev1_missing, round(avg((rate IS NULL OR prev1 IS NULL)::INT), 6) AS any_rate FROM m GROUP BY season",
    "m",
)
def missingness(t) -> DataFrame:
    gone = {c: F.col(c).isNull() for c in ("rate", "prev1")}
    return t.main.groupBy("season").agg(
        F.count("*").alias("n"), *[F.count_if(g).alias(f"{c}_missing") for c, g in gone.items()], r6(F.avg(flag(gone["rate"] | gone["prev1"]))).alias("any_rate")
    )


@query("SELECT (rate IS NULL)::INT || '|' || (prev1 IS NULL)::INT || '|' || (prev5 = 0)::INT AS pattern, count(*) AS n, round(avg(y), 6) AS rate FROM m GROUP BY 1", "m")
def missing_pattern(t) -> DataFrame:
    bits = [F.col("rate").isNull(), F.col("prev1").isNull(), F.col("prev5") == 0]
    return t.main.groupBy(F.concat_ws("|", *[flag(b) for b in bits]).alias("pattern")).agg(F.count("*").alias("n"), r6(F.avg("y")).alias("rate"))


@query(
    f"{_LONG_SQL} SELECT metric, round(avg(y) FILTER (value IS NULL) - avg(y) FILTER (value IS NOT NULL), 6) AS delta, count(*) FILTER (value IS NULL) AS n FROM l GROUP BY metric",
    "m",
)
def missing_target_delta(t) -> DataFrame:
    gone = F.col("value").isNull()
    return _long(t).groupBy("metric").agg(r6(F.avg(F.when(gone, F.col("y"))) - F.avg(F.when(~gone, F.col("y")))).alias("delta"), F.count_if(gone).alias("n"))


@query(
    "SELECT season, round(avg((n_p = 0)::INT), 6) AS cold, round(avg((rate IS NULL)::INT) FILTER (n_p = 0), 6) AS null_when_cold, round(avg((n_p < 100)::INT), 6) AS low_support FROM m GROUP BY season",
    "m",
)
def cold_start(t) -> DataFrame:
    cold = F.col("n_p") == 0
    return t.main.groupBy("season").agg(
        r6(F.avg(flag(cold))).alias("cold"), r6(F.avg(F.when(cold, flag(F.col("rate").isNull())))).alias("null_when_cold"), r6(F.avg(flag(F.col("n_p") < 100))).alias("low_support")
    )


@query(
    """+ a AS (SELECT bid % 1500 AS c, count(*) AS n FROM m WHERE season < 2024 GROUP BY 1), b AS (SELECT bid % 1500 AS c, count(*) AS n FROM m WHERE season >= 2024 AND bid % 13 <> 0 GROUP BY 1)
    SELECT CASE WHEN b.n IS NULL THEN 'train_only' WHEN a.n IS NULL THEN 'test_only' WHEN a.n < 20 THEN 'critical' WHEN a.n < 30 THEN 'low' ELSE 'ok' END AS support, count(*) AS categories, coalesce(sum(a.n), 0)::BIGINT AS train_rows
    FROM a FULL JOIN b USING (c) GROUP BY 1""",
    "m",
)
def category_support(t) -> DataFrame:
    rows = t.main.withColumn("c", F.col("bid") % 1500)
    a = rows.where(F.col("season") < 2024).groupBy("c").agg(F.count("*").alias("a"))
    b = rows.where((F.col("season") >= 2024) & (F.col("bid") % 13 != 0)).groupBy("c").agg(F.count("*").alias("b"))
    kind = choose([(F.col("b").isNull(), "train_only"), (F.col("a").isNull(), "test_only"), (F.col("a") < 20, "critical"), (F.col("a") < 30, "low")], "ok")
    return a.join(b, "c", "full").groupBy(kind.alias("support")).agg(F.count("*").alias("categories"), F.coalesce(F.sum("a"), F.lit(0)).alias("train_rows"))


@query(
    "+ g AS (SELECT season, month, pid, balls, strikes, outs, count(*) AS n FROM m GROUP BY ALL) SELECT season, count(*) AS states, sum(n - 1)::BIGINT AS repeats, max(n) AS most FROM g GROUP BY season",
    "m",
)
def duplicate_states(t) -> DataFrame:
    g = t.main.groupBy("season", "month", "pid", "balls", "strikes", "outs").agg(F.count("*").alias("n"))
    return g.groupBy("season").agg(F.count("*").alias("states"), F.sum(F.col("n") - 1).alias("repeats"), F.max("n").alias("most"))


@query(
    """SELECT count(*) AS n, count(DISTINCT rk) AS distinct_rows, count(*) FILTER (balls NOT BETWEEN 0 AND 3) AS balls_out, count(*) FILTER (strikes NOT BETWEEN 0 AND 2) AS strikes_out,
       count(*) FILTER (outs NOT BETWEEN 0 AND 2) AS outs_out, count(*) FILTER (month NOT BETWEEN 1 AND 12) AS month_out, count(*) FILTER (r1 + r2 + r3 > 2) AS loaded, count(*) FILTER (rate NOT BETWEEN 0 AND 1) AS rate_out,
       count(*) FILTER (prev5 > 0.5) AS prev5_out FROM m""",
    "m",
)
def integrity_counts(t) -> DataFrame:
    broken = {
        "balls_out": ~F.col("balls").between(0, 3), "strikes_out": ~F.col("strikes").between(0, 2), "outs_out": ~F.col("outs").between(0, 2), "month_out": ~F.col("month").between(1, 12),
        "loaded": F.col("r1") + F.col("r2") + F.col("r3") > 2, "rate_out": ~F.col("rate").between(0, 1), "prev5_out": F.col("prev5") > 0.5,
    }
    return t.main.agg(F.count("*").alias("n"), F.countDistinct("rk").alias("distinct_rows"), *[F.count_if(c).alias(k) for k, c in broken.items()])


# fixed values: occupied bases by the flags of the first, second and third
BASES = ["", "1", "2", "12", "3", "13", "23", "123"]
_TOKEN = f"[{', '.join(repr(b) for b in BASES)}][(r1 + 2 * r2 + 4 * r3)::INT + 1]"


@query(
    f"""+ d AS (SELECT *, CASE WHEN bid % 97 = 0 THEN 2 ELSE r1 END AS f1, r1 + r2 + r3 + (bid % 101 = 0)::INT AS runners, CASE WHEN pid % 7 = 0 AND bid % 50 = 0 THEN '9' ELSE {_TOKEN} END AS base, abs(diff) AS top, 3 AS bottom, abs(diff) + 3 + (bid % 89 = 0)::INT AS total FROM m)
    SELECT count(*) FILTER (balls NOT BETWEEN 0 AND 3 OR strikes NOT BETWEEN 0 AND 2 OR outs NOT BETWEEN 0 AND 2) AS count_range, count(*) FILTER (f1 NOT IN (0, 1)) + count(*) FILTER (r2 NOT IN (0, 1)) + count(*) FILTER (r3 NOT IN (0, 1)) AS runner_flag_domain,
      count(*) FILTER (runners <> f1 + r2 + r3) AS runner_count_mismatch, count(*) FILTER (f1 = 2 OR base <> {_TOKEN}) AS base_state_mismatch, count(*) FILTER (total <> top + bottom) AS run_total_mismatch FROM d""",
    "m",
)
def invariant_audit(t) -> DataFrame:
    """Violations of the state's invariants; the fields that the table lacks are made from it, some of them wrong."""
    token = lambda first: F.get(F.array(*[F.lit(b) for b in BASES]), (first + 2 * F.col("r2") + 4 * F.col("r3")).cast("int"))
    d = t.main.select(
        "balls", "strikes", "outs", "r2", "r3",
        F.when(F.col("bid") % 97 == 0, 2).otherwise(F.col("r1")).alias("f1"),
        (F.col("r1") + F.col("r2") + F.col("r3") + flag(F.col("bid") % 101 == 0)).alias("runners"),
        F.when((F.col("pid") % 7 == 0) & (F.col("bid") % 50 == 0), "9").otherwise(token(F.col("r1"))).alias("base"),
        F.abs("diff").alias("top"), F.lit(3).alias("bottom"), (F.abs("diff") + 3 + flag(F.col("bid") % 89 == 0)).alias("total"),
    )
    flags = [F.col("f1"), F.col("r2"), F.col("r3")]
    legal = F.when(F.col("f1").isin(0, 1) & F.col("r2").isin(0, 1) & F.col("r3").isin(0, 1), token(F.col("f1")))
    return d.agg(
        F.count_if(~F.col("balls").between(0, 3) | ~F.col("strikes").between(0, 2) | ~F.col("outs").between(0, 2)).alias("count_range"),
        sum((F.count_if(~f.isin(0, 1)) for f in flags[1:]), F.count_if(~flags[0].isin(0, 1))).alias("runner_flag_domain"),
        F.count_if(F.col("runners") != sum(flags[1:], flags[0])).alias("runner_count_mismatch"),
        F.count_if(legal.isNull() | (F.col("base") != legal)).alias("base_state_mismatch"),
        F.count_if(F.col("total") != F.col("top") + F.col("bottom")).alias("run_total_mismatch"),
    )


@query(
    """SELECT season, count(*) FILTER (n_p < 0) AS negative, count(*) FILTER (rate IS NULL AND n_p > 0) AS null_with_support, count(*) FILTER (rate IS NOT NULL AND n_p = 0) AS rate_without_support,
       count(*) FILTER (abs(coalesce(rate, 0) + coalesce(prev1, 0) - 1) > 0.05) AS sum_off FROM m GROUP BY season""",
    "m",
)
def asof_domain(t) -> DataFrame:
    total = F.coalesce("rate", F.lit(0.0)) + F.coalesce("prev1", F.lit(0.0))
    return t.main.groupBy("season").agg(
        F.count_if(F.col("n_p") < 0).alias("negative"),
        F.count_if(F.col("rate").isNull() & (F.col("n_p") > 0)).alias("null_with_support"),
        F.count_if(F.col("rate").isNotNull() & (F.col("n_p") == 0)).alias("rate_without_support"),
        F.count_if(F.abs(total - 1) > 0.05).alias("sum_off"),
    )


@query(
    """SELECT count(*) AS n, count(*) - count(DISTINCT event_id) AS repeated_ids, count(*) - count(DISTINCT (uid, date_trunc('hour', ts))) AS repeated_keys, count(*) FILTER (ts IS NULL) AS no_date,
       count(*) FILTER (year(ts) <> 2024) AS other_year, count(*) FILTER (season NOT BETWEEN 2019 AND 2024) AS other_season FROM h""",
    "h",
)
def history_audit(t) -> DataFrame:
    return t.history.agg(
        F.count("*").alias("n"),
        (F.count("*") - F.countDistinct("event_id")).alias("repeated_ids"),
        (F.count("*") - F.countDistinct(F.struct("uid", F.date_trunc("hour", "ts")))).alias("repeated_keys"),
        F.count_if(F.col("ts").isNull()).alias("no_date"),
        F.count_if(F.year("ts") != 2024).alias("other_year"),
        F.count_if(~F.col("season").between(2019, 2024)).alias("other_season"),
    )


_RESIDUE_SQL = """+ r AS (SELECT season, unnest(['balls', 'strikes', 'outs']) AS field, unnest([balls, strikes, outs]) AS value, unnest([3, 1, 2]) AS top FROM m)"""


def _residue(t) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.lit(top).alias("top")) for f, top in (("balls", 3), ("strikes", 1), ("outs", 2))])
    return t.main.select("season", F.inline(fields)).where(F.col("value") > F.col("top"))


@query(f"{_RESIDUE_SQL} SELECT field, value::INT AS value, 'out_of_domain' AS reason, count(*) AS n FROM r WHERE value > top GROUP BY field, value", "m")
def residue_manifest(t) -> DataFrame:
    """Why rows fall out of the legal context, by field and value."""
    return _residue(t).groupBy("field", "value").agg(F.count("*").alias("n")).select("field", "value", F.lit("out_of_domain").alias("reason"), "n")


@query(f"{_RESIDUE_SQL} SELECT field, season, count(*) AS n FROM r WHERE value > top GROUP BY GROUPING SETS ((field, season), (field), (season), ())", "m")
def concentration(t) -> DataFrame:
    return _residue(t).cube("field", "season").agg(F.count("*").alias("n"))


@query(
    """SELECT season, count(*) FILTER (lower(trim(' ' || upper(family) || ' ')) IN ('fastball', 'breaking', 'offspeed')) AS known, count(*) FILTER (family = 'other') AS other, count(DISTINCT family) AS kinds,
       (count(DISTINCT family) = 4)::INT AS complete FROM h GROUP BY season""",
    "h",
)
def taxonomy_check(t) -> DataFrame:
    name = F.lower(F.trim(F.concat(F.lit(" "), F.upper("family"), F.lit(" "))))
    return t.history.groupBy("season").agg(
        F.count_if(name.isin("fastball", "breaking", "offspeed")).alias("known"), F.count_if(name == "other").alias("other"), F.countDistinct(name).alias("kinds"), flag(F.countDistinct(name) == 4).alias("complete")
    )


@query(
    """SELECT 'li' AS field, count(*) AS n, round(avg(y), 6) AS rate FROM m WHERE li > 3.5 UNION ALL SELECT 'n_p', count(*), round(avg(y), 6) FROM m WHERE n_p > 480
    UNION ALL SELECT 'diff', count(*), round(avg(y), 6) FROM m WHERE abs(diff) >= 5""",
    "m",
)
def domain_extremes(t) -> DataFrame:
    extreme = {"li": F.col("li") > 3.5, "n_p": F.col("n_p") > 480, "diff": F.abs("diff") >= 5}
    hits = F.array(*[F.when(c, F.lit(k)) for k, c in extreme.items()])
    return t.main.select("y", F.explode(F.array_compact(hits)).alias("field")).groupBy("field").agg(F.count("*").alias("n"), r6(F.avg("y")).alias("rate"))


@query(
    "+ s AS (SELECT status, sha256(concat_ws('|', id, entity, season)) AS d FROM f) SELECT status, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS digest FROM s GROUP BY status",
    "f",
)
def frame_hash(t) -> DataFrame:
    """An order-free digest of each group's rows: digests of 256 hash buckets, joined in order, would scale it
    further; the contract here is one digest over the sorted row digests of a group."""
    rows = t.frame.select("status", F.sha2(F.concat_ws("|", "id", "entity", "season"), 256).alias("d"))
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("digest"))


@query(f"{_LONG_SQL} SELECT game_type, metric, round(avg(value), 6) AS mean FROM l GROUP BY game_type, metric", "m")
def long_means(t) -> DataFrame:
    return _long(t).groupBy("game_type", "metric").agg(r6(F.avg("value")).alias("mean"))


@query("+ g AS (SELECT avg(price) AS mu, stddev_pop(price) AS sd FROM m) SELECT season, count(*) FILTER (abs(price - mu) > 1.5 * sd) AS far FROM m, g GROUP BY season", "m")
def far_prices(t) -> DataFrame:
    rows = with_constants(t.main, t.main, mu=F.avg("price"), sd=F.stddev_pop("price"))
    return rows.groupBy("season").agg(F.count_if(F.abs(F.col("price") - F.col("mu")) > 1.5 * F.col("sd")).alias("far"))
