"""Row features: projections without shuffles, and the few whose constants are fitted first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import choose, classify_value, cut, cut_code, flag, lexical_kind, logit, parse_date, r6, recency_weight, right_closed, smoothed_rate
from ..operators.encode import fit_scaler, scaled, vocabulary_codes
from ..operators.fit import with_constants, with_group_value
from ..operators.ranking import exact_quantiles, ordinal_positions, running_before
from .registry import query

TRAIN = "season < 2024"


@query(
    "SELECT rk, season, balls, strikes, y FROM m WHERE game_type = 'R'",
    "m",
)
def scan_project(t) -> DataFrame:
    return t.main.where(F.col("game_type") == "R").select("rk", "season", "balls", "strikes", "y")


@query("SELECT id, entity, season FROM f WHERE season IN (1996, 1997) AND status = 'F'", "f")
def scan_scoped(t) -> DataFrame:
    return t.frame.where(F.col("season").isin(1996, 1997) & (F.col("status") == "F")).select("id", "entity", "season")


@query(
    """SELECT rk, ph * 2 + bh AS platoon, balls * 3 + strikes AS count_state, round((month - 3) / 7.0::DOUBLE, 6) AS season_progress,
       round(inning / 9.0::DOUBLE, 6) AS inning_norm, (ph = bh)::INT AS hand_match, abs(diff) AS score_abs, round(ln(1 + n_p), 6) AS log_n,
       (game_type = 'F')::INT AS is_f FROM m""",
    "m",
)
def feat_basic(t) -> DataFrame:
    return t.main.select(
        "rk",
        (F.col("ph") * 2 + F.col("bh")).alias("platoon"),
        (F.col("balls") * 3 + F.col("strikes")).alias("count_state"),
        r6((F.col("month") - 3) / 7).alias("season_progress"),
        r6(F.col("inning") / 9).alias("inning_norm"),
        flag(F.col("ph") == F.col("bh")).alias("hand_match"),
        F.abs("diff").alias("score_abs"),
        r6(F.log1p("n_p")).alias("log_n"),
        flag(F.col("game_type") == "F").alias("is_f"),
    )


@query(
    """SELECT rk, round(coalesce(prev1 - rate, 0), 6) AS recent_gap, (prev1 IS NULL AND n_p < 100)::INT AS return_gap,
       (n_p = 0)::INT AS debut_p, (n_b = 0)::INT AS debut_b, round(prev1 - prev5, 6) AS form_trend,
       round(prev1 - rate, 6) AS diff1, round(prev5 - rate, 6) AS diff5 FROM m""",
    "m",
)
def feat_gap(t) -> DataFrame:
    return t.main.select(
        "rk",
        r6(F.coalesce(F.col("prev1") - F.col("rate"), F.lit(0.0))).alias("recent_gap"),
        flag(F.col("prev1").isNull() & (F.col("n_p") < 100)).alias("return_gap"),
        flag(F.col("n_p") == 0).alias("debut_p"),
        flag(F.col("n_b") == 0).alias("debut_b"),
        r6(F.col("prev1") - F.col("prev5")).alias("form_trend"),
        *[r6(F.col(f"prev{k}") - F.col("rate")).alias(f"diff{k}") for k in (1, 5)],
    )


@query(
    """SELECT rk, CASE WHEN n_p IS NULL OR n_p <= 0 THEN 0 WHEN n_p <= 1 THEN 0 WHEN n_p <= 10 THEN 1 WHEN n_p <= 50 THEN 2 WHEN n_p <= 100 THEN 3 ELSE 4 END AS asof_n_bucket FROM m""",
    "m",
)
def feat_bucket(t) -> DataFrame:
    return t.main.select("rk", right_closed(F.col("n_p"), [0, 1, 10, 50, 100]).alias("asof_n_bucket"))


# fixed values: bounds (right-closed) of the crosses' cells
LI_EDGES = [0, 0.5, 1.0, 1.5, 2.0, 99]
RATE_EDGES = [0, 0.45, 0.475, 0.50, 0.525, 0.55, 1.0]
DIFF_EDGES = [-99, -3, -1, 1, 3, 99]


@query(
    """SELECT rk, (abs(diff) <= 1)::INT AS close_game, (r2 + r3 > 0 AND li >= 1)::INT AS risp_li, (balls = 3 AND strikes = 2 AND outs = 2)::INT AS full_two_out,
       (balls = 3 AND strikes = 2 AND ph = bh)::INT AS full_same_hand,
       CASE WHEN outs BETWEEN 0 AND 2 THEN (r1::VARCHAR || r2 || r3) || '|' || outs ELSE '__MISSING__' END AS base_out,
       (ph * 2 + bh) * 12 + balls * 3 + strikes AS hand_count,
       (balls * 3 + strikes) * 5 + CASE WHEN li > 0 AND li <= 0.5 THEN 0 WHEN li > 0.5 AND li <= 1 THEN 1 WHEN li > 1 AND li <= 1.5 THEN 2 WHEN li > 1.5 AND li <= 2 THEN 3 WHEN li > 2 AND li <= 99 THEN 4 ELSE 0 END AS count_li,
       2 * CASE WHEN rate > 0.45 AND rate <= 0.475 THEN 1 WHEN rate > 0.475 AND rate <= 0.5 THEN 2 WHEN rate > 0.5 AND rate <= 0.525 THEN 3 WHEN rate > 0.525 AND rate <= 0.55 THEN 4 WHEN rate > 0.55 AND rate <= 1 THEN 5 ELSE 0 END + ph AS cond_pitcher,
       2 * CASE WHEN li > 0.5 AND li <= 1 THEN 1 WHEN li > 1 AND li <= 1.5 THEN 2 WHEN li > 1.5 AND li <= 2 THEN 3 WHEN li > 2 AND li <= 99 THEN 4 ELSE 0 END + bh AS li_batter,
       CASE WHEN diff > -99 AND diff <= -3 THEN 0 WHEN diff > -3 AND diff <= -1 THEN 4 WHEN diff > -1 AND diff <= 1 THEN 8 WHEN diff > 1 AND diff <= 3 THEN 12 WHEN diff > 3 AND diff <= 99 THEN 16 END + month % 4 AS sdiff_month FROM m""",
    "m",
)
def feat_cross(t) -> DataFrame:
    """Flags of rare states and cells of two variables each; values outside a cut count as its first cell, but a score difference has none then."""
    state = F.col("balls") * 3 + F.col("strikes")
    full = (F.col("balls") == 3) & (F.col("strikes") == 2)
    close = F.abs("diff")
    return t.main.select(
        "rk",
        flag(close <= 1).alias("close_game"),
        flag((F.col("r2") + F.col("r3") > 0) & (F.col("li") >= 1)).alias("risp_li"),
        flag(full & (F.col("outs") == 2)).alias("full_two_out"),
        flag(full & (F.col("ph") == F.col("bh"))).alias("full_same_hand"),
        F.when(F.col("outs").between(0, 2), F.concat_ws("|", F.concat("r1", "r2", "r3"), "outs")).otherwise("__MISSING__").alias("base_out"),
        ((F.col("ph") * 2 + F.col("bh")) * 12 + state).alias("hand_count"),
        (state * 5 + F.coalesce(cut_code(F.col("li"), LI_EDGES), F.lit(0))).alias("count_li"),
        (F.coalesce(cut_code(F.col("rate"), RATE_EDGES), F.lit(0)) * 2 + F.col("ph")).alias("cond_pitcher"),
        (F.coalesce(cut_code(F.col("li"), LI_EDGES), F.lit(0)) * 2 + F.col("bh")).alias("li_batter"),
        (cut_code(F.col("diff"), DIFF_EDGES) * 4 + F.col("month") % 4).alias("sdiff_month"),
    )


# fixed values: bounds (right-closed) and labels of the domain's groups
PHASES = [0, 3, 6, 9, 99], ["1-3", "4-6", "7-9", "10+"]
PITCHES = [-1, 25, 50, 75, 100, 10000], ["0-25", "26-50", "51-75", "76-100", "100+"]
USAGE = [-1, 0, 50, 200, 500, 1500, 5000, 1e9], ["0(신규)", "1~50", "51~200", "201~500", "501~1500", "1501~5000", "5000+"]
LEVERAGE = [-0.01, 0.5, 1.0, 2.0, 100], ["<0.5", "0.5-1.0", "1.0-2.0", ">2.0"]


def _sql_cut(column: str, edges: list[float], labels: list[str]) -> str:
    steps = "".join(f" WHEN {column} <= {edge} THEN '{label}'" for edge, label in zip(edges[1:], labels, strict=True))
    return f"CASE WHEN {column} <= {edges[0]} THEN NULL{steps} END"


@query(
    f"""SELECT rk, balls || '-' || strikes AS count_text,
       CASE WHEN balls - strikes <= -1 THEN 'pitcher_ahead(0-1,0-2,1-2,2-2)' WHEN balls - strikes >= 2 THEN 'batter_ahead(3-0,3-1,2-0)' WHEN balls - strikes = 1 THEN 'batter_slight(1-0,2-1,3-2)' ELSE 'even(0-0,1-1)' END AS count_role,
       CASE WHEN ph = bh THEN 'same_hand' ELSE 'opp_hand' END AS platoon, CASE ph WHEN 1 THEN 'L' WHEN 2 THEN 'R' END || '-' || CASE bh WHEN 1 THEN 'L' WHEN 2 THEN 'R' END AS platoon_detail,
       CASE WHEN r1 + r2 + r3 = 3 THEN 'bases_loaded' WHEN r2 = 1 OR r3 = 1 THEN 'risp' WHEN r1 + r2 + r3 > 0 THEN 'runner_no_risp' ELSE 'none' END AS runner_pressure,
       {_sql_cut("inning", *PHASES)} AS phase, {_sql_cut("n_p", *PITCHES)} AS pitches, {_sql_cut("n_p", *USAGE)} AS usage, {_sql_cut("li", *LEVERAGE)} AS li_bucket,
       CASE WHEN abs(diff) <= 1 THEN 'close(<=1)' WHEN abs(diff) <= 3 THEN 'mod(2-3)' WHEN abs(diff) <= 5 THEN 'gapped(4-5)' ELSE 'blowout(>=6)' END AS score_bucket,
       CASE WHEN diff > 0 THEN 'leading' WHEN diff < 0 THEN 'trailing' ELSE 'tied' END AS lead_dir,
       CASE WHEN tb = 'T' THEN 'away_attack(T)' ELSE 'home_attack(B)' END AS side, CASE WHEN season >= 2023 THEN '2023-24' ELSE '2019-22' END AS recent,
       CASE balls * 3 + strikes WHEN 11 THEN '풀카운트(3-2)' WHEN 1 THEN '스트라이크우위(0-1)' WHEN 9 THEN '볼우위(3-0/3-1)' WHEN 10 THEN '볼우위(3-0/3-1)' WHEN 0 THEN '시작(0-0)' ELSE '기타' END AS count_group,
       CASE WHEN balls > 3 THEN 'na' ELSE balls::VARCHAR || '-' || strikes || CASE WHEN season >= 2024 THEN '_ABS' ELSE '_PRE' END END AS regime_count FROM m""",
    "m",
)
def feat_labels(t) -> DataFrame:
    gap, state = F.col("balls") - F.col("strikes"), F.col("balls") * 3 + F.col("strikes")
    text, apart = F.concat("balls", F.lit("-"), "strikes"), F.abs("diff")
    on = F.col("r1") + F.col("r2") + F.col("r3")
    hand = lambda c: F.when(F.col(c) == 1, "L").when(F.col(c) == 2, "R")
    return t.main.select(
        "rk",
        text.alias("count_text"),
        choose([(gap <= -1, "pitcher_ahead(0-1,0-2,1-2,2-2)"), (gap >= 2, "batter_ahead(3-0,3-1,2-0)"), (gap == 1, "batter_slight(1-0,2-1,3-2)")], "even(0-0,1-1)").alias("count_role"),
        F.when(F.col("ph") == F.col("bh"), "same_hand").otherwise("opp_hand").alias("platoon"),
        F.concat(hand("ph"), F.lit("-"), hand("bh")).alias("platoon_detail"),
        choose([(on == 3, "bases_loaded"), ((F.col("r2") == 1) | (F.col("r3") == 1), "risp"), (on > 0, "runner_no_risp")], "none").alias("runner_pressure"),
        cut(F.col("inning"), *PHASES).alias("phase"),
        cut(F.col("n_p"), *PITCHES).alias("pitches"),
        cut(F.col("n_p"), *USAGE).alias("usage"),
        cut(F.col("li"), *LEVERAGE).alias("li_bucket"),
        choose([(apart <= 1, "close(<=1)"), (apart <= 3, "mod(2-3)"), (apart <= 5, "gapped(4-5)")], "blowout(>=6)").alias("score_bucket"),
        choose([(F.col("diff") > 0, "leading"), (F.col("diff") < 0, "trailing")], "tied").alias("lead_dir"),
        F.when(F.col("tb") == "T", "away_attack(T)").otherwise("home_attack(B)").alias("side"),
        F.when(F.col("season") >= 2023, "2023-24").otherwise("2019-22").alias("recent"),
        choose([(state == 11, "풀카운트(3-2)"), (state == 1, "스트라이크우위(0-1)"), (state.isin(9, 10), "볼우위(3-0/3-1)"), (state == 0, "시작(0-0)")], "기타").alias("count_group"),
        F.when(F.col("balls") > 3, "na").otherwise(F.concat(text, F.when(F.col("season") >= 2024, "_ABS").otherwise("_PRE"))).alias("regime_count"),
    )


@query(
    """SELECT rk, (rate IS NULL)::INT AS rate_missing, (prev1 IS NULL)::INT AS prev1_missing, (rate IS NULL AND prev1 IS NULL)::INT AS all_missing,
       (n_p = 0)::INT AS n_zero, (n_p <= 10)::INT AS n_low FROM m""",
    "m",
)
def feat_missing(t) -> DataFrame:
    return t.main.select(
        "rk",
        *[flag(F.col(c).isNull()).alias(f"{c}_missing") for c in ("rate", "prev1")],
        flag(F.coalesce("rate", "prev1").isNull()).alias("all_missing"),
        flag(F.col("n_p") == 0).alias("n_zero"),
        flag(F.col("n_p") <= 10).alias("n_low"),
    )


@query(
    """SELECT rk, round(ln(least(greatest(rate, 0.001), 0.999) / (1 - least(greatest(rate, 0.001), 0.999))), 6) + 0.0 AS rate,
       round(ln(least(greatest(prev1, 0.001), 0.999) / (1 - least(greatest(prev1, 0.001), 0.999))), 6) + 0.0 AS prev1 FROM m WHERE rate IS NOT NULL AND prev1 IS NOT NULL""",
    "m",
)
def feat_logit(t) -> DataFrame:
    rows = t.main.where(F.col("rate").isNotNull() & F.col("prev1").isNotNull())
    return rows.select("rk", *[(r6(logit(F.col(c), 1e-3)) + 0.0).alias(c) for c in ("rate", "prev1")])


@query(
    """+ e AS (SELECT quantile_cont(rate, 1/3.0) AS a, quantile_cont(rate, 2/3.0) AS b FROM m WHERE season < 2024)
    SELECT rk, CASE WHEN rate IS NULL THEN 1 WHEN rate <= a THEN 0 WHEN rate <= b THEN 1 ELSE 2 END * 12 + balls * 3 + strikes AS cell FROM m, e WHERE balls <= 3""",
    "m",
)
def feat_binned_product(t) -> DataFrame:
    third = F.percentile("rate", F.array(F.lit(1 / 3), F.lit(2 / 3)))
    rows = with_constants(t.main.where(F.col("balls") <= 3), t.main.where(TRAIN), edges=third)
    code = choose([(F.col("rate").isNull(), 1), (F.col("rate") <= F.col("edges")[0], 0), (F.col("rate") <= F.col("edges")[1], 1)], 2)
    return rows.select("rk", (code * 12 + F.col("balls") * 3 + F.col("strikes")).alias("cell"))


@query(
    """+ med AS (SELECT r1 * 4 + r2 * 2 + r3 AS base, quantile_cont(li, 0.5) AS mid FROM m WHERE season < 2024 GROUP BY 1),
    e AS (SELECT list_sort(list_distinct(quantile_cont(li, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS edges FROM m WHERE season < 2024)
    SELECT rk, CASE WHEN mid IS NULL THEN -1 ELSE len(list_filter(edges[2:], lambda x: x < mid)) END::INT AS base_code, balls * 3 + strikes AS count_code,
           (r1 + r2 + r3) * 3 + CASE WHEN li > 1 AND li <= 2 THEN 1 WHEN li > 2 AND li <= 1e9 THEN 2 ELSE 0 END AS runner_li
    FROM m LEFT JOIN med ON med.base = r1 * 4 + r2 * 2 + r3, e""",
    "m",
)
def feat_interaction(t) -> DataFrame:
    """The fifth of leverage that holds the base state's median (-1 for an unseen one), the count, and runners with fixed classes of leverage."""
    base = F.col("r1") * 4 + F.col("r2") * 2 + F.col("r3")
    train = t.main.where(TRAIN).select(base.alias("base"), "li")
    middles = exact_quantiles(train, ["base"], "li", [0.5]).select("base", F.col("q")[0].alias("mid"))
    # one row; equal edges count once
    edges = exact_quantiles(train.withColumn("all", F.lit(0)), ["all"], "li", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).select(F.array_distinct("q").alias("edges"))
    code = F.size(F.filter("edges", lambda e, i: (i > 0) & (e < F.col("mid"))))
    codes = middles.crossJoin(F.broadcast(edges)).select("base", code.alias("code"))
    return t.main.withColumn("base", base).join(F.broadcast(codes), "base", "left").select(
        "rk",
        F.coalesce("code", F.lit(-1)).alias("base_code"),
        (F.col("balls") * 3 + F.col("strikes")).alias("count_code"),
        ((F.col("r1") + F.col("r2") + F.col("r3")) * 3 + F.coalesce(cut_code(F.col("li"), [-1, 1, 2, 1e9]), F.lit(0))).alias("runner_li"),
    )


@query(
    """+ s AS (SELECT season, avg(rate) AS mean FROM m WHERE season < 2024 GROUP BY season), a AS (SELECT avg(rate) AS mean, max_by(mean, season) FILTER (mean IS NOT NULL) AS latest FROM (SELECT NULL::DOUBLE AS rate, season, mean FROM s)),
    g AS (SELECT avg(rate) AS mean FROM m WHERE season < 2024)
    SELECT rk, round(m.rate - g.mean, 6) AS dev, round(m.rate / coalesce(s.mean, a.latest), 6) AS ratio FROM m LEFT JOIN s USING (season), a, g WHERE m.rate IS NOT NULL""",
    "m",
)
def feat_trend(t) -> DataFrame:
    train = t.main.where(TRAIN)
    rows = with_group_value(t.main.where(F.col("rate").isNotNull()), train, ["season"], few=True, s_mean=F.avg("rate"))
    by_season = train.groupBy("season").agg(F.avg("rate").alias("s"))
    rows = with_constants(rows, by_season, latest=F.max_by("s", "season"))
    rows = with_constants(rows, train, mean=F.avg("rate"))
    return rows.select("rk", r6(F.col("rate") - F.col("mean")).alias("dev"), r6(F.col("rate") / F.coalesce("s_mean", "latest")).alias("ratio"))


@query(
    """+ c AS (SELECT n_p, count(*) AS k FROM m WHERE season < 2024 GROUP BY n_p), d AS (SELECT n_p, sum(k) OVER (ORDER BY n_p) - k AS below, sum(k) OVER () AS n FROM c)
    SELECT rk, round(row_number() OVER (PARTITION BY season ORDER BY m.n_p, rk) / count(*) OVER (PARTITION BY season)::DOUBLE, 6) AS ordinal,
           round((SELECT coalesce(max(d.below + c.k), 0) FROM d JOIN c USING (n_p) WHERE d.n_p < m.n_p) / (SELECT max(n) FROM d)::DOUBLE, 6) AS cdf FROM m""",
    "m",
)
def usage_rank(t) -> DataFrame:
    """Ordinal rank within the season, and the share of training values strictly below."""
    # one row for each distinct value, whether or not it occurs in training; nulls are below nothing
    counts = t.main.groupBy("n_p").agg(F.count_if(F.expr(TRAIN) & F.col("n_p").isNotNull()).alias("k"))
    cdf = running_before(counts, [F.col("n_p")], "k", "under").select(F.col("n_p").alias("v"), "under")
    placed = ordinal_positions(t.main.select("rk", "season", "n_p"), ["season"], [F.col("n_p"), F.col("rk")])
    rows = with_constants(placed.join(cdf, F.col("n_p").eqNullSafe(F.col("v"))), t.main.where(TRAIN), n=F.count("*"))
    return rows.select("rk", r6((F.col("position") + 1) / F.col("total")).alias("ordinal"), r6(F.col("under") / F.col("n")).alias("cdf"))


@query(
    """+ g AS (SELECT avg(rate) AS prior FROM m WHERE season < 2024)
    SELECT rk, round((n_p * rate + 50 * prior) / (n_p + 50), 6) AS s50, round((n_p * rate + 200 * prior) / (n_p + 200), 6) AS s200, round((n_p * rate + 500 * prior) / (n_p + 500), 6) AS s500 FROM m, g""",
    "m",
)
def smooth_rate(t) -> DataFrame:
    rows = with_constants(t.main, t.main.where(TRAIN), prior=F.avg("rate"))
    return rows.select("rk", *[r6(smoothed_rate(F.col("n_p"), F.col("rate"), F.col("prior"), m)).alias(f"s{m}") for m in (50, 200, 500)])


@query(
    """+ r AS (SELECT season >= 2023 AS late, avg(rate) AS pitcher, avg(prev1) AS batter FROM m WHERE season < 2025 GROUP BY 1), g AS (SELECT avg(rate) AS pitcher, avg(prev1) AS batter FROM m WHERE season < 2025)
    SELECT rk, round(CASE WHEN n_p = 0 THEN coalesce(r.pitcher, g.pitcher) ELSE m.rate END, 6) AS rate, round(CASE WHEN n_b = 0 THEN coalesce(r.batter, g.batter) ELSE m.prev1 END, 6) AS batter_rate
    FROM m LEFT JOIN r ON r.late = (season >= 2023), g""",
    "m",
)
def impute_regime(t) -> DataFrame:
    """Rates of first appearances from the mean of their regime over all training rows, for pitchers and for batters."""
    known = t.main.where(F.col("season") < 2025).withColumn("late", F.col("season") >= 2023)
    means = {"pitcher": F.avg("rate"), "batter": F.avg("prev1")}
    rows = with_group_value(t.main.withColumn("late", F.col("season") >= 2023), known, ["late"], few=True, **{f"r_{k}": v for k, v in means.items()})
    rows = with_constants(rows, known, **means)
    filled = lambda n, kind, rate: r6(F.when(F.col(n) == 0, F.coalesce(f"r_{kind}", kind)).otherwise(F.col(rate)))
    return rows.select("rk", filled("n_p", "pitcher", "rate").alias("rate"), filled("n_b", "batter", "prev1").alias("batter_rate"))


@query(
    """+ v AS (SELECT status, row_number() OVER (ORDER BY status) AS code FROM (SELECT DISTINCT priority AS status FROM f WHERE season < 1997)),
    s AS (SELECT season, row_number() OVER (ORDER BY season) AS code FROM (SELECT DISTINCT season FROM f WHERE season < 1997))
    SELECT id, coalesce(v.code, 0)::INT AS priority_code, coalesce(s.code, 0)::INT AS season_code FROM f LEFT JOIN v ON v.status = f.priority LEFT JOIN s ON s.season = f.season""",
    "f",
)
def encode_vocab(t) -> DataFrame:
    train = t.frame.where(F.col("season") < 1997)
    rows = vocabulary_codes(t.frame, train, "priority", "priority_code")
    return vocabulary_codes(rows, train, "season", "season_code").select("id", "priority_code", "season_code")


@query(
    """+ s AS (SELECT avg(rate) AS mr, stddev_pop(rate) AS sr, avg(li) AS ml, stddev_pop(li) AS sl FROM m WHERE season < 2024)
    SELECT rk, round(least(greatest((coalesce(rate, mr) - mr) / CASE WHEN sr > 0 THEN sr ELSE 1 END, -5), 5), 6) + 0.0 AS rate_z,
           round(least(greatest((coalesce(li, ml) - ml) / CASE WHEN sl > 0 THEN sl ELSE 1 END, -5), 5), 6) + 0.0 AS li_z, (rate IS NULL OR li IS NULL)::INT AS any_missing FROM m, s""",
    "m",
)
def zscore_encode(t) -> DataFrame:
    columns = ["rate", "li"]
    rows = scaled(t.main, fit_scaler(t.main.where(TRAIN), columns), columns)
    return rows.select("rk", *[(r6(f"{c}_z") + 0.0).alias(f"{c}_z") for c in columns], flag(F.col("rate").isNull() | F.col("li").isNull()).alias("any_missing"))


@query(
    """+ s AS (SELECT min(season) AS a, max(season) AS b FROM m), d AS (SELECT season, count(*) AS n FROM m GROUP BY season)
    SELECT season, n, 1.0::DOUBLE AS uniform, round(1 + (season - a) / (b - a)::DOUBLE, 6) AS linear, round(pow(2, (season - a) / (b - a)::DOUBLE), 6) AS exponential,
           CASE WHEN season < (a + b) / 2.0 THEN 0.5 ELSE 1.5 END::DOUBLE AS step FROM d, s""",
    "m",
)
def season_weights(t) -> DataFrame:
    seasons = t.main.groupBy("season").agg(F.count("*").alias("n"))
    rows = with_constants(seasons, seasons, first=F.min("season"), last=F.max("season"))
    kinds = ("uniform", "linear", "exponential", "step")
    return rows.select("season", "n", *[r6(recency_weight(k, F.col("season"), F.col("first"), F.col("last"))).alias(k) for k in kinds])


@query(
    """+ d AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN month(ts) || '/' || day(ts) || '/' || year(ts) WHEN 2 THEN '2/30/2024' WHEN 3 THEN '' END AS raw, ts FROM h)
    SELECT event_id, CASE WHEN event_id % 5 < 2 THEN strftime(ts, '%Y-%m-%d') END AS day,
           CASE WHEN raw IS NULL OR raw = '' THEN 'missing' WHEN event_id % 5 < 2 THEN CASE WHEN year(ts) = 2024 THEN 'ok' ELSE 'year_mismatch' END ELSE 'invalid' END AS status FROM d""",
    "h",
)
def date_route(t) -> DataFrame:
    k = F.col("event_id") % 5
    slashed = F.concat(F.month("ts"), F.lit("/"), F.dayofmonth("ts"), F.lit("/"), F.year("ts"))
    raw = choose([(k == 0, F.date_format("ts", "yyyy-MM-dd")), (k == 1, slashed), (k == 2, "2/30/2024"), (k == 3, "")])
    rows = t.history.select("event_id", raw.alias("raw")).withColumn("parsed", parse_date(F.col("raw")))
    status = choose([(F.col("raw").isNull() | (F.col("raw") == ""), "missing"), (F.col("parsed").isNull(), "invalid"), (F.year("parsed") != 2024, "year_mismatch")], "ok")
    return rows.select("event_id", F.date_format("parsed", "yyyy-MM-dd").alias("day"), status.alias("status"))


_RAW_SQL = "CASE event_id % 8 WHEN 0 THEN (event_id % 5)::VARCHAR WHEN 1 THEN ' 2' WHEN 2 THEN '1.5' WHEN 3 THEN 'x' WHEN 4 THEN '' WHEN 5 THEN 'NaN' WHEN 6 THEN '1e2' END"


def _raw_tokens(t) -> DataFrame:
    k = F.col("event_id") % 8
    values = [(F.col("event_id") % 5).cast("string"), " 2", "1.5", "x", "", "NaN", "1e2"]
    return t.history.select("event_id", choose([(k == i, v) for i, v in enumerate(values)]).alias("raw"))


@query(
    f"""+ d AS (SELECT event_id, {_RAW_SQL} AS raw FROM h)
    SELECT CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'missing' WHEN raw = 'x' THEN 'unparseable' WHEN raw = 'NaN' THEN 'nonfinite' WHEN raw = '1.5' THEN 'non_integer'
                WHEN raw = '1e2' OR raw = '4' THEN 'out_of_domain' ELSE 'legal' END AS kind, count(*) AS n FROM d GROUP BY 1""",
    "h",
)
def value_classify(t) -> DataFrame:
    return _raw_tokens(t).groupBy(classify_value(F.col("raw"), 0, 3).alias("kind")).agg(F.count("*").alias("n"))


@query(
    f"""+ d AS (SELECT event_id, {_RAW_SQL} AS raw FROM h)
    SELECT CASE WHEN raw IS NULL OR raw = '' THEN 'empty' WHEN raw <> trim(raw) THEN 'whitespace_variant' WHEN regexp_full_match(raw, '[+-]?[0-9]+') THEN 'integer_lexeme'
                WHEN raw = '1.5' THEN 'decimal_lexeme' WHEN raw = '1e2' THEN 'exponent_lexeme' ELSE 'other_lexeme' END AS kind, count(*) AS n FROM d GROUP BY 1""",
    "h",
    name="lexical_kind",
)
def lexical_kinds(t) -> DataFrame:
    return _raw_tokens(t).groupBy(lexical_kind(F.col("raw")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    """+ d AS (SELECT family, len(regexp_extract(value::VARCHAR, '\\.([0-9]+)$', 1)) AS places FROM h)
    SELECT family, max(places)::INT AS places, round(0.5 * pow(10.0, -max(places)), 9) AS tolerance FROM d GROUP BY family""",
    "h",
)
def precision_probe(t) -> DataFrame:
    places = F.length(F.regexp_extract(F.col("value").cast("string"), r"\.([0-9]+)$", 1))
    return t.history.groupBy("family").agg(F.max(places).alias("places")).withColumn("tolerance", F.round(0.5 * F.pow(F.lit(10.0), -F.col("places")), 9))
