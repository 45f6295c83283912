"""Scores, calibration, blends and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import choose, clip, deployed, flag, logit, r6, sigmoid
from ..operators import calibration
from ..operators.calibration import subgroup_intercepts
from ..operators.fit import with_constants, with_group_value
from ..operators.ranking import ordinal_positions
from ..operators.sampling import redrawn, resampled, unit_hash
from ..operators.scoring import brier, capped_correction, cells, counted_skill, grid, rolling_choice, screen_gate, simplex, skill
from ..sources.stage import staged
from .registry import query
from .sampling import _CELL_KEY, _resampled_sql, cell_key

Y = "y"
_BSS = "1e5 * (1 - avg(({p} - y) ** 2) / (avg(y) * (1 - avg(y))))"
_Z = "z AS (SELECT rk, season, y, p0, p1, ln(p0 / (1 - p0)) AS z0, ln(p1 / (1 - p1)) AS z1 FROM m)"


def _z(t) -> DataFrame:
    return t.main.select("rk", "season", "y", "p0", "p1", logit(F.col("p0")).alias("z0"), logit(F.col("p1")).alias("z1"))


def _sig(z: str) -> str:
    return f"1 / (1 + exp(-({z})))"


@query(
    f"SELECT season, round(avg((p0 - y) ** 2), 8) AS brier, round({_BSS.format(p='p0')}, 4) AS bss, round(greatest(0, {_BSS.format(p='p0')}), 4) AS clamped FROM m GROUP BY season",
    "m",
)
def bss_score(t) -> DataFrame:
    p, y = F.col("p0"), F.col(Y)
    return t.main.groupBy("season").agg(F.round(brier(p, y), 8).alias("brier"), F.round(skill(p, y), 4).alias("bss"), F.round(skill(p, y, clamp=True), 4).alias("clamped"))


@query(f"+ {_Z}, d AS (SELECT season, y, least(greatest({_sig('z0 - 0.04')}, 0.3), 0.7) AS p FROM z) SELECT season, round(avg(p), 6) AS mean, round({_BSS.format(p='p')}, 4) AS bss FROM d GROUP BY season", "m")
def score_deployed(t) -> DataFrame:
    p = deployed(F.col("z0"), -0.04)
    return _z(t).groupBy("season").agg(r6(F.avg(p)).alias("mean"), F.round(skill(p, F.col(Y)), 4).alias("bss"))


@query(
    f"""+ {_Z}, a AS (SELECT season, y, p0, z0 FROM z WHERE season = 2024), k AS (SELECT avg(y) AS r, avg(p0) AS q FROM a), o AS (SELECT avg(y) AS past FROM m WHERE season < 2024)
    SELECT round({_BSS.format(p='p0')}, 4) AS raw, round({_BSS.format(p=_sig('z0 + ln(past / (1 - past)) - ln(q / (1 - q))'))}, 4) AS trend_shift, round({_BSS.format(p=_sig('z0 + ln(r / (1 - r)) - ln(q / (1 - q))'))}, 4) AS oracle_shift FROM a, k, o""",
    "m",
)
def shift_eval(t) -> DataFrame:
    a = _z(t).where("season = 2024")
    a = with_constants(a, a, r=F.avg("y"), q=F.avg("p0"))
    a = with_constants(a, t.main.where("season < 2024"), past=F.avg("y"))
    z = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    score = lambda to: F.round(skill(sigmoid(F.col("z0") + z(to) - z("q")), F.col(Y)), 4)
    return a.agg(F.round(skill(F.col("p0"), F.col(Y)), 4).alias("raw"), score("past").alias("trend_shift"), score("r").alias("oracle_shift"))


@query(f"+ {_Z}, g AS (SELECT unnest([-0.2, -0.1, 0.0, 0.1, 0.2])::DOUBLE AS off) SELECT off, round({_BSS.format(p=_sig('z0 + off'))}, 4) AS bss FROM z, g GROUP BY off", "m")
def offset_sweep(t) -> DataFrame:
    return grid(_z(t).select("z0", "y"), "off", [-0.2, -0.1, 0.0, 0.1, 0.2]).groupBy("off").agg(F.round(skill(sigmoid(F.col("z0") + F.col("off")), F.col(Y)), 4).alias("bss"))


@query(
    """+ e AS (SELECT list_distinct(quantile_cont(p0, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM m), b AS (SELECT len(list_filter(e, lambda x: x <= p0)) AS bin, p0, y FROM m, e),
    c AS (SELECT bin, count(*) AS n, avg(p0) AS p, avg(y) AS o FROM b GROUP BY bin) SELECT bin::INT AS bin, n, round(p, 6) AS p, round(o, 6) AS o, round(sum(n * abs(p - o)) OVER () / sum(n) OVER (), 6) AS ece FROM c""",
    "m",
)
def calibration_curve(t) -> DataFrame:
    """Quantile-edge bins and the expected calibration error."""
    points = F.array(*[F.lit(k / 10) for k in range(1, 10)])
    rows = with_constants(t.main.select("p0", "y"), t.main, e=F.array_distinct(F.percentile("p0", points)))
    c = rows.groupBy(F.size(F.filter("e", lambda x: x <= F.col("p0"))).alias("bin")).agg(F.count("*").alias("n"), F.avg("p0").alias("p"), F.avg("y").alias("o"))
    every = Window.partitionBy()  # one row a bin
    ece = F.sum(F.col("n") * F.abs(F.col("p") - F.col("o"))).over(every) / F.sum("n").over(every)
    return c.select("bin", "n", r6("p").alias("p"), r6("o").alias("o"), r6(ece).alias("ece"))


@query(
    """+ r AS (SELECT game_type, p0, y, row_number() OVER (PARTITION BY game_type ORDER BY p0, rk, price) - 1 AS k, count(*) OVER (PARTITION BY game_type) AS n FROM m),
    b AS (SELECT game_type, (10 * (k + 1) - 1) // n AS bin, p0, y, k, n FROM r),
    c AS (SELECT game_type, bin, count(*) AS n, avg(p0) AS p, avg(y) AS o FROM b GROUP BY ALL)
    SELECT game_type, round(regr_slope(o, p), 6) AS slope, round(regr_intercept(o, p), 6) AS intercept, round(max(abs(o - p)), 6) AS worst, round(avg(abs(o - p)), 6) AS mean_dev FROM c GROUP BY game_type""",
    "m",
)
def reliability_slope(t) -> DataFrame:
    """Ten bins of equal counts with bounds floor(i n / 10); slope and deviations of their means."""
    order = [F.col("p0"), F.col("rk"), F.col("price")]
    r = ordinal_positions(t.main.select("game_type", "p0", "y", "rk", "price"), ["game_type"], order, "k", "n")
    # the bin i holds places floor(i n / 10) up to floor((i + 1) n / 10)
    bin_ = F.floor((10 * (F.col("k") + 1) - 1) / F.col("n"))
    c = r.groupBy("game_type", bin_.alias("bin")).agg(F.avg("p0").alias("p"), F.avg("y").alias("o"))
    dev = F.abs(F.col("o") - F.col("p"))
    return c.groupBy("game_type").agg(r6(F.regr_slope("o", "p")).alias("slope"), r6(F.regr_intercept("o", "p")).alias("intercept"), r6(F.max(dev)).alias("worst"), r6(F.avg(dev)).alias("mean_dev"))


@query(f"+ {_Z} SELECT rk, round((z0 + z1) / 2, 6) + 0.0 AS mean_z, round({_sig('0.51 * z0 + 0.49 * z1')}, 6) AS blended FROM z", "m")
def blend_logit(t) -> DataFrame:
    return _z(t).select("rk", (r6((F.col("z0") + F.col("z1")) / 2) + 0.0).alias("mean_z"), r6(sigmoid(0.51 * F.col("z0") + 0.49 * F.col("z1"))).alias("blended"))


@query(f"+ {_Z} SELECT season, round({_BSS.format(p=_sig('z0 + 0.35 * (z1 - z0) + 0.1 * (0.5 - z0)'))}, 4) AS bss FROM z GROUP BY season", "m")
def blend_legs(t) -> DataFrame:
    z = F.col("z0") + 0.35 * (F.col("z1") - F.col("z0")) + 0.1 * (0.5 - F.col("z0"))
    return _z(t).groupBy("season").agg(F.round(skill(sigmoid(z), F.col(Y)), 4).alias("bss"))


@query(
    f"""+ {_Z}, g AS (SELECT a::INT AS a, b::INT AS b, (20 - a - b)::INT AS c FROM (SELECT unnest(generate_series(0, 20)) AS a), (SELECT unnest(generate_series(0, 20)) AS b) WHERE a + b <= 20)
    SELECT a, b, c, round({_BSS.format(p=_sig('(a * z0 + b * z1) / 20.0::DOUBLE'))}, 4) AS bss FROM z, g GROUP BY a, b, c""",
    "m",
)
def weight_grid(t) -> DataFrame:
    """All weights of two members and a constant in steps of a twentieth. Rows of equal predictions are counted first."""
    weights = F.array(*[F.struct(*[F.lit(w).alias(n) for n, w in zip("abc", ws, strict=True)]) for ws in simplex(3, 20)])
    rows = cells(_z(t), ["z0", "z1"], Y).select("*", F.inline(weights))
    p = sigmoid((F.col("a") * F.col("z0") + F.col("b") * F.col("z1")) / 20)
    return rows.groupBy("a", "b", "c").agg(F.round(counted_skill(p, F.col(Y), F.col("n")), 4).alias("bss"))


@query(
    "SELECT season, round(sum((p1 - p0) * (y - p0)) / sum((p1 - p0) ** 2), 6) AS weight, round(least(greatest(sum((p1 - p0) * (y - p0)) / sum((p1 - p0) ** 2), 0), 1), 6) + 0.0 AS bounded, round(2 * sum((p1 - p0) * (y - p0)) / sum((p1 - p0) ** 2), 6) AS root FROM m GROUP BY season",
    "m",
)
def blend_analytic(t) -> DataFrame:
    """The weight that minimises the Brier score of p0 + w (p1 - p0), and up to which weight it is below w = 0."""
    d, r = F.col("p1") - F.col("p0"), F.col("y") - F.col("p0")
    w = F.sum(d * r) / F.sum(d * d)
    return t.main.groupBy("season").agg(r6(w).alias("weight"), (r6(clip(w, 0.0, 1.0)) + 0.0).alias("bounded"), r6(2 * w).alias("root"))


#: Points of the grid, tolerance of its signs, step of the derivative; each refinement cuts the bracket into so many.
ALPHAS, SIGN, STEP, CUTS = 1000, 1e-12, 1e-6, 100
_P_ALPHA = f"least(greatest({_sig('z0 + alpha * (z1 - z0) - 0.0404')}, 0.3), 0.7)"
_G = "SELECT {k} AS k, alpha, (SELECT sum(n * (least(greatest(1 / (1 + exp(-(z0 - 0.0404))), 0.3), 0.7) - y) ** 2) / sum(n) FROM c) - sum(n * ({p} - y) ** 2) / sum(n) AS g FROM c, {points} GROUP BY ALL"


def _sql_round(i: int) -> str:
    """One refinement: the bracket of round i - 1 cut into equal parts, and the part in which the sign changes."""
    points = f"(SELECT k, lo + k * (hi - lo) / {CUTS} AS alpha FROM b{i - 1}, (SELECT unnest(generate_series(1, {CUTS})) AS k))"
    return f"""g{i} AS ({_G.format(k="k", p=_P_ALPHA, points=points)}), f{i} AS (SELECT min(k) AS k FROM g{i} WHERE g <= {SIGN}),
    b{i} AS (SELECT lo + (f{i}.k - 1) * (hi - lo) / {CUTS} AS lo, lo + f{i}.k * (hi - lo) / {CUTS} AS hi FROM b{i - 1}, f{i})"""


@query(
    f"""+ {_Z}, c AS (SELECT z0, z1, y, count(*) AS n FROM z WHERE season = 2024 GROUP BY ALL),
    d AS ({_G.format(k="0", p=_P_ALPHA, points=f"(SELECT {STEP} AS alpha)")}), g0 AS ({_G.format(k="k", p=_P_ALPHA, points=f"(SELECT k, k / {ALPHAS}.0::DOUBLE AS alpha FROM (SELECT unnest(generate_series(1, {ALPHAS})) AS k))")}),
    f0 AS (SELECT min(k) AS k FROM g0 WHERE g <= {SIGN}), b0 AS (SELECT (k - 1) / {ALPHAS}.0::DOUBLE AS lo, k / {ALPHAS}.0::DOUBLE AS hi FROM f0), {_sql_round(1)}, {_sql_round(2)}
    SELECT round(d.g / {STEP}, 4) AS derivative, CASE WHEN d.g / {STEP} > 1e-12 THEN 'PASS' ELSE 'FAIL' END AS status, coalesce(f0.k - 1, {ALPHAS})::INT AS positive_points, round(CASE WHEN d.g / {STEP} > 1e-12 THEN coalesce(b2.hi, 1.0) END, 6) AS boundary
    FROM d, f0, b2""",
    "m",
)
def alpha_grid(t) -> DataFrame:
    """Up to which step towards the second member the deployed Brier score stays below that of none: the first change of
    sign on a grid, refined twice inside its bracket. Later changes are ignored."""
    c = cells(_z(t).where("season = 2024"), ["z0", "z1"], Y)
    error = lambda alpha: F.pow(deployed(F.col("z0") + alpha * (F.col("z1") - F.col("z0")), -0.0404) - F.col(Y), F.lit(2))
    gain = F.sum(F.col("n") * (error(F.lit(0.0)) - error(F.col("alpha")))) / F.sum("n")

    def first_change(points) -> DataFrame:
        """The first k whose alpha brings no gain; points: an array of (k, alpha), from constants or from a bracket of one row."""
        g = points.groupBy("k", "alpha").agg(gain.alias("g"))
        return g.agg(F.min(F.when(F.col("g") <= SIGN, F.col("k"))).alias("k"))

    at = F.explode(F.sequence(F.lit(1), F.lit(ALPHAS)))
    found = first_change(c.select("*", at.alias("k")).withColumn("alpha", F.col("k") / F.lit(float(ALPHAS))))
    slope = c.withColumn("alpha", F.lit(STEP)).agg((gain / STEP).alias("slope"))
    bracket = found.select(F.col("k").alias("k0"), ((F.col("k") - 1) / F.lit(float(ALPHAS))).alias("lo"), (F.col("k") / F.lit(float(ALPHAS))).alias("hi"))
    for _ in range(2):
        cut = F.explode(F.sequence(F.lit(1), F.lit(CUTS)))
        points = c.crossJoin(F.broadcast(bracket)).select("*", cut.alias("k")).withColumn("alpha", F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / CUTS)
        inside = first_change(points).withColumnRenamed("k", "k1")
        width = (F.col("hi") - F.col("lo")) / CUTS
        bracket = bracket.crossJoin(F.broadcast(inside)).select("k0", (F.col("lo") + (F.col("k1") - 1) * width).alias("lo"), (F.col("lo") + F.col("k1") * width).alias("hi"))
    rising = F.col("slope") > 1e-12
    return bracket.crossJoin(F.broadcast(slope)).select(
        F.round("slope", 4).alias("derivative"),
        F.when(rising, "PASS").otherwise("FAIL").alias("status"),
        F.coalesce(F.col("k0") - 1, F.lit(ALPHAS)).cast("int").alias("positive_points"),
        r6(F.when(rising, F.coalesce("hi", F.lit(1.0)))).alias("boundary"),
    )


@query(f"+ {_Z} SELECT season, round(corr(z0, z1), 6) AS members, round(corr(p1 - p0, y - p0), 6) AS residual FROM z GROUP BY season", "m")
def blend_diversity(t) -> DataFrame:
    return _z(t).groupBy("season").agg(r6(F.corr("z0", "z1")).alias("members"), r6(F.corr(F.col("p1") - F.col("p0"), F.col("y") - F.col("p0"))).alias("residual"))


@query("SELECT season, round(avg((p0 <= 0.3)::INT), 6) AS low, round(avg((p0 >= 0.55)::INT), 6) AS high, round(max(abs(p0 - 0.5)), 6) AS reach FROM m GROUP BY season", "m")
def clip_fracs(t) -> DataFrame:
    return t.main.groupBy("season").agg(r6(F.avg(flag(F.col("p0") <= 0.3))).alias("low"), r6(F.avg(flag(F.col("p0") >= 0.55))).alias("high"), r6(F.max(F.abs(F.col("p0") - 0.5))).alias("reach"))


_SLOPES = "SELECT slope, sum(n * ({p} - y) ** 2) / sum(n) AS b FROM c, {points} GROUP BY slope"
_P_SLOPE = _sig("slope * z0")


@query(
    f"""+ {_Z}, c AS (SELECT z0, y, count(*) AS n FROM z WHERE season < 2024 GROUP BY ALL), g AS ({_SLOPES.format(p=_P_SLOPE, points="(SELECT 0.6::DOUBLE + k * 0.8::DOUBLE / 200 AS slope FROM (SELECT unnest(generate_series(0, 200)) AS k))")}),
    a AS (SELECT slope AS a FROM g ORDER BY round(b, 12), slope LIMIT 1), r AS (SELECT greatest(0.6, a - 0.02) AS lo, least(1.4, a + 0.02) AS hi FROM a),
    f AS ({_SLOPES.format(p=_P_SLOPE, points="(SELECT lo + unnest(generate_series(0, round((hi - lo) / 0.001)::INT)) * (hi - lo) / round((hi - lo) / 0.001) AS slope FROM r)")})
    SELECT round(slope, 6) AS slope, round(f.b, 8) AS brier, round((SELECT max(b) - min(b) FROM g), 8) AS range FROM f ORDER BY round(f.b, 12), slope LIMIT 1""",
    "m",
)
def slope_grid(t) -> DataFrame:
    """The slope of least Brier score: 201 slopes from 0.6 to 1.4, then steps of 0.001 within 0.02 of the best."""
    c = cells(_z(t).where("season < 2024"), ["z0"], Y)
    error = F.sum(F.col("n") * F.pow(sigmoid(F.col("slope") * F.col("z0")) - F.col(Y), F.lit(2))) / F.sum("n")
    best = F.min(F.struct(F.round("b", 12).alias("r"), "slope", "b"))
    coarse = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(200))).alias("k")).withColumn("slope", F.lit(0.6) + F.col("k") * 0.8 / 200).groupBy("slope").agg(error.alias("b"))
    coarse = coarse.agg(best["slope"].alias("a"), (F.max("b") - F.min("b")).alias("range"))
    lo, hi = F.greatest(F.lit(0.6), F.col("a") - 0.02), F.least(F.lit(1.4), F.col("a") + 0.02)
    steps = F.round((hi - lo) / 0.001).cast("int")
    fine = c.crossJoin(F.broadcast(coarse)).select("*", F.explode(F.sequence(F.lit(0), steps)).alias("k")).withColumn("slope", lo + F.col("k") * (hi - lo) / steps)
    fine = fine.groupBy("slope", "range").agg(error.alias("b")).groupBy("range").agg(best.alias("s"))
    return fine.select(r6("s.slope").alias("slope"), F.round("s.b", 8).alias("brier"), F.round("range", 8).alias("range"))


CAPS, YEARS = (0.05, 0.15, 0.5), (2022, 2023, 2024)
_CORRECTED = "least(greatest(1 / (1 + exp(-(z0 + least(greatest(z1 + 0.0404 - z0, -cap), cap) - 0.0404))), 0.3), 0.7)"


@query(
    f"""+ {_Z}, e AS (SELECT cap, season, avg(({_CORRECTED} - y) ** 2) AS b FROM z, (SELECT unnest([{", ".join(f"{c}::DOUBLE" for c in CAPS)}]) AS cap) WHERE season IN {YEARS} GROUP BY cap, season)
    SELECT cap, round(avg(b), 8) AS mean_brier, count(*) AS years, (row_number() OVER (ORDER BY round(avg(b), 12), cap) = 1)::INT AS chosen FROM e GROUP BY cap""",
    "m",
)
def residual_rolling(t) -> DataFrame:
    """A residual member's correction of the base logit under several caps; the least mean Brier score over forward years decides, the smallest cap on a tie."""
    rows = grid(_z(t).where(F.col("season").isin(*YEARS)), "cap", list(CAPS))
    p = deployed(capped_correction(F.col("z0"), F.col("z1"), -0.0404, F.col("cap")), -0.0404)
    years = rows.groupBy("cap", "season").agg(brier(p, F.col(Y)).alias("b"))
    return rolling_choice(years, "cap").select("cap", F.round("mean_brier", 8).alias("mean_brier"), "years", "chosen")


#: Regularisation and shrinkage of the intercepts, bound of each and of their sum, offset of deployed logits, and the first season of type F that a fit may see.
LAM, SHRINK, TERM_CAP, OFFSET, F_SEASON = 0.001, 5000, 0.05, -0.0404, 2023


def _intercepts_sql(name: str, cells_of: str, rounds: int = 12) -> str:
    """CTEs up to <name>: grp and beta, by Newton steps under the constraint, one after another."""
    steps = [f"{name}_c AS MATERIALIZED ({cells_of}), {name}_pen AS (SELECT 2 * {LAM}::DOUBLE * sum(n) AS pen FROM {name}_c), {name}_0 AS MATERIALIZED (SELECT grp, sum(n)::DOUBLE AS size, 0::DOUBLE AS raw FROM {name}_c GROUP BY grp)"]
    for k in range(rounds):
        p = _sig("c.z + t.raw")
        steps.append(
            f"""{name}_s{k} AS MATERIALIZED (SELECT t.grp, size, raw, sum(c.n * (c.y - {p})) - pen * raw AS g, sum(c.n * ({p}) * (1 - {p})) + pen AS h FROM {name}_c c JOIN {name}_{k} t ON t.grp = c.grp, {name}_pen GROUP BY t.grp, size, raw, pen),
            {name}_{k + 1} AS MATERIALIZED (SELECT grp, size, raw + (g - (SELECT (sum(size * g / h) + sum(size * raw)) / sum(size * size / h) FROM {name}_s{k}) * size) / h AS raw FROM {name}_s{k})"""
        )
    return ", ".join(steps) + f", {name} AS (SELECT grp, least(greatest(raw * size / (size + {SHRINK}), -{TERM_CAP}), {TERM_CAP}) AS beta FROM {name}_{rounds})"


@query(
    f"""+ {_intercepts_sql("a", f"SELECT game_type AS grp, ln(p0 / (1 - p0)) AS z, y, count(*) AS n FROM m WHERE season < 2024 AND (game_type <> 'F' OR season >= {F_SEASON}) GROUP BY ALL")},
    {_intercepts_sql("b", "SELECT balls * 3 + strikes AS grp, ln(p0 / (1 - p0)) AS z, y, count(*) AS n FROM m WHERE season < 2024 GROUP BY ALL")},
    d AS (SELECT rk, ln(p0 / (1 - p0)) + {OFFSET} + least(greatest(coalesce(a.beta, 0) + coalesce(b.beta, 0), -{TERM_CAP}), {TERM_CAP}) AS z FROM m LEFT JOIN a ON a.grp = game_type LEFT JOIN b ON b.grp = balls * 3 + strikes WHERE season = 2024)
    SELECT rk, round(least(greatest({_sig("z")}, 0.3), 0.7), 6) AS p FROM d""",
    "m",
)
def subgroup_apply(t) -> DataFrame:
    """Intercepts of two groupings, fitted on earlier seasons with zero count-weighted sum, shrunk and capped, added to the deployed logit and capped again; unseen groups add nothing."""
    rows = t.main.select("rk", "season", "game_type", (F.col("balls") * 3 + F.col("strikes")).alias("state"), "y", logit(F.col("p0")).alias("z"))
    past = rows.where("season < 2024")
    by_type = subgroup_intercepts(past.where((F.col("game_type") != "F") | (F.col("season") >= F_SEASON)), "game_type", "z", "y", LAM, SHRINK, TERM_CAP)
    by_state = subgroup_intercepts(past, "state", "z", "y", LAM, SHRINK, TERM_CAP)
    made = rows.where("season = 2024").join(by_type.select("game_type", F.col("beta").alias("a")), "game_type", "left").join(by_state.select("state", F.col("beta").alias("b")), "state", "left")
    moved = clip(F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), -TERM_CAP, TERM_CAP)
    return made.select("rk", r6(deployed(F.col("z") + moved, OFFSET)).alias("p"))


_FOLD = "floor(('0x' || substr(sha256(concat_ws('|', 'calibrate', rk)), 1, 7))::BIGINT * 3 / 268435456)::INT"
_EPS = "least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"


def _newton_sql(name: str, features: list[str], l2: float, rounds: int = 12) -> str:
    """CTEs up to <name>: f and the coefficients of the fit on tr(f, p, y, n), by Newton steps one after another."""
    d = len(features) + 1
    b, x = [f"b{i}" for i in range(d)], ["1", *[f"x{i}" for i in range(1, d)]]
    steps = [f"{name}_c AS MATERIALIZED (SELECT f, {', '.join(f'{e} AS x{i}' for i, e in enumerate(features, 1))}, y, n FROM tr), {name}_0 AS (SELECT DISTINCT f, {', '.join(f'0::DOUBLE AS {k}' for k in b)} FROM tr)"]
    z = "b0" + "".join(f" + b{i} * x{i}" for i in range(1, d))
    h = lambda i, j: f"(h{min(i, j)}{max(i, j)}{f' + {l2}::DOUBLE' if i == j and i else ''})"
    g = lambda i: f"(g{i}{f' - {l2}::DOUBLE * b{i}' if i else ''})"

    def det(m: list[list[str]]) -> str:
        if len(m) == 2:
            return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
        return "(" + " + ".join(f"{m[0][j]} * {m[1][(j + 1) % 3]} * {m[2][(j + 2) % 3]} - {m[0][j]} * {m[1][(j + 2) % 3]} * {m[2][(j + 1) % 3]}" for j in range(3)) + ")"

    whole = [[h(i, j) for j in range(d)] for i in range(d)]
    for k in range(rounds):
        sums = [f"sum(n * (y - {_sig(z)}) * {x[i]}) AS g{i}" for i in range(d)] + [f"sum(n * ({_sig(z)}) * (1 - {_sig(z)}) * {x[i]} * {x[j]}) AS h{i}{j}" for i in range(d) for j in range(i, d)]
        new = [f"b{q} + {det([[g(i) if j == q else whole[i][j] for j in range(d)] for i in range(d)])} / {det(whole)} AS b{q}" for q in range(d)]
        steps.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT f, {', '.join(new)} FROM (SELECT c.f, {', '.join(b)}, {', '.join(sums)} FROM {name}_c c JOIN {name}_{k} t ON t.f = c.f GROUP BY c.f, {', '.join(b)}))")
    return ", ".join(steps) + f", {name} AS (SELECT f, {', '.join(f'{k} AS {name}_{k}' for k in b)} FROM {name}_{rounds})"


_ISO_SQL = """ic AS MATERIALIZED (SELECT f, round(p * 1e6)::BIGINT AS x, sum(n)::DOUBLE AS n, sum(n * y)::DOUBLE AS s FROM tr GROUP BY ALL),
    ip AS MATERIALIZED (SELECT f, x, n, s, sum(n) OVER (PARTITION BY f ORDER BY x) AS cn, sum(s) OVER (PARTITION BY f ORDER BY x) AS cs FROM ic),
    im AS (SELECT i.f, i.x, j.x AS jx, min((k.cs - j.cs + j.s) / (k.cn - j.cn + j.n)) AS least FROM ip i JOIN ip j ON j.f = i.f AND j.x <= i.x JOIN ip k ON k.f = i.f AND k.x >= i.x GROUP BY i.f, i.x, j.x),
    iso AS MATERIALIZED (SELECT f, x, max(least) AS v FROM im GROUP BY f, x), ia AS (SELECT DISTINCT f, round(p * 1e6)::BIGINT AS x FROM va),
    ib AS (SELECT ia.f, ia.x, max(a.x) FILTER (a.x <= ia.x) AS lo, min(a.x) FILTER (a.x >= ia.x) AS hi FROM ia JOIN iso a ON a.f = ia.f GROUP BY ia.f, ia.x),
    iv AS (SELECT ib.f, ib.x, CASE WHEN lo IS NULL THEN b.v WHEN hi IS NULL OR lo = hi THEN a.v ELSE a.v + (b.v - a.v) * (ib.x - lo) / (hi - lo)::DOUBLE END AS v FROM ib LEFT JOIN iso a ON a.f = ib.f AND a.x = lo LEFT JOIN iso b ON b.f = ib.f AND b.x = hi)"""
_PLATT, _BETA = [f"ln({_EPS} / (1 - {_EPS}))"], [f"ln({_EPS})", f"-ln(1 - {_EPS})"]
_CALIBRATED_SQL = f"{_newton_sql('platt', _PLATT, 1e-6)}, {_newton_sql('beta', _BETA, 1.0)}, {_ISO_SQL}"
_CALIBRATED = f"{_sig(f'platt_b0 + platt_b1 * {_PLATT[0]}')} AS platt, {_sig(f'beta_b0 + beta_b1 * {_BETA[0]} + beta_b2 * {_BETA[1]}')} AS beta, least(greatest(iv.v, 0.001), 0.999) AS isotonic"
_FITTED = "FROM va JOIN platt ON platt.f = va.f JOIN beta ON beta.f = va.f JOIN iv ON iv.f = va.f AND iv.x = round(p * 1e6)::BIGINT"


def _calibrations(train: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """rows with a Platt, a beta and an isotonic calibration of p, each fitted on train."""
    made = calibration.logistic(train, rows, "p", "y", out="platt", by=by, l2=1e-6)
    made = calibration.logistic(train, made, "p", "y", calibration.beta_features, out="beta", by=by, l2=1.0)
    return calibration.isotonic(train, made, "p", "y", out="isotonic", by=by)


@query(
    f"""+ r AS MATERIALIZED (SELECT rk, {_FOLD} AS f, round((p0 + p1) / 2, 6) AS p, y FROM m WHERE season = 2023), tr AS MATERIALIZED (SELECT k.f, p, y, count(*) AS n FROM r JOIN (SELECT unnest([0, 1, 2]) AS f) k ON k.f <> r.f GROUP BY ALL), va AS (SELECT * FROM r),
    {_CALIBRATED_SQL} SELECT rk, va.f AS fold, p, round(platt, 6) AS platt, round(beta, 6) AS beta, round(isotonic, 6) AS isotonic FROM (SELECT va.*, {_CALIBRATED} {_FITTED}) va""",
    "m",
)
def cross_fit_calibration(t) -> DataFrame:
    """Three calibrations of the members' mean, every row by fits on the two folds that it isn't in."""
    fold = F.floor(unit_hash(F.lit("calibrate"), F.col("rk")) * 3).cast("int")
    rows = t.main.where("season = 2023").select("rk", fold.alias("fold"), r6((F.col("p0") + F.col("p1")) / 2).alias("p"), "y")
    made = calibration.cross_fit_together(rows, "fold", 3, _calibrations)
    return made.select("rk", "fold", "p", *[r6(c).alias(c) for c in ("platt", "beta", "isotonic")])


@query(
    f"""+ tr AS MATERIALIZED (SELECT v AS f, round((p0 + p1) / 2, 6) AS p, y, count(*) AS n FROM m JOIN (SELECT unnest([2021, 2022, 2023, 2024]) AS v) ON season < v GROUP BY ALL),
    va AS MATERIALIZED (SELECT season AS f, round((p0 + p1) / 2, 6) AS p, y FROM m WHERE season BETWEEN 2021 AND 2024), {_CALIBRATED_SQL},
    c AS (SELECT va.f, p, y, {_CALIBRATED} {_FITTED})
    SELECT f AS season, count(*) AS n, round(avg((p - y) ** 2), 8) AS raw, round(avg((platt - y) ** 2), 8) AS platt, round(avg((beta - y) ** 2), 8) AS beta, round(avg((isotonic - y) ** 2), 8) AS isotonic FROM c GROUP BY f""",
    "m",
)
def forward_calibration(t) -> DataFrame:
    """Brier scores of each season, raw and by calibrations fitted on all seasons before it."""
    rows = t.main.select("season", r6((F.col("p0") + F.col("p1")) / 2).alias("p"), "y")
    later = F.explode(F.sequence(F.greatest(F.col("season") + 1, F.lit(2021)), F.lit(2024))).alias("season")
    train = rows.where("season < 2024").select("p", "y", later)
    made = _calibrations(train, rows.where("season BETWEEN 2021 AND 2024"), ["season"])
    score = lambda c: F.round(brier(F.col(c), F.col("y")), 8)
    return made.groupBy("season").agg(F.count("*").alias("n"), score("p").alias("raw"), *[score(c).alias(c) for c in ("platt", "beta", "isotonic")])


_METRICS_SQL = f"""+ {_Z}, o AS (SELECT season, {_BSS.format(p='p0')} AS base, {_BSS.format(p='p1')} AS c1, {_BSS.format(p=_sig('(z0 + z1) / 2'))} AS c2, {_BSS.format(p='0.9 * p0 + 0.1 * p1')} AS c3,
    avg(p1) - avg(p0) AS s1, avg({_sig('(z0 + z1) / 2')}) - avg(p0) AS s2, avg(0.9 * p0 + 0.1 * p1) - avg(p0) AS s3 FROM z WHERE season IN (2022, 2023, 2024) GROUP BY season),
    u AS (SELECT season, unnest(['c1', 'c2', 'c3']) AS candidate, unnest([c1 - base, c2 - base, c3 - base]) AS delta, unnest([s1, s2, s3]) AS shift, base, unnest([c1, c2, c3]) AS score FROM o)"""


def _metrics(t) -> DataFrame:
    """Gain over the base member and mean shift of three candidates on three origins."""
    y = F.col(Y)
    made = {"c1": F.col("p1"), "c2": sigmoid((F.col("z0") + F.col("z1")) / 2), "c3": 0.9 * F.col("p0") + 0.1 * F.col("p1")}
    o = _z(t).where(F.col("season").isin(2022, 2023, 2024)).groupBy("season").agg(
        *[F.struct(F.lit(k).alias("candidate"), (skill(p, y) - skill(F.col("p0"), y)).alias("delta"), (F.avg(p) - F.avg("p0")).alias("shift"), skill(F.col("p0"), y).alias("base"), skill(p, y).alias("score")).alias(k) for k, p in made.items()]
    )
    return o.select("season", F.inline(F.array(*made)))


@query(
    f"""{_METRICS_SQL} SELECT candidate, round(min(delta), 4) AS worst, count(*) FILTER (delta > 1) AS improved, bool_and(delta > 1 AND score > base AND abs(shift) <= 0.005 AND isfinite(score))::INT AS screened, bool_and(delta > 1 AND abs(shift) <= 0.05)::INT AS screened_wide, bool_and(delta > 3)::INT AS terminal,
    CASE WHEN bool_and(delta > 3) THEN 'PASS' WHEN bool_or(delta > 0) THEN 'FAIL' ELSE 'KILL' END AS verdict FROM u GROUP BY candidate""",
    "m",
)
def gate_table(t) -> DataFrame:
    gain = F.col("delta")
    # a score is 1e5 (1 - Brier / reference), so a higher score of the same rows is a lower Brier
    screened = lambda shift: screen_gate(gain, -F.col("score"), -F.col("base"), F.col("shift"), shift=shift)
    return _metrics(t).groupBy("candidate").agg(
        F.round(F.min(gain), 4).alias("worst"),
        F.count_if(gain > 1).alias("improved"),
        flag(F.bool_and(screened(0.005))).alias("screened"),
        flag(F.bool_and(screened(0.05))).alias("screened_wide"),
        flag(F.bool_and(gain > 3)).alias("terminal"),
        choose([(F.bool_and(gain > 3), "PASS"), (F.bool_or(gain > 0), "FAIL")], "KILL").alias("verdict"),
    )


@query(
    f"{_METRICS_SQL}, a AS (SELECT candidate, round(avg(delta), 6) AS mean FROM u GROUP BY candidate) SELECT candidate, round(mean, 4) AS mean, substr(sha256('candidate=' || candidate), 1, 16) AS id FROM a ORDER BY a.mean DESC, candidate LIMIT 1",
    "m",
)
def select_winner(t) -> DataFrame:
    """The largest mean gain; the smaller name on a tie."""
    a = _metrics(t).groupBy("candidate").agg(r6(F.avg("delta")).alias("mean"))
    best = a.orderBy(F.desc("mean"), "candidate").limit(1)
    return best.select("candidate", F.round("mean", 4).alias("mean"), F.substring(F.sha2(F.concat(F.lit("candidate="), "candidate"), 256), 1, 16).alias("id"))


@query("+ p AS (SELECT season, avg(y) AS r FROM m GROUP BY season) SELECT rk, round(m.y - p.r, 6) AS residual FROM m JOIN p ON p.season = m.season WHERE m.season = 2023", "m")
def season_residual(t) -> DataFrame:
    rows = with_group_value(t.main.where("season = 2023"), t.main, ["season"], few=True, r=F.avg("y"))
    return rows.select("rk", r6(F.col("y") - F.col("r")).alias("residual"))


_MEMBERS_SQL = "mm AS MATERIALIZED (SELECT ln(p0 / (1 - p0)) AS z0, ln(p1 / (1 - p1)) AS z1, ln((0.3::DOUBLE + 0.03::DOUBLE * balls) / (0.7::DOUBLE - 0.03::DOUBLE * balls)) AS z2, y, count(*)::DOUBLE AS n FROM m WHERE season = 2024 GROUP BY ALL)"
_GRID_BSS = "1e5 * (1 - sum(n * (p - y) ** 2) / sum(n) / ((sum(n * y) / sum(n)) * (1 - sum(n * y) / sum(n))))"


def _members(t) -> DataFrame:
    """Cells of three members' logits on the selection season."""
    p2 = 0.3 + 0.03 * F.col("balls")
    rows = t.main.where("season = 2024").select("y", logit(F.col("p0")).alias("z0"), logit(F.col("p1")).alias("z1"), F.log(p2 / (0.7 - 0.03 * F.col("balls"))).alias("z2"))
    return cells(rows, ["z0", "z1", "z2"], Y)


def _on_grid(rows: DataFrame, points: DataFrame | list[tuple[int, int, int]], unit: int) -> DataFrame:
    """a, b, c (weights in units of 1 / unit) and bss of each point."""
    if isinstance(points, list):
        each = rows.select("*", F.inline(F.array(*[F.struct(*[F.lit(w).alias(k) for k, w in zip("abc", ws, strict=True)]) for ws in points])))
    else:
        each = rows.crossJoin(F.broadcast(points))
    p = sigmoid((F.col("a") * F.col("z0") + F.col("b") * F.col("z1") + F.col("c") * F.col("z2")) / unit)
    return each.groupBy("a", "b", "c").agg(F.round(counted_skill(p, F.col(Y), F.col("n")), 4).alias("bss"))


@query(
    f"""+ {_MEMBERS_SQL}, g AS (SELECT a, 40 - a - c AS b, c FROM (SELECT unnest(generate_series(6, 14)) AS a), (SELECT unnest(generate_series(14, 22)) AS c) WHERE 40 - a - c >= 6), s AS (SELECT a, b, c, y, n, {_sig("(a * z0 + b * z1 + c * z2) / 40.0::DOUBLE")} AS p FROM mm, g)
    SELECT a::INT AS a, b::INT AS b, c::INT AS c, round({_GRID_BSS}, 4) AS bss FROM s GROUP BY a, b, c""",
    "m",
)
def tick_grid(t) -> DataFrame:
    """The 78 weights of three members in fortieths: 6 to 14 of the first, 14 to 22 of the third, at least 6 for the second."""
    points = [(a, 40 - a - c, c) for a in range(6, 15) for c in range(14, 23) if 40 - a - c >= 6]
    return _on_grid(_members(t), points, 40)


#: Bounds of refined weights in hundredths: of the first, the second and the third member.
BOUNDS = ((15, 45), (30, 60), (15, 35))


@query(
    f"""+ {_MEMBERS_SQL}, g AS (SELECT a, b, 100 - a - b AS c FROM (SELECT unnest(generate_series(20, 40, 5)) AS a), (SELECT unnest(generate_series(35, 55, 5)) AS b) WHERE 100 - a - b BETWEEN 15 AND 35),
    s AS (SELECT a, b, c, y, n, {_sig("(a * z0 + b * z1 + c * z2) / 100.0::DOUBLE")} AS p FROM mm, g), coarse AS (SELECT a, b, c, round({_GRID_BSS}, 4) AS bss FROM s GROUP BY a, b, c), top AS (SELECT a, b FROM coarse ORDER BY bss DESC, a, b LIMIT 3),
    f AS (SELECT DISTINCT a + i AS a, b + j AS b, 100 - a - b - i - j AS c FROM top, (SELECT unnest([-2, 0, 2]) AS i), (SELECT unnest([-2, 0, 2]) AS j) WHERE a + i BETWEEN 15 AND 45 AND b + j BETWEEN 30 AND 60 AND 100 - a - b - i - j BETWEEN 15 AND 35),
    r AS (SELECT a, b, c, y, n, {_sig("(a * z0 + b * z1 + c * z2) / 100.0::DOUBLE")} AS p FROM mm, f)
    SELECT a::INT AS a, b::INT AS b, c::INT AS c, round({_GRID_BSS}, 4) AS bss FROM r GROUP BY a, b, c""",
    "m",
)
def refined_grid(t) -> DataFrame:
    """Weights in steps of .05, then the neighbours of the three best in steps of .02, each once, within their bounds."""
    rows = staged(_members(t), "members")
    coarse = [(a, b, 100 - a - b) for a in range(20, 41, 5) for b in range(35, 56, 5) if 15 <= 100 - a - b <= 35]
    best = _on_grid(rows, coarse, 100).orderBy(F.desc("bss"), "a", "b").limit(3)
    step = lambda c: F.explode(F.array(*[F.col(c) + k for k in (-2, 0, 2)])).alias(c)
    # 27 points at most
    near = best.select(step("a"), "b").select("a", step("b")).distinct().withColumn("c", 100 - F.col("a") - F.col("b"))
    for name, (low, high) in zip("abc", BOUNDS, strict=True):
        near = near.where(F.col(name).between(low, high))
    return _on_grid(rows, near, 100)


_SCREEN_P = {"c1": "p1", "c2": _sig("(ln(p0 / (1 - p0)) + ln(p1 / (1 - p1))) / 2"), "c3": "0.9::DOUBLE * p0 + 0.1::DOUBLE * p1"}


def _screen_sql(replicates: int = 10_000) -> str:
    sums = ", ".join(["sum(w * y) AS sy", "sum(w * (p0 - y) ** 2) AS s0", *[f"sum(w * ({p} - y) ** 2) AS {c}" for c, p in _SCREEN_P.items()]])
    head = _resampled_sql("SELECT season, y, p0, p1, count(*) AS n FROM m WHERE season IN (2022, 2023) GROUP BY ALL", "season, y, p0, p1", f"season, {_CELL_KEY}", "season, b", sums, replicates + 200)
    ok = "ok AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY b) AS k FROM d WHERE sy > 0 AND sy < size)"
    each = " UNION ALL ".join(
        f"""SELECT '{c}' AS candidate, o.season, o.delta, o.brier, o.base, o.shift, l.lb5 FROM (SELECT season, 1e5 * (avg((p0 - y) ** 2) - avg(({p} - y) ** 2)) / (avg(y) * (1 - avg(y))) AS delta, avg(({p} - y) ** 2) AS brier, avg((p0 - y) ** 2) AS base, avg({p}) - avg(p0) AS shift FROM m WHERE season IN (2022, 2023) GROUP BY season) o
        JOIN (SELECT season, quantile_cont(1e5 * (s0 - {c}) / size / ((sy / size) * (1 - sy / size)), 0.05) AS lb5 FROM ok WHERE k <= {replicates} GROUP BY season) l ON l.season = o.season"""
        for c, p in _SCREEN_P.items()
    )
    return f"""+ {head}, {ok}, e AS ({each}) SELECT candidate, season, round(delta, 4) AS delta, round(lb5, 4) AS lb5, round(shift, 6) AS shift, (brier < base)::INT AS brier_lower, (delta > 1 AND brier < base AND lb5 > 0 AND abs(shift) <= 0.005 AND isfinite(brier))::INT AS origin_passes,
    bool_and(delta > 1 AND brier < base AND lb5 > 0 AND abs(shift) <= 0.005 AND isfinite(brier)) OVER (PARTITION BY candidate)::INT AS passes FROM e"""


@query(_screen_sql(), "m")
def screened_candidates(t, replicates: int = 10_000) -> DataFrame:
    """The screen gate of three candidates on two origins, with the lower bound of paired resamples; a candidate passes if it does on both."""
    p = {"c1": F.col("p1"), "c2": sigmoid((logit(F.col("p0")) + logit(F.col("p1"))) / 2), "c3": 0.9 * F.col("p0") + 0.1 * F.col("p1")}
    y = F.col(Y)
    sq = lambda c: (c - y) * (c - y)
    counted = staged(cells(t.main.where("season IN (2022, 2023)").select("season", "p0", "p1", Y), ["season", "p0", "p1"], Y), "cells")
    sums = {"sy": y, "s0": sq(F.col("p0")), **{c: sq(v) for c, v in p.items()}}
    parts = []
    for season in (2022, 2023):
        own = counted.where(F.col("season") == season)
        draw = lambda a, b: resampled(own, ["season"], cell_key(["season"]), "n", sums, a, b)  # noqa: B023, E731
        parts.append(redrawn(draw, (F.col("sy") > 0) & (F.col("sy") < F.col("size")), replicates))
    r = F.col("sy") / F.col("size")
    gain = lambda c: F.percentile(1e5 * (F.col("s0") - F.col(c)) / F.col("size") / (r * (1 - r)), F.lit(0.05)).alias(f"lb_{c}")
    bounds = parts[0].unionByName(parts[1]).groupBy("season").agg(*[gain(c) for c in p])
    mean = lambda v: F.sum(F.col("n") * v) / F.sum("n")
    rate = mean(y)
    base = mean(sq(F.col("p0")))
    whole = counted.groupBy("season").agg(
        *[F.struct(F.lit(c).alias("candidate"), (1e5 * (base - mean(sq(v))) / (rate * (1 - rate))).alias("delta"), mean(sq(v)).alias("brier"), base.alias("base"), (mean(v) - mean(F.col("p0"))).alias("shift")).alias(c) for c, v in p.items()]
    )
    e = whole.join(bounds, "season").select("season", F.inline(F.array(*[F.struct(f"{c}.*", F.col(f"lb_{c}").alias("lb5")) for c in p])))
    ok = screen_gate(F.col("delta"), F.col("brier"), F.col("base"), F.col("shift"), F.col("lb5"))
    return e.select(
        "candidate", "season", F.round("delta", 4).alias("delta"), F.round("lb5", 4).alias("lb5"), r6("shift").alias("shift"), flag(F.col("brier") < F.col("base")).alias("brier_lower"), flag(ok).alias("origin_passes"),
        F.min(flag(ok)).over(Window.partitionBy("candidate")).alias("passes"),
    )
