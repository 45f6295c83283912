"""Rate tables, pivots and small joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import r6
from ..operators import grouped
from ..operators.fit import with_constants
from .registry import query


@query("SELECT season, round(avg(y), 6) AS rate, count(*) AS n FROM m GROUP BY season", "m")
def rate_table(t) -> DataFrame:
    return grouped.rate_table(t.main, ["season"]).select("season", r6("rate").alias("rate"), "n")


@query(
    """+ spine(phase, pos) AS (VALUES ('early', 1), ('middle', 2), ('late', 3), ('extra', 4), ('never', 5)), x AS (
      SELECT CASE WHEN inning <= 3 THEN 'early' WHEN inning <= 6 THEN 'middle' WHEN inning <= 9 THEN 'late' ELSE 'extra' END AS phase, y, season FROM m)
    SELECT pos::INT AS pos, spine.phase, round(avg(y), 6) AS rate, count(y) AS n, round(avg(y) FILTER (season >= 2024), 6) AS recent_rate, count(y) FILTER (season >= 2024) AS recent_n
    FROM spine LEFT JOIN x ON x.phase = spine.phase GROUP BY pos, spine.phase""",
    "m",
)
def rate_recent(t) -> DataFrame:
    """All-time and recent rates on a fixed list of categories; absent ones stay with null rates."""
    names = ["early", "middle", "late", "extra", "never"]
    phase = F.when(F.col("inning") <= 3, "early").when(F.col("inning") <= 6, "middle").when(F.col("inning") <= 9, "late").otherwise("extra")
    recent = F.when(F.col("season") >= 2024, F.col("y"))
    made = grouped.rate_table(t.main.withColumn("phase", phase), ["phase"], recent_rate=F.avg(recent), recent_n=F.count(recent))
    spine = t.spark.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in names])).alias("p", "phase"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return spine.join(made, "phase", "left").select((F.col("p") + 1).alias("pos"), "phase", r6("rate").alias("rate"), zero("n"), r6("recent_rate").alias("recent_rate"), zero("recent_n"))


@query("SELECT balls, strikes, round(avg(y), 6) AS rate, count(*) AS n FROM m WHERE rate IS NOT NULL GROUP BY balls, strikes HAVING count(*) >= 30", "m")
def cross_table(t) -> DataFrame:
    made = grouped.rate_table(t.main.na.drop(subset=["rate"]), ["balls", "strikes"], min_support=30)
    return made.select("balls", "strikes", r6("rate").alias("rate"), "n").orderBy(F.desc("rate"), "balls", "strikes")


@query("SELECT balls, strikes, ph, round(avg(y), 6) AS rate, count(*) AS n FROM m GROUP BY balls, strikes, ph HAVING count(*) >= 30", "m")
def cross_table3(t) -> DataFrame:
    return grouped.rate_table(t.main, ["balls", "strikes", "ph"], min_support=30).select("balls", "strikes", "ph", r6("rate").alias("rate"), "n")


@query("SELECT season, round(avg(y) FILTER (ph = 1), 6) AS hand1, round(avg(y) FILTER (ph = 2), 6) AS hand2 FROM m GROUP BY season", "m")
def pivot_rate(t) -> DataFrame:
    made = t.main.groupBy("season").pivot("ph", [1, 2]).avg("y")
    return made.select("season", r6("1").alias("hand1"), r6("2").alias("hand2"))


@query(
    """SELECT uid, season, round(count(*) FILTER (family = 'fastball') / count(*)::DOUBLE, 6) AS fastball, round(count(*) FILTER (family = 'breaking') / count(*)::DOUBLE, 6) AS breaking,
       round(count(*) FILTER (family = 'offspeed') / count(*)::DOUBLE, 6) AS offspeed FROM h WHERE family <> 'other' GROUP BY uid, season""",
    "h",
)
def mix_share(t) -> DataFrame:
    names = ["fastball", "breaking", "offspeed"]
    made = grouped.mix(t.history.where(F.col("family") != "other"), ["uid", "season"], "family", names)
    return made.select("uid", "season", *[r6(n).alias(n) for n in names])


@query(
    "SELECT balls, strikes, round(avg(y) FILTER (season = 2024) - avg(y) FILTER (season = 2023), 6) AS delta, count(*) FILTER (season = 2024) AS n_new, count(*) FILTER (season = 2023) AS n_old FROM m GROUP BY balls, strikes",
    "m",
)
def yoy_delta(t) -> DataFrame:
    rate = lambda s: F.avg(F.when(F.col("season") == s, F.col("y")))
    count = lambda s: F.count_if(F.col("season") == s)
    made = t.main.where(F.col("season").isin(2023, 2024))
    spine = t.main.select("balls", "strikes").distinct()
    made = made.groupBy("balls", "strikes").agg(r6(rate(2024) - rate(2023)).alias("delta"), count(2024).alias("n_new"), count(2023).alias("n_old"))
    return spine.join(made, ["balls", "strikes"], "left").na.fill(0, ["n_new", "n_old"])


@query(
    """SELECT game_type, round(100 * avg(y) FILTER (season >= 2024), 6) AS late_pp, round(100 * avg(y) FILTER (season < 2024), 6) AS early_pp,
       round(100 * (avg(y) FILTER (season >= 2024) - avg(y) FILTER (season < 2024)), 6) AS diff_pp FROM m GROUP BY game_type""",
    "m",
)
def regime_rates(t) -> DataFrame:
    late, early = (100 * F.avg(F.when(c, F.col("y"))) for c in (F.col("season") >= 2024, F.col("season") < 2024))
    return t.main.groupBy("game_type").agg(r6(late).alias("late_pp"), r6(early).alias("early_pp"), r6(late - early).alias("diff_pp"))


@query(
    """+ a AS (SELECT pid, bid % 7 AS kind, round(avg(diff), 6) AS mean FROM m GROUP BY pid, bid % 7)
    SELECT kind, pid, mean, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(mean) DESC, pid) AS rank FROM a) WHERE rank <= 5""",
    "m",
)
def topk_abs(t) -> DataFrame:
    """The five entities of each kind with the largest absolute mean: a top-k report."""
    made = t.main.groupBy("pid", (F.col("bid") % 7).alias("kind")).agg(r6(F.avg("diff")).alias("mean"))
    best = Window.partitionBy("kind").orderBy(F.desc(F.abs("mean")), "pid")
    return made.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= 5).select("kind", "pid", "mean", "rank")


@query(
    """+, h2 AS (SELECT 'events' AS source, count(*) AS n, count(DISTINCT uid) AS entities, round(avg(value), 6) AS mean FROM h)
    SELECT 'main' AS source, count(*) AS n, count(DISTINCT pid) AS entities, round(avg(price), 6) AS mean FROM m UNION ALL SELECT * FROM h2""".replace("+,", "+ "),
    "mh",
)
def multi_source(t) -> DataFrame:
    both = t.main.select(F.lit("main").alias("source"), F.col("pid").alias("e"), F.col("price").alias("v")).unionByName(
        t.history.select(F.lit("events").alias("source"), F.col("uid").alias("e"), F.col("value").alias("v"))
    )
    return both.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("e").alias("entities"), r6(F.avg("v")).alias("mean"))


@query(
    """+ p AS (SELECT id, round(0.3 + (id % 40) / 100.0::DOUBLE, 6) AS p FROM f WHERE id % 3 <> 0)
    SELECT f.id, coalesce(p.p, 0.5)::DOUBLE AS y, (p.p IS NULL)::INT AS placeholder FROM f LEFT JOIN p ON p.id = f.id""",
    "f",
)
def submission_join(t) -> DataFrame:
    """Predictions on the template's rows; a row without one keeps the template's placeholder."""
    predictions = t.frame.where(F.col("id") % 3 != 0).select("id", F.round(0.3 + (F.col("id") % 40) / 100, 6).alias("p"))
    return t.frame.select("id").join(predictions, "id", "left").select("id", F.coalesce("p", F.lit(0.5)).alias("y"), F.col("p").isNull().cast("int").alias("placeholder"))


@query(
    """+ c AS (SELECT (SELECT avg(y) FROM m WHERE season < 2024) AS base)
    SELECT rk, round(y - base, 6) AS lift FROM m, c WHERE season = 2024""",
    "m",
)
def scalar_subtract(t) -> DataFrame:
    rows = with_constants(t.main.where(F.col("season") == 2024), t.main.where(F.col("season") < 2024), base=F.avg("y"))
    return rows.select("rk", r6(F.col("y") - F.col("base")).alias("lift"))
