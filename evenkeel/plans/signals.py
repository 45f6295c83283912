"""What a feature's cells could be worth: resolution, interactions, transfer from train to validation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import choose, r6
from ..operators.fit import with_constants, with_group_value
from ..operators.ranking import exact_quantiles
from ..operators.scoring import resolution, skill
from .registry import query


@query(
    "+ c AS (SELECT balls * 3 + strikes AS cell, avg(y) AS o, count(*) AS n FROM m GROUP BY 1), g AS (SELECT avg(y) AS r, count(*) AS t FROM m) SELECT round(1e5 * sum(n / t::DOUBLE * (o - r) ** 2) / (max(r) * (1 - max(r))), 4) AS resolution FROM c, g",
    "m",
)
def resolution_upper(t) -> DataFrame:
    rows = t.main.select("y", (F.col("balls") * 3 + F.col("strikes")).alias("cell"))
    return resolution(rows, "cell").select(F.round("resolution", 4).alias("resolution"))


_SCANNED = {"count": "balls * 3 + strikes", "outs": "outs", "hand": "ph * 2 + bh", "month4": "month % 4", "base": "r1 * 4 + r2 * 2 + r3"}
_PAIRS = list(combinations(_SCANNED, 2))


def _scan_sql() -> str:
    single = " UNION ALL ".join(f"SELECT '{k}' AS k, ({e})::VARCHAR AS cell, y FROM m" for k, e in _SCANNED.items())
    double = " UNION ALL ".join(f"SELECT '{a}*{b}' AS k, ({_SCANNED[a]}) || '|' || ({_SCANNED[b]}) AS cell, y FROM m" for a, b in _PAIRS)
    names = ", ".join(f"('{a}', '{b}')" for a, b in _PAIRS)
    return f"""+ u AS ({single} UNION ALL {double}), c AS (SELECT k, cell, avg(y) AS o, count(*) AS n FROM u GROUP BY k, cell HAVING count(*) >= 20), g AS (SELECT avg(y) AS r, count(*)::DOUBLE AS t FROM m),
    v AS (SELECT k, 1e5 * sum(n / t * (o - r) ** 2) / (max(r) * (1 - max(r))) AS v FROM c, g GROUP BY k), p(a, b) AS (VALUES {names})
    SELECT a, b, round(x.v - y.v - z.v, 4) AS gain FROM p JOIN v x ON x.k = a || '*' || b JOIN v y ON y.k = a JOIN v z ON z.k = b"""


@query(_scan_sql(), "m")
def interaction_scan(t) -> DataFrame:
    """All pairs of features in one aggregate: the gain of a pair's cells over its members' own."""
    one = {k: F.expr(e).cast("string") for k, e in _SCANNED.items()}
    cells = [F.struct(F.lit(k).alias("k"), c.alias("cell")) for k, c in one.items()]
    cells += [F.struct(F.lit(f"{a}*{b}").alias("k"), F.concat_ws("|", one[a], one[b]).alias("cell")) for a, b in _PAIRS]
    counted = t.main.select("y", F.inline(F.array(*cells))).groupBy("k", "cell").agg(F.avg("y").alias("o"), F.count("*").alias("n")).where(F.col("n") >= 20)
    rows = with_constants(counted, t.main, r=F.avg("y"), t=F.count("*"))
    gap = F.col("o") - F.col("r")
    value = rows.groupBy("k", "r").agg(F.sum(F.col("n") / F.col("t") * gap * gap).alias("g")).select("k", (1e5 * F.col("g") / (F.col("r") * (1 - F.col("r")))).alias("v"))
    table = value.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("v"))  # one entry a feature or pair
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _PAIRS])
    made = table.select("v", F.inline(pairs))
    get = lambda key: F.element_at("v", key)
    return made.select("a", "b", F.round(get(F.concat_ws("*", "a", "b")) - get(F.col("a")) - get(F.col("b")), 4).alias("gain"))


@query(
    """+ c AS (SELECT balls * 3 + strikes AS cell, avg(y) AS p FROM m WHERE season < 2024 GROUP BY 1), g AS (SELECT avg(y) AS base FROM m WHERE season < 2024), w AS (SELECT avg(y) AS vbase FROM m WHERE season = 2024),
    o AS (SELECT balls * 3 + strikes AS cell, avg(y) AS q FROM m WHERE season = 2024 GROUP BY 1),
    j AS (SELECT y, coalesce(c.p, base) AS p, 1 / (1 + exp(-(ln(coalesce(c.p, base) / (1 - coalesce(c.p, base))) + ln(vbase / (1 - vbase)) - ln(base / (1 - base))))) AS shifted, q FROM m LEFT JOIN c ON c.cell = balls * 3 + strikes JOIN o ON o.cell = balls * 3 + strikes, g, w WHERE season = 2024)
    SELECT round(1e5 * (1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y)))), 4) AS raw, round(1e5 * (1 - avg((shifted - y) ** 2) / (avg(y) * (1 - avg(y)))), 4) AS shifted, round(1e5 * (1 - avg((q - y) ** 2) / (avg(y) * (1 - avg(y)))), 4) AS oracle FROM j""",
    "m",
)
def cell_bss(t) -> DataFrame:
    """Cell means of the past as predictions: raw, shifted to the season's base rate, and the cells' own means."""
    rows = t.main.withColumn("cell", F.col("balls") * 3 + F.col("strikes"))
    train, valid = rows.where("season < 2024"), rows.where("season = 2024")
    j = with_group_value(valid, train, ["cell"], few=True, p=F.avg("y"))
    j = with_group_value(j, valid, ["cell"], few=True, q=F.avg("y"))
    j = with_constants(with_constants(j, train, base=F.avg("y")), valid, vbase=F.avg("y"))
    z = lambda p: F.log(p / (1 - p))
    p = F.coalesce("p", "base")
    shifted = 1 / (1 + F.exp(-(z(p) + z(F.col("vbase")) - z(F.col("base")))))
    y = F.col("y")
    return j.agg(F.round(skill(p, y), 4).alias("raw"), F.round(skill(shifted, y), 4).alias("shifted"), F.round(skill(F.col("q"), y), 4).alias("oracle"))


@query(
    """+ e AS (SELECT list_distinct(quantile_cont(price, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM m WHERE season < 2024), b AS (SELECT season, y, len(list_filter(e, lambda x: x < price)) AS bin FROM m, e),
    tr AS (SELECT bin, avg(y) AS p FROM b WHERE season < 2024 GROUP BY bin), v AS (SELECT y, p FROM b JOIN tr USING (bin) WHERE season = 2024)
    SELECT round(1e5 * (1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y)))), 4) AS transfer, count(*) AS n FROM v""",
    "m",
)
def decile_transfer(t) -> DataFrame:
    """Right-closed training deciles, duplicate edges dropped, their means scored on the season after."""
    train = t.main.where("season < 2024").select("price", F.lit(0).alias("all"))
    # one row
    edges = exact_quantiles(train, ["all"], "price", [k / 10 for k in range(1, 10)]).select(F.array_distinct("q").alias("e"))
    rows = t.main.select("season", "y", "price").crossJoin(F.broadcast(edges))
    b = rows.withColumn("bin", F.size(F.filter("e", lambda x: x < F.col("price"))))
    j = with_group_value(b.where("season = 2024"), b.where("season < 2024"), ["bin"], "inner", few=True, p=F.avg("y"))
    return j.agg(F.round(skill(F.col("p"), F.col("y")), 4).alias("transfer"), F.count("*").alias("n"))


@query(
    "+ q AS (SELECT quantile_cont(price, [0.25, 0.75]) AS q FROM m) SELECT round(avg(y) FILTER (price > q[2]) - avg(y) FILTER (price <= q[1]), 6) AS spread, count(*) FILTER (price <= q[1]) AS low_n, count(*) FILTER (price > q[2]) AS high_n FROM m, q",
    "m",
)
def quartile_spread(t) -> DataFrame:
    # one row
    cuts = exact_quantiles(t.main.select("price", F.lit(0).alias("all")), ["all"], "price", [0.25, 0.75]).select("q")
    rows = t.main.select("price", "y").crossJoin(F.broadcast(cuts))
    low, high = F.col("price") <= F.col("q")[0], F.col("price") > F.col("q")[1]
    return rows.agg(r6(F.avg(F.when(high, F.col("y"))) - F.avg(F.when(low, F.col("y")))).alias("spread"), F.count_if(low).alias("low_n"), F.count_if(high).alias("high_n"))


_SIGNALS = {
    "platoon": ("ph = bh", "ph <> bh"),
    "risp_li": ("r2 + r3 > 0 AND li >= 1", "r2 + r3 = 0 AND li < 1"),
    "full_two_out": ("balls = 3 AND strikes = 2 AND outs = 2", "balls = 3 AND strikes = 2 AND outs < 2"),
    "close_late": ("abs(diff) <= 1 AND inning >= 7", "abs(diff) > 1 AND inning >= 7"),
}


@query(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS signal, count(*) FILTER ({a}) AS n_pos, count(*) FILTER ({b}) AS n_ref, round(avg(y) FILTER ({a}) - avg(y) FILTER ({b}), 6) AS delta FROM m" for k, (a, b) in _SIGNALS.items()) + ")",
    "m",
)
def signal_delta(t) -> DataFrame:
    one = t.main.agg(
        *[
            F.struct(
                F.lit(k).alias("signal"), F.count_if(F.expr(a)).alias("n_pos"), F.count_if(F.expr(b)).alias("n_ref"), r6(F.avg(F.when(F.expr(a), F.col("y"))) - F.avg(F.when(F.expr(b), F.col("y")))).alias("delta")
            ).alias(k)
            for k, (a, b) in _SIGNALS.items()
        ]
    )
    return one.select(F.inline(F.array(*_SIGNALS)))


@query("SELECT CASE WHEN price < 20000 THEN 'a' WHEN price < 50000 THEN 'b' ELSE 'c' END AS bucket, count(*) AS n, round(avg(y), 6) AS rate FROM m GROUP BY 1", "m")
def priced_buckets(t) -> DataFrame:
    bucket = choose([(F.col("price") < 20000, "a"), (F.col("price") < 50000, "b")], "c")
    return t.main.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), r6(F.avg("y")).alias("rate"))
