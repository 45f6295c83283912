"""The driver's tables and the shapes that the analytics operators expect of them.

``main`` is the fact table: one row a game state, with target, seasons, entities, rates and two
member probabilities. ``history`` is the event log whose strictly-past aggregates may flow to
main. ``frame`` is a table with a unique key for sampling. Each is a projection, so column pruning and
filters reach the Parquet scan. The texts in ``*_SQL`` define the same shapes for the oracle.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_SEASON, LAST_SEASON = 2019, 2025


def _history_columns() -> list[Column]:
    kind = F.col("event_type")
    return [
        F.col("event_id"),
        F.col("ts"),
        F.col("user_id").alias("uid"),
        (F.floor((F.dayofmonth("ts") - 1) / 5) + FIRST_SEASON).cast("int").alias("season"),
        F.when(kind == "view", "fastball").when(kind == "click", "breaking").when(kind == "purchase", "offspeed").otherwise("other").alias("family"),
        (F.col("event_id") % 4).cast("int").alias("balls"),
        (F.floor(F.col("event_id") / 4) % 3).cast("int").alias("strikes"),
        (F.col("user_id") % 3).cast("int").alias("outs"),
        (F.col("user_id") % 2 + 1).cast("int").alias("hand"),
        F.col("value"),
    ]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def main(self) -> DataFrame:
        ok, q = F.col("l_orderkey"), F.col("l_quantity").cast("int")
        rate = F.round(F.col("l_discount") * 10, 4)
        prev1 = F.round(F.col("l_tax") * 10, 4)
        return self.raw("lineitem").select(
            F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd"), q).alias("rk"),
            (F.year("l_shipdate") + 24).alias("season"),
            F.month("l_shipdate").alias("month"),
            F.weekday("l_shipdate").alias("dow"),
            F.when(F.col("l_linestatus") == "O", "R").otherwise("F").alias("game_type"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
            F.col("l_suppkey").alias("pid"),
            F.col("l_partkey").alias("bid"),
            (F.col("l_linenumber") - 1).alias("balls"),
            (q % 3).alias("strikes"),
            (F.col("l_partkey") % 3).cast("int").alias("outs"),
            (F.col("l_suppkey") % 2 + 1).cast("int").alias("ph"),
            (F.col("l_partkey") % 2 + 1).cast("int").alias("bh"),
            (q % 12 + 1).alias("inning"),
            F.when(ok % 2 == 0, "T").otherwise("B").alias("tb"),
            (ok % 2).cast("int").alias("r1"),
            (F.floor(ok / 2) % 2).cast("int").alias("r2"),
            (F.floor(ok / 4) % 2).cast("int").alias("r3"),
            F.round(F.col("l_tax") * 50, 4).alias("li"),
            (ok % 11 - 5).cast("int").alias("diff"),
            (q * 10 - 10).cast("long").alias("n_p"),
            (F.col("l_partkey") % 300).alias("n_b"),
            F.nullif(rate, F.lit(0.0)).alias("rate"),
            F.nullif(prev1, F.lit(0.0)).alias("prev1"),
            F.round((F.col("l_discount") + F.col("l_tax")) * 5, 4).alias("prev5"),
            F.round(0.2 + 0.4 * F.col("l_discount") * 10, 6).alias("p0"),
            F.round(0.25 + 0.3 * F.col("l_tax") * 10, 6).alias("p1"),
            F.col("l_extendedprice").alias("price"),
        )

    @cached_property
    def history(self) -> DataFrame:
        return self.raw("events").select(*_history_columns())

    @cached_property
    def physics(self) -> DataFrame:
        """history with six measures: the value, a number inside the JSON text, and what the clock says."""
        k = F.get_json_object("props", "$.k").cast("double")
        return self.raw("events").select(
            *_history_columns(),
            F.col("value").alias("speed"),
            k.alias("spin"),
            (F.minute("ts") + F.second("ts") / 60).alias("lift"),
            (F.col("value") / (1 + k)).alias("reach"),
            F.hour("ts").cast("double").alias("height"),
            F.abs(F.col("value") - k).alias("sweep"),
        )

    @cached_property
    def frame(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("entity"),
            F.year("o_orderdate").alias("season"),
            F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").alias("amount"),
            F.col("o_orderpriority").alias("priority"),
        )


MAIN_SQL = """m AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d'), l_quantity::INT) AS rk,
         (year(l_shipdate) + 24)::INT AS season, month(l_shipdate)::INT AS month, (isodow(l_shipdate) - 1)::INT AS dow,
         CASE WHEN l_linestatus = 'O' THEN 'R' ELSE 'F' END AS game_type, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
         l_suppkey AS pid, l_partkey AS bid, (l_linenumber - 1)::INT AS balls, (l_quantity::INT % 3)::INT AS strikes, (l_partkey % 3)::INT AS outs,
         (l_suppkey % 2 + 1)::INT AS ph, (l_partkey % 2 + 1)::INT AS bh, (l_quantity::INT % 12 + 1)::INT AS inning,
         CASE WHEN l_orderkey % 2 = 0 THEN 'T' ELSE 'B' END AS tb,
         (l_orderkey % 2)::INT AS r1, (l_orderkey // 2 % 2)::INT AS r2, (l_orderkey // 4 % 2)::INT AS r3,
         round(l_tax * 50, 4) AS li, (l_orderkey % 11 - 5)::INT AS diff, (l_quantity::INT * 10 - 10)::BIGINT AS n_p, (l_partkey % 300)::BIGINT AS n_b,
         nullif(round(l_discount * 10, 4), 0) AS rate, nullif(round(l_tax * 10, 4), 0) AS prev1, round((l_discount + l_tax) * 5, 4) AS prev5,
         round(0.2::DOUBLE + 0.4::DOUBLE * l_discount * 10, 6) AS p0, round(0.25::DOUBLE + 0.3::DOUBLE * l_tax * 10, 6) AS p1, l_extendedprice AS price
  FROM lineitem
)"""

HISTORY_SQL = """h AS (
  SELECT event_id, ts, user_id AS uid, ((day(ts) - 1) // 5 + 2019)::INT AS season,
         CASE event_type WHEN 'view' THEN 'fastball' WHEN 'click' THEN 'breaking' WHEN 'purchase' THEN 'offspeed' ELSE 'other' END AS family,
         (event_id % 4)::INT AS balls, (event_id // 4 % 3)::INT AS strikes, (user_id % 3)::INT AS outs, (user_id % 2 + 1)::INT AS hand, value
  FROM events
)"""

PHYSICS_SQL = """g AS (
  SELECT event_id, ((day(ts) - 1) // 5 + 2019)::INT AS season,
         CASE event_type WHEN 'view' THEN 'fastball' WHEN 'click' THEN 'breaking' WHEN 'purchase' THEN 'offspeed' ELSE 'other' END AS family,
         (event_id % 4)::INT AS balls, (event_id // 4 % 3)::INT AS strikes, (user_id % 3)::INT AS outs, value AS speed, json_extract(props, '$.k')::DOUBLE AS spin,
         minute(ts) + second(ts) / 60 AS lift, value / (1 + json_extract(props, '$.k')::DOUBLE) AS reach, hour(ts)::DOUBLE AS height, abs(value - json_extract(props, '$.k')::DOUBLE) AS sweep
  FROM events
)"""

FRAME_SQL = """f AS (
  SELECT o_orderkey AS id, o_custkey AS entity, year(o_orderdate)::INT AS season, o_orderstatus AS status, o_totalprice AS amount, o_orderpriority AS priority
  FROM orders
)"""
