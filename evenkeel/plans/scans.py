"""Scans of text files: two passes by position, targets attached in order, readings in lock-step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import flag, r6
from ..operators import encode, governance, grouped
from ..sources import positions, readers, sinks
from ..sources.stage import shared_dir
from .registry import query

PARTS = 6
ROWS = T.StructType([T.StructField("id", T.LongType()), T.StructField("entity", T.LongType()), T.StructField("season", T.IntegerType()), T.StructField("status", T.StringType()), T.StructField("amount", T.DoubleType())])


def _frame_csv(t) -> str:
    return positions.written_csv(t.frame.select(*ROWS.fieldNames()), ["id"], PARTS, "frame")


@query("+ p AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, id, season, amount FROM f) SELECT pos, id, amount FROM p WHERE season IN (1996, 1997)", "f")
def scan_positions(t) -> DataFrame:
    """Rows of two seasons out of CSV files, found in a pass over the season alone and read by position."""
    return positions.read_scoped(t.spark, _frame_csv(t), ROWS, F.col("season").isin(1996, 1997), ["id", "amount"], ["season"])


@query("SELECT row_number() OVER (ORDER BY id) - 1 AS pos, id, season, (status = 'F')::INT AS y FROM f", "f")
def attach_in_order(t) -> DataFrame:
    """Targets out of a file of their own, attached row by row once the order of all keys is known to be that of the features."""
    targets = positions.written_csv(t.frame.select("id", flag(F.col("status") == "F").alias("y")), ["id"], PARTS + 3, "targets")
    features = positions.positioned(t.spark.read.schema(ROWS).csv(_frame_csv(t), header=True).select("id", "season"))
    return positions.attach_in_order(features, positions.positioned(t.spark.read.schema("id bigint, y int").csv(targets, header=True)), "id")


LINES = T.StructType([T.StructField("sale_id", T.LongType()), T.StructField("line_no", T.IntegerType()), T.StructField("quantity", T.IntegerType()), T.StructField("amount", T.IntegerType()), T.StructField("discount", T.DoubleType()), T.StructField("flag", T.IntegerType())])
AUDITED = ["sale_id", "quantity", "amount", "discount", "flag"]


@query(
    """WITH l AS (SELECT unnest(['sale_id', 'quantity', 'amount', 'discount', 'flag']) AS field, unnest([sale_id IS NULL, quantity IS NULL, amount IS NULL, discount IS NULL, coalesce(flag, '') = '']) AS empty,
    unnest(['integer_lexeme', 'integer_lexeme', 'decimal_lexeme', 'decimal_lexeme', 'other_lexeme']) AS written, unnest([false, false, true, false, true]) AS fails FROM sale_lines)
    SELECT field, CASE WHEN empty THEN 'empty' ELSE written END AS kind, count(*) AS n, count(*) FILTER (fails AND NOT empty) AS failed FROM l GROUP BY 1, 2""",
)
def lockstep_scan(t) -> DataFrame:
    """How tokens of a text file are written, and which of them a schema of whole amounts and numbered flags can't parse; one scan of the lines."""
    rows = t.raw("sale_lines").select(*[F.col(f.name) for f in LINES])
    path = positions.written_csv(rows, ["sale_id", "line_no"], PARTS, "lines", header=False)
    return positions.lexical_audit(positions.lockstep(t.spark.read.text(path), LINES), AUDITED)


TYPED = T.StructType([T.StructField("id", T.LongType()), T.StructField("entity", T.IntegerType()), T.StructField("season", T.ShortType()), T.StructField("status", T.StringType()), T.StructField("amount", T.FloatType())])


@query("SELECT season, count(*) AS n, count(DISTINCT entity) AS entities, round(sum(amount), 0) AS amount FROM (SELECT season, entity, floor(amount::FLOAT::DOUBLE / 100) AS amount FROM f) GROUP BY season", "f")
def contract_scan(t) -> DataFrame:
    """A CSV whose header is checked without reading a row, scanned with narrow types, and of whose columns the target can't be asked for."""
    path = _frame_csv(t)
    readers.validate_header(t.spark, path, TYPED.fieldNames())
    rows = readers.project(readers.scan_csv(t.spark, path, TYPED), ["season", "entity", "amount"], forbidden=("status",))
    return rows.groupBy(F.col("season").cast("int").alias("season")).agg(F.count("*").alias("n"), F.countDistinct("entity").alias("entities"), F.round(F.sum(F.floor(F.col("amount").cast("double") / 100)).cast("double"), 0).alias("amount"))


LEVELS = ["fastball", "breaking", "offspeed"]


@query("""+ x AS (SELECT *, (family = 'breaking')::INT AS b, (family = 'fastball')::INT AS f, (family = 'offspeed')::INT AS o FROM h) SELECT event_id, b AS "family=breaking", f AS "family=fastball", o AS "family=offspeed" FROM x""", "h")
def one_hot_encode(t) -> DataFrame:
    """A column for each level, in order of names; a family that wasn't seen has zeros only."""
    return governance.one_hot(t.history.select("event_id", "family"), "family", LEVELS).drop("family")


@query("SELECT rk, ph, bh, season, diff FROM m", "m")
def distinct_columns(t) -> DataFrame:
    """Columns that repeat an earlier one in every row are dropped."""
    rows = t.main.select("rk", "ph", F.col("ph").alias("ph_again"), "bh", "season", (F.col("season") + 0).alias("season_too"), "diff")
    return encode.without_repeated_columns(rows)


@query("SELECT pid, round(avg(y), 6) AS rate, count(*) AS n FROM m WHERE (balls = 3 OR strikes = 2) AND li >= 1 AND game_type = 'R' GROUP BY pid HAVING count(*) >= 5", "m")
def string_predicate(t) -> DataFrame:
    """A rate table of the rows that a predicate given as text selects."""
    made = grouped.rate_table(t.main.where("(balls = 3 OR strikes = 2) AND li >= 1 AND game_type = 'R'"), ["pid"], min_support=5)
    return made.select("pid", r6("rate").alias("rate"), "n")


@query("SELECT season, status, count(*) AS n, round(avg(floor(amount)), 4) AS mean FROM f GROUP BY season, status", "f")
def golden_table(t) -> DataFrame:
    """A small table written as one sorted CSV and read back."""
    made = t.frame.groupBy("season", "status").agg(F.count("*").alias("n"), F.round(F.avg(F.floor("amount")), 4).alias("mean"))
    path = f"{shared_dir(t.spark)}/golden-{uuid.uuid4().hex}"
    sinks.golden_csv(made, path, ["season", "status"])
    return t.spark.read.schema("season int, status string, n bigint, mean double").csv(path, header=True)


@query(
    """+ x AS (SELECT season, count(*) AS n, sum((status = 'F')::INT)::BIGINT AS hits FROM f GROUP BY season), j AS (SELECT '{"hits":' || hits || ',"n":' || n || ',"season":' || season || '}' AS line FROM x),
    d AS (SELECT sha256(array_to_string(list(line ORDER BY line), chr(10))) AS digest FROM j)
    SELECT '# Hits by season' AS line UNION ALL SELECT '' UNION ALL SELECT 'Canonical SHA-256: `' || digest || '`' FROM d UNION ALL SELECT '' UNION ALL SELECT '| season | n | hits |' UNION ALL SELECT '| --- | --- | --- |'
    UNION ALL SELECT '| ' || season || ' | ' || n || ' | ' || hits || ' |' FROM x""",
    "f",
)
def report_sink(t) -> DataFrame:
    """The lines of a report's Markdown, as it was written."""
    made = t.frame.groupBy("season").agg(F.count("*").alias("n"), F.sum(flag(F.col("status") == "F")).alias("hits"))
    folder = f"{shared_dir(t.spark)}/report-{uuid.uuid4().hex}"
    sinks.write_report(made, folder, "Hits by season", ["season"])
    return t.spark.read.text(f"{folder}/md").withColumnRenamed("value", "line")
