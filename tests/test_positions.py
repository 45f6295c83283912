"""Positions over many splits, ordered attachment, and lock-step readings in batch and stream."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators import governance
from evenkeel.sources import positions
from evenkeel.sources.readers import ContractError
from evenkeel.streaming import increments

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("season", T.IntegerType()), T.StructField("v", T.StringType())])


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], "700")
    spark.conf.set(keys[1], "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Three files of 150 rows in order of id, seasons apart in the middle file only."""
    path = tmp_path_factory.mktemp("csv")
    for k in range(3):
        lines = ["id,season,v"] + [f"{i},{2019 + (i % 2 if k == 1 else 0)},{'x' * (i % 7)}" for i in range(150 * k, 150 * (k + 1))]
        (path / f"part-{k}.csv").write_text("\n".join(lines) + "\n")
    return str(path)


def test_positions_over_splits(spark, folder, small_splits):
    scan = spark.read.schema(SCHEMA).csv(folder, header=True)
    assert scan.rdd.getNumPartitions() > 6
    assert {(r["id"], r["pos"]) for r in positions.positioned(scan.select("id")).collect()} == {(i, i) for i in range(450)}


def test_two_passes_open_only_files_with_wanted_rows(spark, folder, small_splits):
    got = positions.read_scoped(spark, folder, SCHEMA, F.col("season") == 2020, ["id", "v"], ["season"]).collect()
    assert {(r["id"], r["pos"]) for r in got} == {(i, i) for i in range(151, 300, 2)} and all(len(r["v"] or "") == r["id"] % 7 for r in got)
    middle = spark.read.schema(SCHEMA).csv(folder, header=True).where(F.col("_metadata.file_path").endswith("part-1.csv"))
    assert [os.path.basename(r[0]) for r in middle.select("_metadata.file_path").distinct().collect()] == ["part-1.csv"]
    assert positions.read_scoped(spark, folder, SCHEMA, F.col("season") == 1999, ["id"], ["season"]).count() == 0


def test_targets_in_another_order_are_refused(spark):
    rows = [(i, i * 7 % 50) for i in range(50)]
    features = spark.createDataFrame(rows, "pos bigint, id bigint")
    targets = features.withColumn("y", F.col("id") % 2)
    assert {(r["id"], r["y"]) for r in positions.attach_in_order(features, targets, "id").collect()} == {(i, i % 2) for i in range(50)}
    swapped = targets.withColumn("pos", F.when(F.col("pos") == 3, 4).when(F.col("pos") == 4, 3).otherwise(F.col("pos")))
    for bad in (swapped, targets.where("pos < 49"), targets.withColumn("id", F.col("id") + 1)):
        with pytest.raises(ContractError):
            positions.attach_in_order(features, bad, "id")


def test_lockstep_readings_in_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id,v\n1,2\n 3,x\n4,\n5,6.5\n")
    (folder / "b.csv").write_text("id,v\n1e3,7\n,8\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("v", T.IntegerType())])
    made = positions.lexical_audit(positions.lockstep(spark.read.text(str(folder)), schema, "id,v"), ["id", "v"])
    assert {(r["field"], r["kind"]): (r["n"], r["failed"]) for r in made.collect()} == {
        ("id", "integer_lexeme"): (3, 0), ("id", "whitespace_variant"): (1, 1), ("id", "exponent_lexeme"): (1, 1), ("id", "empty"): (1, 0),
        ("v", "integer_lexeme"): (3, 0), ("v", "other_lexeme"): (1, 1), ("v", "empty"): (1, 0), ("v", "decimal_lexeme"): (1, 1),
    }
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(str(folder))
    stream = positions.lexical_audit(positions.lockstep(lines, schema, "id,v"), ["id", "v"])
    assert governance.same_rows(made, increments.run_to_end(stream, "lockstep", str(tmp_path / "cp")))


def test_reports_are_never_overwritten_nor_put_into_the_repository(spark, tmp_path):
    from evenkeel.sources import sinks

    metrics = spark.createDataFrame([(2020, 3, None), (2019, 4, 0.5)], "season int, n int, rate double")
    digest = sinks.write_report(metrics, str(tmp_path / "r"), "Rates", ["season"], keep_out=str(tmp_path / "repo"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "r" / "md")).collect()]
    assert lines == ["# Rates", "", f"Canonical SHA-256: `{digest}`", "", "| season | n | rate |", "| --- | --- | --- |", "| 2019 | 4 | 0.5 |", "| 2020 | 3 |  |"]
    assert digest == sinks.canonical_hash(metrics.orderBy("n").select("rate", "n", "season"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.write_report(metrics, str(tmp_path / "r"), "Rates", ["season"])
    with pytest.raises(ValueError, match="outside"):
        sinks.write_report(metrics, str(tmp_path / "repo" / "out"), "Rates", ["season"], keep_out=str(tmp_path / "repo"))
