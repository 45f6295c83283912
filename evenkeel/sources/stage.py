"""Small intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only where no checkpoint folder is set and driver and executors share one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/evenkeel"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, else the context's checkpoint folder. checkpoint() is made to use it too.

    Without either, a local session takes a local folder and a cluster is refused, as its executors would write to
    disks that nobody else reads.
    """
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    at = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if at is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = LOCAL_CHECKPOINTS
    if known.isEmpty():
        context.setCheckpointDir(at)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it from there.

    The files outlive any executor, so what follows never recomputes df, and all readers see
    the same rows even where df holds generated row ids.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
