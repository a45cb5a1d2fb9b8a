"""The shared folder for checkpoints."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

from glotspark.functions.batches import prepare  # noqa: F401  operators take it from here


def checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go where the cluster says (spark.checkpoint.dir). A local
    folder is used only where nothing is set and all runs on this machine."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir", "")
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="glotspark-")
    context.setCheckpointDir(folder)


def checkpointed(df):
    """The rows of df in the shared folder; cuts its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files that nothing refers to any more. It does
    so when the driver's JVM collects their handles, which may be much later."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


PARTITION_ROWS = 50_000


@contextmanager
def planned_at_once(spark: SparkSession, rows: int | None = None):
    """Adaptive planning is off meanwhile: such plans say how their rows are
    partitioned, and a job of many small steps is one plan, not one for each.
    rows: of the largest step, of a few numbers each; shuffles then have a
    partition for each PARTITION_ROWS of them, as far as the session has so many."""
    names = {"spark.sql.adaptive.enabled": "false"}
    if rows is not None:
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        names["spark.sql.shuffle.partitions"] = str(min(most, 1 + rows // PARTITION_ROWS) if rows < most * PARTITION_ROWS else most)
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def laid_out(df, key: str):
    """df hash partitioned by key in the shared folder, so that a later grouping
    by key reads its partitions where they are."""
    spark = df.sparkSession
    with planned_at_once(spark):
        return checkpointed(df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key))


def written(df):
    """df as Parquet in the shared folder, read again."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    release(spark)
    return spark.read.parquet(path)
