"""Batches of a stream as Parquet, each exactly once.

A batch is written to a folder of its own number, and then recorded. A batch that
was killed before its record is written anew in the same place, one that has a
record is left as it is, and readers take recorded batches only: so neither a killed
nor a replayed batch leaves duplicates or halves behind.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def exactly_once(stream: DataFrame, out: str, checkpoint: str, once: bool = False, work: Callable[[DataFrame], DataFrame] | None = None, output_mode: str = "append") -> StreamingQuery:
    """Writes the stream's batches below out, in folders of the Hadoop file system that
    the driver and executors share; ``committed`` reads them. work: what becomes of a
    batch before it is written (it isn't called for a batch that is recorded). once:
    what is there now, then stop. Batches without rows leave a record only.

    An output belongs to one checkpoint: with another one batch numbers mean other rows,
    so that is an error."""
    known: dict[str, str] = {}

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not known:
            known["id"] = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
            others = [n for n in _names(spark, f"{out}/_records") if n.split(".")[0] != known["id"]]
            if others:
                raise ValueError(f"{out} holds batches of another checkpoint")
        fs, record = _file_system(spark, f"{out}/_records/{known['id']}.{number}")
        if fs.exists(record):
            return
        (work(batch) if work else batch).write.mode("overwrite").parquet(f"{out}/batch_{number}")
        fs.create(record, True).close()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(output_mode)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def committed(spark: SparkSession, out: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all recorded batches; none is an empty table."""
    numbers = sorted(int(n.split(".")[1]) for n in _names(spark, f"{out}/_records"))
    paths = [f"{out}/batch_{n}" for n in numbers]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
