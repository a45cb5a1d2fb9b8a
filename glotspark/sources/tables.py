"""Tables as Parquet, and images as binary files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

IMAGES = T.StructType().add("path", "string").add("modificationTime", "timestamp").add("length", "long").add("content", "binary")


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and executors
    share; a local one only with a local master and nothing set."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir", "")
    if not top:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="glotspark-")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df in the shared folder; cuts its lineage."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content of each file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def image_stream(spark: SparkSession, path: str, pattern: str = "*", files_per_batch: int = 100) -> DataFrame:
    """The same for files as they arrive. A stream needs the schema beforehand."""
    return spark.readStream.format("binaryFile").schema(IMAGES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)
