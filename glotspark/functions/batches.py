"""The size of what goes to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> None:
    """Arrow batches of a few MB: texts are long, and the default of 10,000 rows
    would put as many of them at once into the JVM and into Python."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
