"""Recognition and translation of images as they arrive."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from glotspark.operators.backends import Recognizer, Translator
from glotspark.plans.routes import read_and_translate
from glotspark.sources.tables import image_stream


def translated_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, recognizer: Recognizer, translator: Translator, source: str = "en", target: str = "ko", once: bool = False) -> StreamingQuery:
    """Appends path, modificationTime, text and translated to Parquet under out.
    The steps are stateless, so a restart from the checkpoint gives each file
    once. once: what is there now, then stop."""
    found = read_and_translate(image_stream(spark, folder), recognizer, translator, source, target).select("path", "modificationTime", "text", "translated")
    writer = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "64")  # images, not numbers; a stream keeps the settings that it starts with
    try:
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
    finally:
        spark.conf.set(name, before)
