"""Sentence pairs for fine-tuning a translator outside Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def training_pairs(pairs: DataFrame, least: int = 1, longest: int = 1000, ratio: float = 3.0, valid_percent: int = 5, test_percent: int = 5) -> DataFrame:
    """src_text and tgt_text cleaned: neither is null or blank, lengths lie within
    bounds and within a ratio, each pair comes once. split: train, valid or test
    by a hash of the source, so that a source never falls into two of them."""
    a, b = F.length("src_text"), F.length("tgt_text")
    clean = pairs.select(F.trim("src_text").alias("src_text"), F.trim("tgt_text").alias("tgt_text"))
    clean = clean.filter((a >= least) & (b >= least) & (a <= longest) & (b <= longest) & (a <= b * ratio) & (b <= a * ratio)).distinct()
    share = F.pmod(F.conv(F.substring(F.md5(F.col("src_text").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(100))
    return clean.withColumn("split", F.when(share < test_percent, "test").when(share < test_percent + valid_percent, "valid").otherwise("train"))
