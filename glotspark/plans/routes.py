"""Which language pairs can be had, and compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.functions.text import fresh
from glotspark.operators.backends import Recognizer, Translator
from glotspark.operators.recognize import recognize
from glotspark.operators.translate import translate

#: src, tgt, via (null: direct). Pairs are data: extend the table, not the code.
PAIRS = [("en", "ko", None), ("fr", "ko", "en"), ("de", "ko", "en"), ("es", "ko", "en")]


def language_pairs(spark, pairs: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(pairs or PAIRS, "src string, tgt string, via string")


def routed(docs: DataFrame, pairs: DataFrame, target: str, lang_col: str = "lang") -> DataFrame:
    """Documents with their way to the target; those without one are left out."""
    src = fresh("src", *docs.columns)
    wanted = F.broadcast(pairs.filter(F.col("tgt") == target).select(F.col("src").alias(src), "tgt", "via"))  # a row for each language
    return docs.join(wanted, docs[lang_col] == wanted[src]).drop(src)


def read_and_translate(images: DataFrame, recognizer: Recognizer, translator: Translator, source: str = "en", target: str = "ko") -> DataFrame:
    """Images to recognised and translated text, in a batch or a stream."""
    return translate(recognize(images, recognizer), translator, "text", source, target)
