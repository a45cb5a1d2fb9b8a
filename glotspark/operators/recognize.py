"""Images to text."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.functions.batches import prepare
from glotspark.functions.text import fresh
from glotspark.operators.backends import Recognizer

SPANS = "text string, conf double, line int, left int, top int, width int, height int"
BATCH = 16


def _recognised(backend: Recognizer, contents: pd.Series, run=None) -> list[list[dict] | None]:
    """Spans of each image, a few images at a time; null for a null image."""
    run = run or backend.load()
    out: list[list[dict] | None] = [None] * len(contents)
    known = [i for i, c in enumerate(contents) if c is not None]
    for at in range(0, len(known), BATCH):
        some = known[at : at + BATCH]
        for i, spans in zip(some, run([bytes(contents.iloc[i]) for i in some]), strict=True):
            out[i] = spans
    return out


def line_text(spans: list[dict]) -> str:
    """Spans of a line with blanks between them, a line feed after each line."""
    return "\n".join(" ".join(s["text"] for s in some) for _, some in itertools.groupby(spans, key=lambda s: s["line"]))


def recognize(images: DataFrame, backend: Recognizer, content_col: str = "content", out: str = "text", batch_rows: int | None = None) -> DataFrame:
    """Adds the recognised text: the spans in order, put together line by line.

    Images are large: give Arrow few rows at a time (batch_rows sets that for the
    session, from then on) and filter by path or length beforehand, so that only
    images that are needed reach Python."""
    prepare(images.sparkSession)
    if batch_rows:
        images.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = backend.load()
        for contents in batches:
            yield pd.Series([None if s is None else line_text(s) for s in _recognised(backend, contents, run)], dtype=object)

    return images.withColumn(out, text(content_col))


def recognize_spans(images: DataFrame, backend: Recognizer, key_col: str = "path", content_col: str = "content") -> DataFrame:
    """One row a span: the key, its position, text, confidence and box. A null image
    has no spans, like one without text. A key named as one of the other columns gets
    an underscore after its name."""

    prepare(images.sparkSession)

    def spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = backend.load()
        for batch in batches:
            rows = [{"key": k, "pos": i, **s} for k, found in zip(batch["key"], _recognised(backend, batch["content"], run), strict=True) for i, s in enumerate(found or [])]
            yield pd.DataFrame(rows, columns=["key", "pos", "text", "conf", "line", "left", "top", "width", "height"])

    kind = images.schema[key_col].dataType.simpleString()
    slim = images.select(F.col(key_col).alias("key"), F.col(content_col).alias("content")).filter(F.col("content").isNotNull())
    return slim.mapInPandas(spans, f"key {kind}, pos int, {SPANS}").withColumnRenamed("key", fresh(key_col, "pos", *(part.split()[0] for part in SPANS.split(", "))))
