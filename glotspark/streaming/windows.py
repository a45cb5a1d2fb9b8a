"""Windows over event time, for batches and streams alike.

In a stream rows may come late by ``delay``; a window is given out once, when the
watermark (the latest time seen so far, less the delay) has passed its end, and its
state is dropped. Rows that come later than that are dropped and counted in the
query's progress. In a batch all windows are given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotspark.functions.text import fresh

Kind = Callable[[Column], Column]


def tumbling(width: str, start: str | None = None) -> Kind:
    """Windows end to end; start: their offset from the epoch."""
    return lambda time: F.window(time, width, startTime=start)


def sliding(width: str, slide: str) -> Kind:
    """Windows of a width, one every slide: a row is in width / slide of them."""
    return lambda time: F.window(time, width, slide)


def session(gap: str) -> Kind:
    """A window for each run of rows (of a key) less than gap apart; it ends a gap
    after its last row."""
    return lambda time: F.session_window(time, gap)


def timed(events: DataFrame, time_col: str) -> DataFrame:
    """time_col as a timestamp, as watermarks need it; one without time zone is taken
    in the session's. Rows without a time go: they are in no window."""
    if isinstance(events.schema[time_col].dataType, T.TimestampNTZType):
        events = events.withColumn(time_col, F.col(f"`{time_col}`").cast("timestamp"))
    return events.filter(F.col(f"`{time_col}`").isNotNull())


def windowed(events: DataFrame, time_col: str, kind: Kind, aggregates: list[Column], keys: list[str] | None = None, delay: str = "0 seconds") -> DataFrame:
    """window_start, window_end, keys and aggregates (each with an alias).

    Aggregates are summed up before the shuffle, so a frequent key costs a row for each
    task and window; a session is put together from such rows (set
    spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition to do so before the
    shuffle). A null key is a key. An empty table gives no windows."""
    keys = keys or []
    rows = timed(events, time_col)
    if rows.isStreaming:
        rows = rows.withWatermark(time_col, delay)
    name = fresh("window_", *keys)
    found = rows.groupBy(kind(F.col(f"`{time_col}`")).alias(name), *(F.col(f"`{k}`") for k in keys)).agg(*aggregates)
    start, end = fresh("window_start", *keys), fresh("window_end", *keys)
    rest = [F.col(f"`{c}`") for c in found.columns if c != name]
    return found.select(F.col(f"{name}.start").alias(start), F.col(f"{name}.end").alias(end), *rest)
