"""What a stream remembers from batch to batch, in Spark's state store.

Both operators need the RocksDB state store (``state_store`` sets it for the session);
state lies in the checkpoint and survives restarts and lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from glotspark.functions.text import fresh
from glotspark.operators.backends import Translator
from glotspark.operators.translate import content_key
from glotspark.streaming.windows import timed

CALL = 256


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Remembering(StatefulProcessor):
    """A bucket of texts: translations that it has given, by text."""

    def __init__(self, translator: Translator, source: str, target: str, text: str, out: str, bucket: str, ttl_ms: int | None):
        self.translator, self.source, self.target, self.text, self.out, self.bucket, self.ttl_ms = translator, source, target, text, out, bucket, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = self.translator.load()
        self.known = handle.getMapState("translations", T.StructType().add("text", "string"), T.StructType().add("translated", "string"), self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for some in rows:
            texts = [t for t in some[self.text].unique() if isinstance(t, str)]
            made = {t: self.known.getValue((t,))[0] for t in texts if self.known.containsKey((t,))}
            fresh_ones = [t for t in texts if t not in made]
            for a in range(0, len(fresh_ones), CALL):
                part = fresh_ones[a : a + CALL]
                for t, translated in zip(part, self.run(part, self.source, self.target), strict=True):
                    self.known.updateValue((t,), (translated,))
                    made[t] = translated
            some = some.drop(columns=[self.bucket])
            some[self.out] = some[self.text].map(lambda t: made.get(t))
            yield some

    def close(self) -> None:
        pass


def remembered(stream: DataFrame, translator: Translator, text_col: str = "text", out: str = "translated", source: str = "en", target: str = "ko", buckets: int = 200, keep: str | None = None) -> DataFrame:
    """The rows of a stream with their texts' translations; each distinct text
    reaches the model once, over all batches (and again after ``keep``, a duration such as
    "30 days" of processing time, where given).

    Texts are dealt to buckets by hash, and a bucket asks the model for all texts of a
    batch that it doesn't know, up to 256 at a time. Rows pass in Arrow batches, so a text
    that very many rows share costs no memory. A null text stays null and isn't asked for;
    a column of the name of out is replaced. buckets: fixed for the life of a checkpoint."""
    bucket = fresh("bucket", *stream.columns)
    rows = stream.drop(*(c for c in stream.columns if c.lower() == out.lower() and c != text_col))
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])
    dealt = rows.withColumn(bucket, F.pmod(F.xxhash64(F.col(f"`{text_col}`")), F.lit(buckets)).cast("int"))
    ttl = None if keep is None else _milliseconds(keep)
    return dealt.groupBy(bucket).transformWithStateInPandas(_Remembering(translator, source, target, text_col, out, bucket, ttl), schema, "Append", "ProcessingTime" if ttl else "None")


class _First(StatefulProcessor):
    """A key: until when it is known, once a row of it was given out."""

    def __init__(self, columns: list[str], time: str, keep_ms: int, zone: str):
        self.columns, self.time, self.keep_ms, self.zone = columns, time, keep_ms, zone

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", T.StructType().add("until", "long"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.seen.get()[0] if self.seen.exists() else None
        if until is not None:
            if timerValues.getCurrentWatermarkInMs() < until:  # timers come after the rows of a batch
                for _ in rows:
                    pass
                return
            self.handle.deleteTimer(until)
        first = None
        for some in rows:
            best = some.sort_values([self.time, *(c for c in self.columns if c != self.time)], kind="stable").head(1)
            first = best if first is None else pd.concat([first, best]).sort_values([self.time, *(c for c in self.columns if c != self.time)], kind="stable").head(1)
        time = first[self.time].iloc[0]
        time = time if time.tzinfo else time.tz_localize(self.zone, ambiguous=True, nonexistent="shift_forward")
        until = int(time.timestamp() * 1000) + self.keep_ms
        self.handle.registerTimer(until)
        self.seen.update((until,))
        yield first[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def _earliest(key: str, order: list[str]):
    """Of Arrow batches the first row of each key in this order."""

    def least(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts)
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in (key, *order)]))
        keys = table[key].combine_chunks()
        new = pc.not_equal(keys[1:], keys[:-1])
        return table.filter(pa.concat_arrays([pa.array([True][: len(keys)], pa.bool_()), new]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, 1 << 16
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            n += len(batch)
            if n > most:
                held = [least(held)]
                n = len(held[0])
                most = max(most, 2 * n)
        if n:
            yield from least(held).to_batches()

    return run


def first_of_each(stream: DataFrame, keys: list[str], time_col: str, keep: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """One row for each key: of the first batch that has any, the earliest (ties: the
    least in the order of its columns). keep: the key is forgotten once the watermark, which
    stays delay behind the latest time, is that much past that row's time; its next row is
    given again. Rows without a time go, and so do rows behind the watermark. A null key is a
    key. Only columns that can be sorted should be there.

    Without keep, tasks first reduce a batch to a row a key, before and after a
    shuffle, and Spark's own state (dropDuplicates, of 32 bytes a key) tells which keys are new. With
    keep each key's rows and timer go through Python, which takes far longer for many keys."""
    rows = timed(stream, time_col)
    if keep is None:
        key = fresh("key", *rows.columns)
        floats = ("float", "double")
        equal = lambda k: F.col(f"`{k}`") + F.lit(0.0) if rows.schema[k].dataType.simpleString() in floats else F.col(f"`{k}`")  # noqa: E731  -0.0 is 0.0
        keyed = rows.select("*", content_key(*map(equal, keys)).alias(key))
        reduce = _earliest(key, [time_col, *(c for c in rows.columns if c != time_col)])
        once = keyed.mapInArrow(reduce, keyed.schema).repartition(key).mapInArrow(reduce, keyed.schema)
        return once.dropDuplicates([key]).drop(key)
    rows = rows.withWatermark(time_col, delay)
    return rows.groupBy(*keys).transformWithStateInPandas(_First(rows.columns, time_col, _milliseconds(keep), stream.sparkSession.conf.get("spark.sql.session.timeZone")), rows.schema, "Append", "EventTime")


def _milliseconds(duration: str) -> int:
    number, unit = duration.split()
    return int(float(number) * {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.lower().rstrip("s")])
