"""Aggregates and windows that hold where a few groups have most of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotspark.functions.text import fresh


def distinct_counts(df: DataFrame, sets: list[list[str]], values: dict[str, str]) -> DataFrame:
    """Exact counts of distinct whole numbers for several groupings at once.

    values: name of a count: name of its column. Returns the grouping columns (null where
    a set leaves one out), ``grouping_id`` (Spark's: a bit for each column left out, the
    first column highest), ``n_rows`` and the counts.

    Rows are summed up once, by all columns together, into bitmaps of 32768 values; these
    merge, so the sets share one shuffle of bitmaps instead of one of all rows each. It
    pays where numbers are dense (ids): a bitmap has 4 kB, for a few numbers too. Nulls
    aren't counted; null groups are groups; an empty table has no groups, but for the
    empty set, as SQL has it."""
    for c in values.values():
        if not isinstance(df.schema[c].dataType, T.IntegralType):
            raise TypeError(f"{c}: bitmaps are of whole numbers")
    keys = list(dict.fromkeys(k for s in sets for k in s))
    inner = {k: f"key_{i}" for i, k in enumerate(keys)}
    named = [F.col(f"`{k}`").alias(inner[k]) for k in keys]
    # a row for each value's bitmaps, and one for the number of rows
    parts = [F.struct(F.lit(i).alias("value"), F.bitmap_bucket_number(F.col(f"`{c}`").cast("long")).alias("bucket"), F.bitmap_bit_position(F.col(f"`{c}`").cast("long")).alias("bit")) for i, c in enumerate(values.values())]
    parts.append(F.struct(F.lit(-1).alias("value"), F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("long").alias("bit")))
    rows = df.select(*named, F.explode(F.array(*parts)).alias("p")).select(*inner.values(), "p.*").filter("bucket IS NOT NULL OR value < 0")
    fine = rows.groupBy(*inner.values(), "value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"), F.count("*").alias("n"))
    columns = [F.col(c) for c in inner.values()]
    grouped = [[*(F.col(inner[k]) for k in s), F.col("value"), F.col("bucket")] for s in sets]
    merged = fine.groupingSets(grouped, *columns, F.col("value"), F.col("bucket")).agg(F.grouping_id(*columns, F.col("value"), F.col("bucket")).alias("id"), F.bitmap_or_agg("bits").alias("bits"), F.sum("n").alias("n"))
    final = merged.groupBy(*inner.values(), F.shiftright("id", 2).alias("grouping_id")).agg(
        F.coalesce(F.sum(F.when(F.col("value") < 0, F.col("n"))), F.lit(0).cast("long")).alias("n_rows"),
        *(F.coalesce(F.sum(F.when(F.col("value") == i, F.bitmap_count("bits"))), F.lit(0).cast("long")).alias(f"count_{i}") for i in range(len(values))),
    )
    made = final.select(*(F.col(v).alias(k) for k, v in inner.items()), "grouping_id", "n_rows", *(F.col(f"count_{i}").alias(n) for i, n in enumerate(values)))
    return made


def moving(df: DataFrame, keys: list[str], time_col: str, width: int, aggregates: Callable[[WindowSpec], list[Column]]) -> DataFrame:
    """Adds aggregates over the rows of a key in the last ``width`` (both ends included;
    in the unit of time_col if that is a number, in microseconds if it is a time).

    aggregates: from a window to columns with aliases. Time is cut into stretches of
    width: a row stands in its own and, for others to look back at, in the next one. So
    a key with very many rows is spread over as many tasks as its time has stretches, for
    twice the rows in the shuffle, and any aggregate is exact. Rows of equal time see each
    other; a null key is a key; rows without a time get nulls. Repeated rows stay."""
    if width <= 0:
        raise ValueError("width: more than 0")
    kind = df.schema[time_col].dataType
    time = F.unix_micros(F.col(f"`{time_col}`").cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(f"`{time_col}`").cast("long")
    at, bin, own = (fresh(c, *df.columns) for c in ("at", "bin", "own"))
    stretch = F.expr(f"(`{at}` - pmod(`{at}`, {width}L)) div {width}L")
    rows = df.withColumn(at, time).withColumn(own, F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(bin, stretch + F.col(own)).filter(F.col(at).isNotNull())
    window = W.partitionBy(*keys, bin).orderBy(at).rangeBetween(-width, 0)
    added = aggregates(window)
    made = rows.select(*df.columns, own, *added).filter(F.col(own) == 0).drop(own)
    late = df.filter(F.col(f"`{time_col}`").isNull())
    extra = made.columns[len(df.columns) :]
    return made.unionByName(late.select("*", *(F.lit(None).cast(made.schema[c].dataType).alias(c) for c in extra)))


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, ties: bool = False) -> DataFrame:
    """The first k rows of each group in that order, with their ``rank`` from 1. Rows that
    tie are ordered by their other columns; ties: all rows that tie with the k-th stay, and
    equal rows share a rank. Each task sends k rows a group at most (with ties, those that
    tie). A null key is a group."""
    if k < 1:
        raise ValueError("k: 1 at least")
    rank = fresh("rank", *df.columns)
    orderable = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    window = W.partitionBy(*keys).orderBy(*order, *(() if ties else orderable))
    return df.withColumn(rank, (F.rank() if ties else F.row_number()).over(window)).filter(F.col(rank) <= k)
