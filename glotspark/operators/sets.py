"""Set operations that keep count, and membership by keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.functions.text import fresh

BITS_A_KEY, MOST_BITS, PROBES = 16, 28, 4
U64 = np.uint64


def counted(df: DataFrame) -> DataFrame:
    """Each distinct row (nulls equal each other) and how often it occurs, ``n``."""
    return df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.count("*").alias(fresh("n", *df.columns)))


def _both(left: DataFrame, right: DataFrame) -> tuple[DataFrame, str]:
    if len(left.columns) != len(right.columns):
        raise ValueError("both sides need as many columns")
    n, l, r = (fresh(c, *left.columns) for c in ("n", "left_n", "right_n"))
    tagged = left.select("*", F.lit(1).alias(l), F.lit(0).alias(r)).union(right.select("*", F.lit(0), F.lit(1)))
    return tagged.groupBy(*(F.col(f"`{c}`") for c in left.columns)).agg(F.sum(l).alias(l), F.sum(r).alias(r)).withColumn(n, F.lit(0)), n


def intersect_counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """INTERSECT ALL as distinct rows with their number ``n``: how often a row is in both.
    One grouping of both sides put under one another; rows are summed up before the
    shuffle, so what occurs very often costs a row a task. Columns by place."""
    rows, n = _both(left, right)
    l, r = rows.columns[-3:-1]
    return rows.withColumn(n, F.least(l, r)).filter(F.col(n) > 0).drop(l, r)


def except_counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """EXCEPT ALL in the same way: how much more often a row is in left."""
    rows, n = _both(left, right)
    l, r = rows.columns[-3:-1]
    return rows.withColumn(n, F.col(l) - F.col(r)).filter(F.col(n) > 0).drop(l, r)


def expanded(rows: DataFrame) -> DataFrame:
    """Rows of the above as many times as n, their last column, says."""
    n = rows.columns[-1]
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).drop(n)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def _bits(keys: np.ndarray, width: int) -> np.ndarray:
    a = _mixed(keys)
    b = _mixed(a ^ U64(0x2545F4914F6CDD1D)) | U64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=U64)) >> U64(64 - width)


def _filter_of(hashes: DataFrame):
    """A Bloom filter of a column hash: number of keys, width, broadcast bytes. Tasks set
    bits, a grouping puts words of 64 bits together; 32 MB at most, whatever comes."""
    keys = hashes.distinct()
    n = keys.count()
    width = min(MOST_BITS, max(16, (n * BITS_A_KEY).bit_length()))

    def mark(batches):
        for batch in batches:
            bits = _bits(batch["hash"].to_numpy().view(U64), width).ravel()
            yield pa.record_batch([pa.array((bits >> U64(6)).astype(np.int64)), pa.array((U64(1) << (bits & U64(63))).view(np.int64))], names=["word", "bits"])

    words = keys.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(1 << (width - 6), np.int64)
    whole[words["word"].to_numpy()] = words["bits"].to_numpy()
    return n, width, hashes.sparkSession.sparkContext.broadcast(whole.view(np.uint8))


def _maybe(width: int, sieve):
    @F.pandas_udf("boolean")
    def maybe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = sieve.value
        for hashes in batches:
            probe = _bits(hashes.to_numpy().view(U64), width).astype(np.int64)
            yield pd.Series(((bits[probe >> 3] >> (probe & 7).astype(np.uint8)) & 1).all(1))

    return maybe


def members_of(left: DataFrame, right: DataFrame, on: list[str], absent: bool = False) -> DataFrame:
    """Rows of left whose key is (absent: isn't) in right, as EXISTS and NOT EXISTS say:
    a null in a key equals nothing, so such rows are absent. on: columns of both, of any
    size (long texts too). Rows and repeats of left stay as they are.

    A Bloom filter of right's keys (16 bits a key, 32 MB at most) goes to all tasks; rows
    that it excludes are settled where they are, and only the others are shuffled, to be
    compared by the keys themselves. Beyond some 17 million keys the filter excludes
    less, and more rows are shuffled; the result is the same."""
    n_null = " OR ".join(f"`{c}` IS NULL" for c in on)
    keys = right.select(*on).filter(f"NOT ({n_null})")
    hashed = F.xxhash64(*(F.col(f"`{c}`") for c in on))
    n, width, sieve = _filter_of(keys.select(hashed.alias("hash")))
    whole = left.filter(f"NOT ({n_null})")
    sure, may = fresh("hash", *left.columns), fresh("maybe", *left.columns)
    probed = whole.withColumn(sure, hashed).withColumn(may, _maybe(width, sieve).asNondeterministic()(sure)).drop(sure)
    if not absent:
        return probed.filter(may).drop(may).join(keys, on, "left_semi").select(*left.columns)
    absent_for_sure = probed.filter(~F.col(may)).drop(may)
    kept = probed.filter(may).drop(may).join(keys, on, "left_anti").select(*left.columns).unionByName(absent_for_sure)
    return kept.unionByName(left.filter(n_null))
