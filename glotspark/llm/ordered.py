"""Prefix sums over an order that is spread over many tasks.

A table is range partitioned and sorted by its whole order, so that a key with
very many rows is split. Each partition is folded to one row, the driver adds
these up (one row a partition, never more), and a second pass over the same
partitions starts from what came before. Rows are in the shared checkpoint
folder in between, so both passes see the same partitions, also after a lost
executor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.llm import shared

PRIME = (1 << 127) - 1
BASE = 0x3C6EF372FE94F82BA54FF53A5F1D36F1
ROOT = bytes(16)


def in_order(df: DataFrame, *order) -> DataFrame:
    """df sorted by order over all partitions, with their number as ``part``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shared.checkpointed(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def _with(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    return pa.record_batch([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), more])


def numbered(laid: DataFrame, name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Adds the place of each row in the order, from 1, and running sums (of whole
    numbers): name of a column: name of its sum, the row itself included."""
    sums = sums or {}
    totals = laid.groupBy("part").agg(F.count("*").alias("n"), *(F.sum(c).alias(f"sum_{i}") for i, c in enumerate(sums))).orderBy("part").collect()
    before, so_far = {}, [0] * (1 + len(sums))
    for row in totals:
        before[row["part"]] = list(so_far)
        so_far = [a + b for a, b in zip(so_far, list(row)[1:], strict=True)]

    def scan(batches):
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = at or list(before[batch["part"][0].as_py()])
            values = [np.ones(batch.num_rows, np.int64), *(batch[c].to_numpy(zero_copy_only=False) for c in sums)]
            running = [np.cumsum(v, dtype=np.int64) + a for v, a in zip(values, at, strict=True)]
            at = [int(r[-1]) for r in running]
            yield _with(batch, **{k: pa.array(r) for k, r in zip([name, *sums.values()], running, strict=True)})

    return laid.mapInArrow(scan, _schema(laid, ", ".join(f"`{c}` long" for c in [name, *sums.values()])))


def chained(laid: DataFrame, key: str, code: str) -> DataFrame:
    """Adds, within the rows of each key, how many codes there have been (``nth``),
    a 127-bit hash of them in order (``chain``) and that of those before the last
    (``previous``). A null code is a row that adds nothing.

    The hash is a polynomial modulo a prime over codes that are digests: what two
    stretches of a key give can be put together, so a key may be in any number of
    partitions."""

    def fold(batches):
        first = last = None
        part, alone, n, h = None, True, 0, 0
        for batch in batches:
            for k, c in zip(batch[key].to_pylist(), batch[code].to_pylist(), strict=True):
                if part is None:
                    part, first, last = batch["part"][0].as_py(), k, k
                elif k != last:
                    alone, last, n, h = False, k, 0, 0
                if c is not None:
                    n, h = n + 1, (h * BASE + int.from_bytes(c)) % PRIME
        if part is not None:
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64()), "alone": pa.array([alone]), "n": pa.array([n], pa.int64()), "h": pa.array([h.to_bytes(16)], pa.binary())})

    ends = laid.select("part", key, code).mapInArrow(fold, "part int, first long, last long, alone boolean, n long, h binary").collect()
    carried, last, state = {}, None, (0, 0)
    for row in sorted(ends, key=lambda r: r["part"]):
        before = state if last is not None and row["first"] == last[0] else (0, 0)
        carried[row["part"]] = before
        own = (row["n"], int.from_bytes(row["h"]))
        state = ((before[0] + own[0], (before[1] * pow(BASE, own[0], PRIME) + own[1]) % PRIME)) if row["alone"] else own
        last = (row["last"],)

    def scan(batches):
        part, last, n, h, previous = None, None, 0, 0, ROOT
        for batch in batches:
            nth, chain, earlier = [], [], []
            for k, c in zip(batch[key].to_pylist(), batch[code].to_pylist(), strict=True):
                if part is None:
                    part, last = batch["part"][0].as_py(), k
                    n, h = carried[part]
                elif k != last:
                    last, n, h = k, 0, 0
                if c is not None:
                    previous = h.to_bytes(16)
                    n, h = n + 1, (h * BASE + int.from_bytes(c)) % PRIME
                nth.append(n)
                chain.append(h.to_bytes(16))
                earlier.append(previous if c is not None else None)
            yield _with(batch, nth=pa.array(nth, pa.int64()), chain=pa.array(chain, pa.binary()), previous=pa.array(earlier, pa.binary()))

    return laid.mapInArrow(scan, _schema(laid, "nth long, chain binary, previous binary"))
