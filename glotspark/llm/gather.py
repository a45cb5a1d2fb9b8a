"""Sums of arrays of fixed length over a whole table, by key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUMS = "name string, salt int, payload binary"


def packed(sums: dict[str, np.ndarray], salt: int):
    """Rows of SUMS, one for each key."""
    for name, values in sums.items():
        payload = len(values).to_bytes(8, "little") + pa.compress(values.astype(np.int64).tobytes(), codec="zstd", asbytes=True)
        yield pa.record_batch({"name": pa.array([name], pa.string()), "salt": pa.array([salt], pa.int32()), "payload": pa.array([payload], pa.binary())})


def unpacked(payload: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(payload[8:], int.from_bytes(payload[:8], "little") * 8, codec="zstd", asbytes=True), np.int64)


def summed(rows: DataFrame, fan: int = 32) -> dict[str, np.ndarray]:
    """Arrays of SUMS rows added by key (those of a key are equally long), in two
    steps that stream: a task holds one array for each of its keys, and the driver
    gets one for each key."""

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, payload in zip(batch["name"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                values = unpacked(payload)
                sums[name] = sums[name] + values if name in sums else values
        yield from packed(sums, 0)

    parts = rows.withColumn("salt", F.pmod("salt", F.lit(fan))).repartition(fan, "name", "salt").mapInArrow(add, SUMS)
    return {r["name"]: unpacked(r["payload"]) for r in parts.repartition(8, "name").mapInArrow(add, SUMS).toLocalIterator()}
