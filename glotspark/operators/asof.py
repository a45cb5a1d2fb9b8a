"""As-of join: each row with the nearest earlier (or later) row of another table.

Both tables are put under one another, tagged by side, range partitioned and sorted
by key, time and side. Each row of the left table then takes the last row of the
right one above it. A key may go through any number of partitions: the last right
row of each partition is carried into those after it, one row a partition (the
driver sees no more), so neither many keys nor one very frequent key makes a task
grow, and no pairs are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotspark.functions.text import fresh
from glotspark.sources.tables import checkpointed


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, columns: list[str] | None = None, direction: str = "backward", strict: bool = False, tolerance: str | None = None) -> DataFrame:
    """All rows and columns of left, with ``columns`` of right (all but its keys where
    None; ``right_`` stands before names that left has) from the row of right with
    equal keys and the greatest right_time not after left_time ("backward"), or the
    least not before it ("forward"); nulls where there is none.

    strict: equal times don't count. tolerance: an interval ("12 hours") that may lie
    between both times at most. Of rows of right that tie in key and time the one
    whose columns are greatest ("backward") or least counts, as a struct in their
    order; so a map can't be among them. A null in a key or time matches nothing.
    Repeated rows of left stay as many. Either table may be empty."""
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction: {direction}")
    spark = left.sparkSession
    back = direction == "backward"
    columns = [c for c in right.columns if c not in on] if columns is None else columns
    names = {c: c if c not in left.columns else fresh(f"right_{c}", *left.columns, *columns) for c in columns}
    keys = [f"key_{i}" for i in range(len(on))]
    known = left
    for c in (*on, left_time):
        known = known.filter(F.col(f"`{c}`").isNotNull())
    unknown = left.filter(" OR ".join(f"`{c}` IS NULL" for c in (*on, left_time)))
    some = right
    for c in (*on, right_time):
        some = some.filter(F.col(f"`{c}`").isNotNull())
    kind = T.StructType([T.StructField(f"c{i}", right.schema[c].dataType) for i, c in enumerate(columns)])
    whole = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(left.schema.fields)])
    side = (0 if back else 1, 1 if back else 0)  # at equal times: right rows come first, unless strict
    above = side if not strict else side[::-1]
    lines = known.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)), F.col(f"`{left_time}`").alias("time"), F.lit(above[1]).alias("side"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(left.columns))).alias("row"), F.lit(None).cast(kind).alias("found"), F.lit(None).cast(right.schema[right_time].dataType).alias("at"), F.lit(False).alias("is_right"))
    marks = some.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(on, keys, strict=True)), F.col(f"`{right_time}`").alias("time"), F.lit(above[0]).alias("side"), F.lit(None).cast(whole).alias("row"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns))).alias("found"), F.col(f"`{right_time}`").alias("at"), F.lit(True).alias("is_right"))
    order = [*keys, "time", "side", "found"] if back else [*keys, F.desc("time"), F.desc("side"), F.desc("found")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = [f"row.c{i}" for i, f in enumerate(left.schema.fields) if "map<" not in f.dataType.simpleString()]
    spread = lines.unionByName(marks).withColumn("spread", F.xxhash64(*hashed))  # splits what shares key and time
    laid = checkpointed(spread.repartitionByRange(n, *order, "spread").sortWithinPartitions(*order, "spread").drop("spread").withColumn("part", F.spark_partition_id()))
    carried = _carried(laid, keys)

    def fill(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                last = carried.get(batch["part"][0].as_py(), batch.slice(0, 0))
                last = pa.ipc.open_stream(last).read_all().to_batches()[0] if isinstance(last, bytes) else last
            rows = pa.Table.from_batches([last, batch]).combine_chunks()
            is_right = rows["is_right"].to_numpy()
            at = np.arange(len(is_right))
            mark = np.maximum.accumulate(np.where(is_right, at, -1))
            mark[mark < np.maximum.accumulate(np.where(_opens(rows, keys), at, 0))] = -1
            asked = np.flatnonzero(~is_right)
            found = pa.array(mark[asked], mask=mark[asked] < 0)
            out = [rows["row"].combine_chunks().take(pa.array(asked)), rows["found"].combine_chunks().take(found), rows["at"].combine_chunks().take(found)]
            yield pa.record_batch(out, names=["row", "found", "at"])
            last = rows.slice(mark[-1], 1).to_batches()[0] if mark[-1] >= 0 else batch.slice(0, 0)

    schema = T.StructType().add("row", whole).add("found", kind).add("at", right.schema[right_time].dataType)
    made = laid.mapInArrow(fill, schema)
    near = F.lit(True)
    if tolerance is not None:
        step = F.expr(f"INTERVAL '{tolerance}'")
        own = F.col(f"row.c{left.columns.index(left_time)}")
        near = F.coalesce(F.col("at") + step >= own if back else F.col("at") - step <= own, F.lit(False))
    mine = [F.col(f"row.c{i}").alias(c) for i, c in enumerate(left.columns)]
    result = made.select(*mine, *(F.when(near, F.col(f"found.c{i}")).alias(names[c]) for i, c in enumerate(columns)))
    return result.unionByName(unknown.select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(names[c]) for c in columns)))


def _opens(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether a row has another key than the one above it; a NaN equals itself."""
    out = np.zeros(rows.num_rows, bool)
    for k in keys:
        column = rows[k].combine_chunks()
        differs = pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        if pa.types.is_floating(column.type):
            nan = pc.is_nan(column).to_numpy(zero_copy_only=False)
            differs &= ~(nan[1:] & nan[:-1])
        out[1:] |= differs
    return out


def _carried(laid: DataFrame, keys: list[str]) -> dict[int, bytes]:
    """For each partition the last right row before it, if it has the key that the
    partition begins with."""

    def fold(batches):
        first = last = mark = None
        opened = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
            opens = np.flatnonzero(_opens(rows, keys))
            opened |= len(opens) > 0
            since = opens[-1] if len(opens) else 0
            some = np.flatnonzero(rows["is_right"].to_numpy())
            some = some[some >= since]
            if len(opens):
                mark = None
            if len(some):
                mark = rows.slice(some[-1], 1)
            first = first if first is not None else batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            blob = lambda t: None if t is None else _stream(t)
            yield pa.record_batch([pa.array([first["part"][0].as_py()], pa.int32()), pa.array([opened]), pa.array([blob(pa.Table.from_batches([first]).select(keys))], pa.binary()), pa.array([blob(pa.Table.from_batches([last]).select(keys))], pa.binary()), pa.array([blob(mark)], pa.binary())], names=["part", "opened", "first", "last", "mark"])

    ends = sorted(laid.mapInArrow(fold, "part int, opened boolean, first binary, last binary, mark binary").collect(), key=lambda r: r.part)
    out, mark, before = {}, None, None
    for row in ends:
        first = pa.ipc.open_stream(row.first).read_all()
        goes_on = before is not None and not _opens(pa.concat_tables([before, first]), keys)[1]
        mark = mark if goes_on else None
        if mark is not None:
            out[row.part] = mark
        if row.opened or row.mark is not None:
            mark = row.mark if row.mark is None else bytes(row.mark)
        before = pa.ipc.open_stream(row.last).read_all()
    return out


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()
