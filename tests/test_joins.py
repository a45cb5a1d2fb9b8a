"""As-of and interval joins against plain loops."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glotspark.operators import intervals as bins
from glotspark.operators.asof import asof_join
from glotspark.operators.intervals import band_join, interval_join

DAY = dt.datetime(2024, 1, 1)


def times(rng, n, most=40):
    return [None if rng.random() < 0.05 else DAY + dt.timedelta(hours=rng.randrange(most)) for _ in range(n)]


def tables(spark, seed, n=300, keys=6):
    rng = random.Random(seed)
    key = lambda: rng.choice([None, *range(keys), 0, 0, 0, 0, 0])  # noqa: E731  one key has half of all rows
    left = [(key(), rng.choice("xy"), t, i % 50) for i, t in enumerate(times(rng, n))]
    right = [(key(), rng.choice("xyz"), t, rng.choice([None, *range(5)]), rng.choice("ab")) for t in times(rng, n)]
    left, right = left + left[:5], right + right[:5]
    return left, right, spark.createDataFrame(left, "k long, s string, time timestamp, part long").repartition(5), spark.createDataFrame(right, "k long, s string, time timestamp, v long, part string").repartition(3)


@pytest.mark.parametrize(("direction", "strict", "hours"), [("backward", False, None), ("backward", True, 5), ("forward", False, 3), ("forward", True, None)])
def test_asof(spark, direction, strict, hours):
    left, right, l, r = tables(spark, 1)
    back = direction == "backward"
    want = Counter()
    order = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    for row in left:
        k, s, t, p = row
        fit = [x for x in right if None not in (k, s, t, x[0], x[2]) and x[:2] == (k, s) and ((x[2] < t or (x[2] == t and not strict)) if back else (x[2] > t or (x[2] == t and not strict)))]
        best = (max if back else min)(fit, key=lambda x: (x[2], order(x[3:])), default=None)
        if best and hours is not None and abs(best[2] - t) > dt.timedelta(hours=hours):
            best = None
        want[(*row, *(best[3:] if best else (None, None)))] += 1
    got = asof_join(l, r, ["k", "s"], "time", "time", ["v", "part"], direction, strict, f"{hours} hours" if hours else None)
    assert got.columns == ["k", "s", "time", "part", "v", "right_part"]
    assert Counter(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin" not in plan


def test_asof_one_key_over_all_partitions_and_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        left = [(1, i, f"l{i}") for i in range(1, 400, 2)] + [(2, 5, "other")]
        right = [(1, i, i * 10) for i in (0, 2, 250)] + [(2, 9, 1)]
        got = {r.n: r.v for r in asof_join(spark.createDataFrame(left, "k int, at int, n string"), spark.createDataFrame(right, "k int, t int, v int"), ["k"], "at", "t", ["v"]).collect()}
        assert got == {f"l{i}": 0 if i < 2 else 20 if i < 250 else 2500 for i in range(1, 400, 2)} | {"other": None}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_asof_splits_a_frequent_key(spark):
    n = 20_000
    left = spark.range(n).select(F.lit(7).alias("k"), F.col("id").alias("t"), F.lit("x").alias("p"))
    got = asof_join(left, left.filter("t % 1000 = 0").withColumnRenamed("t", "u"), ["k"], "t", "u", ["u"])
    assert got.filter("u = t - t % 1000").count() == n
    sizes = [len(x) for x in got.rdd.glom().collect()]
    assert max(sizes) < 0.5 * n


def test_asof_empty_and_complex_columns(spark):
    _, _, l, r = tables(spark, 2, 20)
    none = asof_join(l, r.limit(0), ["k"], "time", "time", ["v"])
    assert none.count() == 25 and none.filter("v is not null").count() == 0
    assert asof_join(l.limit(0), r, ["k"], "time", "time", ["v"]).count() == 0
    wide = l.withColumn("m", F.create_map(F.lit("a"), F.lit(1))).withColumn("key_0", F.array(F.lit(1)))
    assert asof_join(wide, r, ["k"], "time", "time", ["v"]).filter("m['a'] = 1 and key_0[0] = 1").count() == 25
    with pytest.raises(ValueError, match="direction"):
        asof_join(l, r, ["k"], "time", "time", direction="near")


def intervals(rng, n, most):
    out = []
    for i in range(n):
        a = rng.choice([rng.uniform(0, most), rng.randrange(int(most)), 0.0])
        b = a + rng.choice([0, 0, rng.random(), rng.uniform(0, 5), rng.uniform(0, most * 20), -1])
        out.append((rng.choice([None, 1, 2, 2, 2]), None if rng.random() < 0.05 else float(a), None if rng.random() < 0.05 else float(b), i))
    return [*out, (2, -math.inf, 3.0, n), (2, 5.0, math.inf, n + 1), (1, -1e300, 1e300, n + 2), out[0], out[0]]


def expected(left, right, keyed):
    ok = lambda x: x[1] is not None and x[2] is not None and x[1] <= x[2] and (x[0] is not None or not keyed)
    return Counter((*a, *(b if not keyed else b[1:])) for a in left for b in right if ok(a) and ok(b) and a[1] <= b[2] and b[1] <= a[2] and (not keyed or a[0] == b[0]))


@pytest.mark.parametrize(("seed", "keyed", "bin"), [(1, True, None), (2, False, None), (3, True, 1e-3), (4, False, 1e6)])
def test_interval_join(spark, seed, keyed, bin):
    rng = random.Random(seed)
    left, right = intervals(rng, 80, 50), intervals(rng, 70, 50)
    l, r = (spark.createDataFrame(x, "k int, lo double, hi double, level int").repartition(3) for x in (left, right))
    got = interval_join(l, r, ("lo", "hi"), ("lo", "hi"), ["k"] if keyed else None, bin)
    assert got.columns == ["k", "lo", "hi", "level", *([] if keyed else ["right_k"]), "right_lo", "right_hi", "right_level"]
    assert Counter(map(tuple, got.collect())) == expected(left, right, keyed)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_intervals_of_times_and_large_numbers(spark):
    rng = random.Random(9)
    left = [(DAY + dt.timedelta(minutes=rng.randrange(9000)), i) for i in range(60)]
    right = [(t, t + dt.timedelta(minutes=rng.choice([0, 5, 900, 90_000])), i) for i, (t, _) in enumerate((DAY + dt.timedelta(minutes=rng.randrange(9000)), 0) for _ in range(60))]
    got = interval_join(spark.createDataFrame(left, "at timestamp_ntz, i int"), spark.createDataFrame(right, "a timestamp_ntz, b timestamp_ntz, j int"), ("at", "at"), ("a", "b"))
    assert Counter((r.i, r.j) for r in got.collect()) == Counter((i, j) for t, i in left for a, b, j in right if a <= t <= b)
    big = 2**62
    ends = spark.createDataFrame([(big + i,) for i in range(5)], "x long")
    assert interval_join(ends, ends, ("x", "x"), ("x", "x")).filter("x = right_x").count() == interval_join(ends, ends, ("x", "x"), ("x", "x")).count() == 5
    assert interval_join(ends.limit(0), ends, ("x", "x"), ("x", "x")).count() == 0
    with pytest.raises(TypeError, match="no bins"):
        interval_join(ends.selectExpr("cast(x as string) x"), ends, ("x", "x"), ("x", "x"))


def test_wide_intervals_cost_two_bins(spark):
    wide = spark.range(100).selectExpr("cast(id as double) lo", "id + 1e12 hi")
    points = spark.range(1000).selectExpr("cast(id as double) x")
    assert interval_join(points, wide, ("x", "x"), ("lo", "hi"), None, 1.0).count() == sum(min(x, 99) + 1 for x in range(1000))


@pytest.mark.parametrize("keyed", [True, False])
def test_band_join(spark, keyed):
    rng = random.Random(5)
    left, right = ([(rng.choice([None, 1, 2]), rng.choice([None, round(rng.uniform(-50, 50), 1)])) for _ in range(150)] for _ in range(2))
    got = band_join(spark.createDataFrame(left, "k int, low double"), spark.createDataFrame(right, "k int, x double"), "low", "x", 0.5, 2.0, ["k"] if keyed else None)
    assert got.columns == (["k", "low", "x"] if keyed else ["k", "low", "right_k", "x"])
    want = Counter((*a, *(b[1:] if keyed else b)) for a in left for b in right if a[1] is not None and b[1] is not None and a[1] - 0.5 <= b[1] <= a[1] + 2 and (not keyed or (a[0] is not None and a[0] == b[0])))
    assert Counter(map(tuple, got.collect())) == want


@pytest.mark.parametrize(("seed", "keyed"), [(11, True), (12, False)])
def test_intervals_in_blocks(spark, monkeypatch, seed, keyed):
    monkeypatch.setattr(bins, "SIDE", 5)
    monkeypatch.setattr(bins, "PAIRS", 50)
    rng = random.Random(seed)
    left, right = intervals(rng, 80, 50), intervals(rng, 70, 50)
    l, r = (spark.createDataFrame(x, "k int, lo double, hi double, level int").repartition(3) for x in (left, right))
    got = interval_join(l, r, ("lo", "hi"), ("lo", "hi"), ["k"] if keyed else None)
    assert Counter(map(tuple, got.collect())) == expected(left, right, keyed)


def test_a_full_bin_makes_no_task_grow(spark):
    left, right = (spark.range(n).selectExpr("id", "id % 7 / 10 x").repartition(3) for n in (20_000, 1500))
    got = band_join(left, right, "x", "x", 1.0, 1.0)
    sizes = [r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(sizes) == 20_000 * 1500 and max(sizes) < 0.5 * sum(sizes)


def test_what_is_dealt_grows_with_the_rows_not_with_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(bins, "SIDE", 16)
    monkeypatch.setattr(bins, "PAIRS", 256)
    frames, deal = [], type(spark.range(1)).repartition
    monkeypatch.setattr(type(spark.range(1)), "repartition", lambda df, *a: frames.append(deal(df, *a)) or frames[-1])

    def dealt(n):
        frames.clear()
        points, ranges = (spark.range(n).selectExpr(f"cast(id * {4000 // n} as double) x", "id % 3 k") for _ in range(2))
        got = interval_join(points, ranges.selectExpr("x - 800 lo", "x + 800 hi", "k"), ("x", "x"), ("lo", "hi"))
        assert got.count() == sum(abs(a - b) * 5 <= n for a in range(n) for b in range(n))
        return sum(df.count() for df in frames)

    small, large = dealt(250), dealt(1000)
    assert 0 < small < large < 5 * small


def test_pairs_in_blocks_come_in_runs(spark, tmp_path):
    points = spark.range(4000).selectExpr("cast(id * 7919 % 4000 as double) x", "hash(id) a")
    ranges = spark.range(4000).selectExpr("cast(id * 6007 % 4000 as double) lo", "hash(id, 1) b").withColumn("hi", F.col("lo") + 1500)
    interval_join(points, ranges, ("x", "x"), ("lo", "hi")).select("a", "b", "x", "lo", "hi").write.parquet(str(tmp_path / "out"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n == sum(min(lo + 1500, 3999) - lo + 1 for lo in range(4000))
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.6 * n
