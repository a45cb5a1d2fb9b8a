"""Grouping sets, frames by time, top k, set operations and membership against plain loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glotspark.operators.groups import distinct_counts, moving, top_per_group
from glotspark.operators.sets import counted, except_counted, expanded, intersect_counted, members_of

KINDS = "a string, b int, v long, n long, rank int"


def rows(seed, n=400):
    rng = random.Random(seed)
    out = [(rng.choice([None, "x", "y", "x", "x"]), rng.choice([None, 1, 2]), rng.choice([None, rng.randrange(-40_000, 80_000), rng.randrange(5)]), rng.randrange(3), 7) for _ in range(n)]
    return out + out[:9]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_counts(spark):
    some = rows(1)
    df = spark.createDataFrame(some, KINDS).repartition(4)
    sets = [["a", "b"], ["a"], ["b"], []]
    got = distinct_counts(df, sets, {"vs": "v", "ns": "n"})
    assert got.columns == ["a", "b", "grouping_id", "n_rows", "vs", "ns"]
    want = set()
    for s, i in zip(sets, (0, 1, 2, 3), strict=True):
        groups = defaultdict(list)
        for r in some:
            groups[r[0] if "a" in s else None, r[1] if "b" in s else None].append(r)
        want |= {(a, b, i, len(g), len({r[2] for r in g} - {None}), len({r[3] for r in g})) for (a, b), g in groups.items()}
    assert {tuple(r) for r in got.collect()} == want
    assert distinct_counts(df.limit(0), sets[:3], {"vs": "v"}).count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        distinct_counts(df, sets, {"x": "a"})


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_moving(spark, width):
    rng = random.Random(width)
    some = [(rng.choice([None, "x", "x", "x", "y"]), i, rng.choice([None, rng.randrange(-300, 300)]), rng.randrange(9), 1) for i in range(200)]
    some += some[:5]
    got = moving(spark.createDataFrame(some, "k string, bin int, at long, own long, rank int").repartition(3), ["k"], "at", width, lambda w: [F.sum("own").over(w).alias("total"), F.max("own").over(w).alias("most"), F.count("*").over(w).alias("c")])
    want = Counter()
    for r in some:
        seen = [x[3] for x in some if r[2] is not None and x[2] is not None and x[0] == r[0] and r[2] - width <= x[2] <= r[2]]
        want[(*r, sum(seen) if seen else None, max(seen, default=None), len(seen) or None)] += 1
    assert got.columns == ["k", "bin", "at", "own", "rank", "total", "most", "c"]
    assert Counter(map(tuple, got.collect())) == want
    assert moving(spark.createDataFrame([], KINDS), ["a"], "v", width, lambda w: [F.count("*").over(w).alias("c")]).count() == 0


def test_moving_spreads_a_frequent_key(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    got = moving(df, ["k"], "t", 10, lambda w: [F.count("*").over(w).alias("c")])
    assert got.filter("c = least(t + 1, 11)").count() == 5000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert max(len(x) for x in moving(df, ["k"], "t", 10, lambda w: [F.count("*").over(w).alias("c")]).rdd.glom().collect()) < 2000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_top_per_group(spark):
    some = rows(2)
    df = spark.createDataFrame(some, KINDS).repartition(4)
    low = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    groups = defaultdict(list)
    for r in some:
        groups[r[0]].append(r)
    got = top_per_group(df, ["a"], [F.desc("n")], 3)
    want = Counter((*r, i) for g in groups.values() for i, r in enumerate(sorted(g, key=lambda r: (-r[3], low(r)))[:3], 1))
    assert got.columns == [*df.columns, "rank_"] and Counter(map(tuple, got.collect())) == want
    tied = top_per_group(df, ["a"], [F.desc("n")], 3, ties=True)
    third = {a: sorted((r[3] for r in g), reverse=True)[:3][-1] for a, g in groups.items()}
    assert Counter(r[:5] for r in map(tuple, tied.collect())) == Counter(r for r in some if r[3] >= third[r[0]])
    assert "WindowGroupLimit" in plan(got) and "WindowGroupLimit" in plan(tied)
    assert top_per_group(df.limit(0), ["a"], [F.desc("n")], 3).count() == 0


def test_counted_sets(spark):
    left, right = ([r[:2] + (r[3],) for r in rows(s, 120)] for s in (3, 4))
    l, r = (spark.createDataFrame(x, "a string, n int, left_n long") for x in (left, right))
    assert Counter({tuple(x[:3]): x[3] for x in counted(l).collect()}) == Counter(left)
    for ours, spark_own, want in ((intersect_counted(l, r), l.intersectAll(r), Counter(left) & Counter(right)), (except_counted(l, r), l.exceptAll(r), Counter(left) - Counter(right))):
        assert ours.columns == ["a", "n", "left_n", "n_"] and {tuple(x[:3]): x[3] for x in ours.collect()} == want
        assert Counter(map(tuple, expanded(ours).collect())) == want == Counter(map(tuple, spark_own.collect()))
        assert "Join" not in plan(ours)
    assert intersect_counted(l, r.limit(0)).count() == 0 and except_counted(l.limit(0), r).count() == 0


def test_membership(spark):
    rng = random.Random(6)
    text = lambda: rng.choice([None, "", "é" * 3000, *(f"w{i}" for i in range(30))])
    left = [(text(), rng.choice([None, 1, 2]), i, "m") for i in range(150)]
    right = [(text(), rng.choice([None, 1, 2, 3]), "z") for _ in range(40)]
    l, r = spark.createDataFrame(left + left[:4], "t string, k int, hash long, maybe string").repartition(3), spark.createDataFrame(right, "t string, k int, extra string")
    for on, cut in ((["t"], 1), (["t", "k"], 2)):
        there = {x[:cut] for x in right if None not in x[:cut]}
        for absent in (False, True):
            got = members_of(l, r, on, absent)
            assert got.columns == l.columns
            assert Counter(map(tuple, got.collect())) == Counter(x for x in left + left[:4] if (x[:cut] in there) != absent)
    assert members_of(l, r.limit(0), ["t"]).count() == 0 and members_of(l, r.limit(0), ["t"], True).count() == 154
    assert members_of(l.limit(0), r, ["t"], True).count() == 0
