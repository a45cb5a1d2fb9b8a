"""Packed images: byte ranges, pushed filters, broken archives, nulls."""

from __future__ import annotations

import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glotspark.sources.packed import members, packed_images, write_packed


def contents(df):
    return Counter((r.name, r.length, None if r.content is None else bytes(r.content), r.error) for r in df.collect())


ROWS = [(f"a/{i}.png", bytes([i % 256]) * (i * 7 % 300)) for i in range(200)] + [("same", b"1"), ("same", b"2"), ("same", b"2"), (None, b"no name"), ("none", None), (None, None), ("", b"x")]


@pytest.fixture
def packed(spark, tmp_path):
    path = str(tmp_path / "packed")
    write_packed(spark.createDataFrame(ROWS, "name string, content binary").repartition(3), path, archive_bytes=9000)
    return path


def test_round_trip_and_ranges(spark, packed, tmp_path):
    want = Counter((n if n != "" else "-", None if c is None else len(c), c, None) for n, c in ROWS)
    assert contents(packed_images(spark, packed)) == want
    for split in (500, 3333):  # ranges that cut members anywhere
        some = packed_images(spark, packed, splitBytes=split)
        assert contents(some) == want and some.rdd.getNumPartitions() > 10
    write_packed(spark.createDataFrame([("new", b"z")], "name string, content binary"), packed, mode="overwrite")
    assert contents(packed_images(spark, packed)) == Counter([("new", 1, b"z", None)])
    empty = str(tmp_path / "empty")
    write_packed(spark.createDataFrame([], "name string, content binary"), empty)
    assert packed_images(spark, empty).count() == 0
    with pytest.raises(Exception, match="FileNotFound|not there"):
        packed_images(spark, str(tmp_path / "not there")).count()


def test_filters_are_pushed(spark, packed):
    df = packed_images(spark, packed)
    for some, fits in (
        (df.filter("name = 'same'"), lambda n, c: n == "same"),
        (df.filter("name like 'a/1%' and length > 50"), lambda n, c: n and n.startswith("a/1") and c is not None and len(c) > 50),
        (df.filter(F.col("name").isin("a/3.png", "none")), lambda n, c: n in ("a/3.png", "none")),
        (df.filter("length <= 7 and archive is not null"), lambda n, c: c is not None and len(c) <= 7),
    ):
        assert contents(some) == Counter((n if n != "" else "-", None if c is None else len(c), c, None) for n, c in ROWS if fits(n, c))
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert not any("Filter" in line and "Runtime" not in line and ("name#" in line or "length#" in line) for line in plan.split("\n"))
    assert all(r.content is None for r in packed_images(spark, packed, contents="false").collect())


def test_broken_archives_and_members(spark, packed, tmp_path):
    bad = tmp_path / "bad"
    bad.mkdir()
    with zipfile.ZipFile(bad / "one.zip", "w") as z:
        z.writestr("fine", b"abc")
        z.writestr("broken", b"defghi" * 20)
        z.writestr("dir/", b"")
    raw = (bad / "one.zip").read_bytes()
    (bad / "one.zip").write_bytes(raw.replace(b"defghi" * 20, b"defghX" * 20))
    (bad / "two.zip").write_bytes(b"no archive at all")
    (bad / "three.zip").write_bytes(b"")
    (bad / "other.txt").write_bytes(b"not looked at")
    for k, got in enumerate((packed_images(spark, str(bad)), packed_images(spark, str(bad), splitBytes=10), members(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(str(bad))))):
        rows = {(r.archive.rsplit("/", 1)[-1], r.name): r for r in got.collect()}
        assert set(rows) == {("one.zip", "fine"), ("one.zip", "broken"), ("two.zip", None), *([("three.zip", None)] if k < 2 else [])}  # Spark's files have no rows for empty ones
        assert bytes(rows["one.zip", "fine"].content) == b"abc" and rows["one.zip", "broken"].content is None
        assert rows["one.zip", "broken"].error.startswith("broken member") and rows["two.zip", None].error.startswith("no archive")


def test_members_of_a_stream(spark, packed, tmp_path):
    from glotspark.sources.tables import image_stream

    found = members(image_stream(spark, packed, "*.zip"))
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert contents(spark.read.parquet(str(tmp_path / "out"))) == contents(packed_images(spark, packed))
