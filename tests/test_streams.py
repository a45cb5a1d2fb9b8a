"""Streams over several batches, with late rows, restarts and killed batches."""

from __future__ import annotations

import datetime as dt
import os
from collections import Counter
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from glotspark.streaming.memory import first_of_each, remembered, state_store
from glotspark.streaming.sink import committed, exactly_once
from glotspark.streaming.windows import session, sliding, tumbling, windowed

DAY = dt.datetime(2024, 1, 1)
EVENTS = "ts timestamp_ntz, user string, v long, window_ string"


def minutes(m):
    return DAY + dt.timedelta(minutes=m)


@pytest.fixture
def feed(spark, tmp_path):
    """put(rows) adds a file; stream(schema) reads one file a batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    count = iter(range(100))

    def put(rows, schema):
        n = next(count)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"made{n}"))
        part = next((tmp_path / f"made{n}").glob("part-*"))
        os.utime(part, (1_700_000_000 + n, 1_700_000_000 + n))
        part.rename(folder / f"f{n:03}.parquet")

    put.stream = lambda schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return put


def test_closed_windows_late_rows_and_a_restart(spark, feed, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    kind, aggs = tumbling("10 minutes"), [F.count("*").alias("n"), F.sum("v").alias("v")]

    def run():
        query = exactly_once(windowed(feed.stream(EVENTS), "ts", kind, aggs, ["user"], "5 minutes"), out, check, once=True)
        query.awaitTermination()
        got = committed(spark, out, "window_start timestamp, window_end timestamp, user string, n long, v long").collect()
        assert len({(r.window_start, r.user) for r in got}) == len(got)
        return {((r.window_start - DAY).seconds // 60, r.user): (r.n, r.v) for r in got}, sum(p.stateOperators[0].numRowsDroppedByWatermark for p in query.recentProgress)

    feed([(minutes(1), "a", 1, ""), (minutes(9), None, 2, ""), (minutes(12), "a", 4, ""), (None, "a", 99, "")], EVENTS)
    feed([(minutes(3), "a", 8, ""), (minutes(16), "a", 16, "")], EVENTS)  # late by less than the delay: counts
    assert run() == ({(0, "a"): (2, 9), (0, None): (1, 2)}, 0)
    feed([(minutes(2), "a", 32, ""), (minutes(14), "a", 64, ""), (minutes(40), "b", 128, "")], EVENTS)  # 2 is past the watermark 11
    got, dropped = run()
    assert got == {(0, "a"): (2, 9), (0, None): (1, 2), (10, "a"): (3, 84)} and dropped == 1


@pytest.mark.parametrize(("kind", "spans"), [
    (tumbling("1 hour"), lambda t: [(t - t % 60, t - t % 60 + 60)]),
    (sliding("1 hour", "20 minutes"), lambda t: [(s, s + 60) for s in range(t - t % 20 - 40, t + 1, 20)]),
])
def test_windows_of_a_batch_and_a_stream_agree(spark, feed, tmp_path, kind, spans):
    rows = [(minutes(7 * i % 600 if i % 2 else i), "ab"[i % 2], i, "") for i in range(150)]
    want = Counter()
    for t, user, v, _ in rows:
        for a, b in spans(int((t - DAY).total_seconds()) // 60):
            want[minutes(a), minutes(b), user] += v
    aggs = [F.sum("v").alias("v")]
    batch = windowed(spark.createDataFrame(rows, EVENTS), "ts", kind, aggs, ["user"])
    assert batch.columns == ["window_start", "window_end", "user", "v"]
    assert {tuple(r)[:3]: r.v for r in batch.collect()} == want
    feed(rows, EVENTS)
    out = str(tmp_path / "out")
    exactly_once(windowed(feed.stream(EVENTS), "ts", kind, aggs, ["user"]), out, str(tmp_path / "check"), once=True).awaitTermination()
    last = max(r[0] for r in rows)
    assert {tuple(r)[:3]: r.v for r in committed(spark, out, batch.schema).collect()} == {k: v for k, v in want.items() if k[1] <= last}


def test_sessions(spark):
    rows = [(minutes(m), "a", 1, "") for m in (0, 5, 14, 30, 31)] + [(minutes(7), "b", 1, "")] + [(minutes(5), "a", 1, "")]
    got = windowed(spark.createDataFrame(rows, EVENTS), "ts", session("10 minutes"), [F.count("*").alias("n")], ["user"]).collect()
    assert {(r.user, (r.window_start - DAY).seconds // 60, (r.window_end - DAY).seconds // 60): r.n for r in got} == {("a", 0, 24): 4, ("a", 30, 41): 2, ("b", 7, 17): 1}
    assert windowed(spark.createDataFrame([], EVENTS), "ts", session("10 minutes"), [F.count("*").alias("n")]).count() == 0


def test_killed_and_replayed_batches_leave_no_duplicates(spark, feed, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    calls = []

    def failing(batch):
        calls.append(1)
        if len(calls) == 2:  # killed after part of the batch was written
            batch.limit(1).write.parquet(f"{out}/batch_1")
            raise RuntimeError("killed")
        return batch

    for n in range(3):
        feed([(n, k) for k in range(5)], "n long, k long")
    with pytest.raises(Exception, match="killed"):
        exactly_once(feed.stream("n long, k long"), out, check, once=True, work=failing).awaitTermination()
    read = lambda: Counter(map(tuple, committed(spark, out, "n long, k long").collect()))
    assert read() == Counter((0, k) for k in range(5))
    exactly_once(feed.stream("n long, k long"), out, check, once=True, work=failing).awaitTermination()
    want = Counter((n, k) for n in range(3) for k in range(5))
    assert read() == want and len(calls) == 4
    os.remove(f"{check}/commits/2")  # killed after the record, before the stream knew: the batch comes again
    (tmp_path / "check/commits/.2.crc").unlink(missing_ok=True)
    exactly_once(feed.stream("n long, k long"), out, check, once=True, work=failing).awaitTermination()
    assert read() == want and len(calls) == 4
    with pytest.raises(Exception, match="another checkpoint"):
        exactly_once(feed.stream("n long, k long"), out, f"{check}2", once=True).awaitTermination()
    assert committed(spark, str(tmp_path / "none"), "n long").count() == 0


@dataclass(frozen=True)
class Logged:
    """Writes down what it is asked for."""

    path: str

    def load(self):
        def run(texts, source, target):
            with open(self.path, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return [f"<{t}>" for t in texts]

        return run


def test_memory_asks_once_for_a_text(spark, feed, tmp_path):
    state_store(spark)
    out, check, asked = str(tmp_path / "out"), str(tmp_path / "check"), tmp_path / "asked"
    schema = "i long, text string, bucket string, translated string"

    def run():
        stream = remembered(feed.stream(schema), Logged(str(asked)), buckets=5)
        assert stream.columns == ["i", "text", "bucket", "translated"]
        exactly_once(stream, out, check, once=True).awaitTermination()

    feed([(i, f"t{i % 7}", "b", "old") for i in range(40)] + [(99, None, None, None), (98, "", "b", None)], schema)
    feed([(i, f"t{i % 9}", "b", "old") for i in range(100, 140)], schema)
    run()
    feed([(i, f"t{i % 11}", "b", "old") for i in range(200, 240)], schema)
    run()  # after a restart
    rows = committed(spark, out, schema).collect()
    assert {r.i: r.translated for r in rows} == {r.i: None if r.text is None else f"<{r.text}>" for r in rows}
    assert len(rows) == 122
    assert Counter(asked.read_text().split("\n")[:-1]) == Counter(["", *(f"t{i}" for i in range(11))])


def test_first_of_each_asks_python_for_no_key_alone(spark, feed, tmp_path):
    state_store(spark)
    out = str(tmp_path / "out")
    rows = [(minutes(i % 50), f"u{i % 1000}", i, "") for i in range(3000)]
    feed(rows, EVENTS)
    feed([(minutes(0), "u7", -1, ""), (minutes(2), "new", 9, ""), (minutes(2), "new", 8, "")], EVENTS)
    query = exactly_once(first_of_each(feed.stream(EVENTS), ["user"], "ts"), out, str(tmp_path / "check"), once=True)
    query.awaitTermination()
    least = {u: min((t, v) for t, w, v, _ in rows if w == u)[1] for u in {r[1] for r in rows}} | {"new": 8}
    got = committed(spark, out, "user string, v long").collect()
    assert len(got) == 1001 and {r.user: r.v for r in got} == least
    assert {s["operatorName"] for p in query.recentProgress for s in p["stateOperators"]} == {"dedupe"}


@pytest.mark.parametrize(("keep", "want"), [(None, {("a", 1), (None, 3), ("b", 70)}), ("10 minutes", {("a", 1), (None, 3), ("b", 70), ("a", 80)})])
def test_first_of_each_and_its_timer(spark, feed, tmp_path, keep, want):
    state_store(spark)
    out = str(tmp_path / "out")
    feed([(minutes(5), "a", 2, ""), (minutes(1), "a", 1, ""), (minutes(3), None, 3, ""), (None, "c", 3, "")], EVENTS)
    feed([(minutes(6), "a", 5, ""), (minutes(70), "b", 70, "")], EVENTS)
    feed([(minutes(80), "a", 80, ""), (minutes(79), "b", 79, "")], EVENTS)
    exactly_once(first_of_each(feed.stream(EVENTS), ["user"], "ts", keep), out, str(tmp_path / "check"), once=True).awaitTermination()
    assert {(r.user, r.v) for r in committed(spark, out, "user string, v long").collect()} == want
