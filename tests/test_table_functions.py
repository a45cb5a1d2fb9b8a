"""Table functions: columns by arguments, nulls, order."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from glotspark.functions.tables import UNITS, table_functions

TEXTS = [(1, "Ab. c d!\n\n é"), (2, ""), (3, None), (4, "x" * 5000 + "\n"), (4, "x" * 5000 + "\n")]


@pytest.fixture
def sql(spark):
    table_functions(spark)
    spark.createDataFrame(TEXTS, "i long, text string").createOrReplaceTempView("texts")
    return spark.sql


@pytest.mark.parametrize("unit", ["line", "word", "sentence"])
def test_cut_text(sql, unit):
    got = sql(f"SELECT i, c.* FROM texts, LATERAL cut_text(text, '{unit}') AS c")
    assert got.columns == ["i", "pos", "start", unit]
    want = Counter()
    for i, text in TEXTS:
        found = [] if text is None else [m for m in re.finditer(UNITS[unit], text)]
        if unit == "line" and text is not None:
            at = [0, *(m.end() for m in re.finditer("\n", text))]
            want += Counter((i, n, a, line) for n, (a, line) in enumerate(zip(at, text.split("\n"), strict=True)))
        else:
            want += Counter((i, n, m.start(), m[0]) for n, m in enumerate(found))
    assert Counter(map(tuple, got.collect())) == want


def test_wrong_arguments(sql):
    with pytest.raises(Exception, match="the unit is one of"):
        sql("SELECT * FROM texts, LATERAL cut_text(text, 'page')").collect()
    with pytest.raises(Exception, match="name of its text"):
        sql("SELECT * FROM transcript(TABLE(texts), text => 'other')").collect()


def test_transcript(spark, sql):
    rows = [(1, 2, "b"), (1, 1, "aaa"), (1, 3, None), (1, 4, "é"), (None, 1, "x"), (2, 1, ""), (2, 2, "z")]
    spark.createDataFrame(rows, "c long, turn long, body string").repartition(3).createOrReplaceTempView("turns")
    got = sql("SELECT * FROM transcript(TABLE(turns) PARTITION BY c ORDER BY turn, text => 'body')")
    assert got.columns == ["c", "turn", "body", "start", "length"]
    assert {(r.c, r.turn): (r.start, r.length) for r in got.collect()} == {(1, 1): (0, 3), (1, 2): (4, 1), (1, 3): (6, 0), (1, 4): (7, 1), (None, 1): (0, 1), (2, 1): (0, 0), (2, 2): (1, 1)}
    spark.createDataFrame([], "c long, turn long, body string").createOrReplaceTempView("turns")
    assert sql("SELECT * FROM transcript(TABLE(turns) PARTITION BY c ORDER BY turn, text => 'body')").count() == 0
