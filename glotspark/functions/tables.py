"""Table functions for SQL: their columns depend on their arguments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from glotspark.functions.text import SENTENCE

UNITS = {"line": r"[^\n]*", "word": r"[^\x20\x09-\x0D]+", "sentence": SENTENCE}


@udtf
class CutText:
    """``cut_text(text, unit)``: a row for each line, word or sentence of a text: pos (from
    0), start (in characters) and the unit itself, in a column of its name. A null text
    has none; an empty one has one empty line. Use it with LATERAL."""

    @staticmethod
    def analyze(text: AnalyzeArgument, unit: AnalyzeArgument) -> AnalyzeResult:
        if not unit.isConstantExpression or unit.value not in UNITS:
            raise ValueError(f"cut_text: the unit is one of {', '.join(UNITS)}")
        return AnalyzeResult(T.StructType().add("pos", T.IntegerType()).add("start", T.IntegerType()).add(unit.value, T.StringType()))

    def __init__(self):
        self.pattern = None

    def eval(self, text: str, unit: str) -> Iterator[tuple]:
        import re

        if text is None:
            return
        if unit == "line":
            start = 0
            for pos, line in enumerate(text.split("\n")):
                yield pos, start, line
                start += len(line) + 1
            return
        self.pattern = self.pattern or re.compile(UNITS[unit])
        for pos, found in enumerate(self.pattern.finditer(text)):
            yield pos, found.start(), found[0]


@udtf
class Transcript:
    """``transcript(TABLE(t) PARTITION BY conversation ORDER BY turn, text => 'name')``: all
    columns of the table, and start and length (in characters) of each row's text in the
    partition's texts joined by line feeds. A null text has length 0."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not text.isConstantExpression or text.value not in rows.dataType.names:
            raise ValueError("transcript: a table, and the name of its text")
        schema = T.StructType(list(rows.dataType.fields))
        for c in ("start", "length"):
            if c in schema.names:
                raise ValueError(f"transcript: the table has a column {c}")
            schema = schema.add(c, T.LongType())
        return AnalyzeResult(schema)

    def __init__(self):
        self.at = 0

    def eval(self, row: Row, text: str) -> Iterator[tuple]:
        length = len(row[text] or "")
        yield (*row, self.at, length)
        self.at += length + 1


def table_functions(spark: SparkSession) -> None:
    """Makes cut_text and transcript known to the session's SQL."""
    spark.udtf.register("cut_text", CutText)
    spark.udtf.register("transcript", Transcript)
