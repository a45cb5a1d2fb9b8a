"""Cutting texts for a translator and putting them together again."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE = r"(?s)[^.!?]*[.!?]+|[^.!?]+"

#: Ends of what a long text is cut into, best first.
CUTS = tuple(re.compile(p) for p in (r"\n+", r"[.!?…]+[\"'”’)\]]*\s+|[。！？]+", r"\s+"))


def fresh(name: str, *taken: str) -> str:
    """A column name that none of the taken ones equals, whatever their case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def lines(df: DataFrame, text_col: str = "text", out: str = "line") -> DataFrame:
    """One row a line with its position; a null text gives one null line. A column
    of df named pos, or as the lines, is replaced."""
    cut = F.split(F.col(text_col), "\n", -1)
    other = [c for c in df.columns if c.lower() not in (text_col.lower(), "pos", out.lower())]
    return df.select(*other, F.posexplode_outer(cut).alias("pos", out)).withColumn("pos", F.coalesce("pos", F.lit(0)))


def rejoined(df: DataFrame, keys: list[str], value: str, out: str = "text") -> DataFrame:
    """Lines put together in the order of pos; null if all of a text's are. keys
    tell texts apart: lines of rows that share them become one text."""
    placed = F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v"))))
    return df.groupBy(*keys).agg(F.when(F.count(value) > 0, F.array_join(F.transform(placed, lambda x: x["v"]), "\n")).alias(out))


def pieces(text: Column, longest: int = 512) -> Column:
    """Sentences of at most ``longest`` characters whose concatenation is the
    text: models take bounded inputs, and no separator may be lost."""
    sentences = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(f"(?s).{{1,{longest}}}"), F.lit(0))))


def halves(text: str) -> tuple[str, str]:
    """A text of two characters or more, cut near its middle: after a line feed,
    sentence or word if one ends in the middle half, else anywhere."""
    n = len(text)
    for cut in CUTS:
        ends = [m.end() for m in cut.finditer(text, n // 4, n - n // 4) if 0 < m.end() < n]
        if ends:
            at = min(ends, key=lambda x: abs(2 * x - n))
            return text[:at], text[at:]
    return text[: n // 2], text[n // 2 :]


def bounded(text: str, size: Callable[[str], int], longest: int) -> list[str]:
    """Pieces whose concatenation is the text, each of a size (a tokenizer's,
    say) of at most ``longest``; an error where a character alone is larger."""
    if size(text) <= longest:
        return [text]
    if len(text) < 2:
        raise ValueError(f"{text!r} has a size of {size(text)}, more than {longest}")
    return [piece for half in halves(text) for piece in bounded(half, size, longest)]


def html_text(html: Column) -> Column:
    """The readable text of a page: no scripts, styles, comments or tags; block
    ends become line feeds, the five basic entities characters."""
    for pattern, by in (
        (r"(?is)<(script|style|nav|footer)\b.*?</(script|style|nav|footer)>|<!--.*?-->", " "),
        (r"(?i)<br\s*/?>|</(p|div|li|h1|h2|h3|tr|title)>", "\n"),
        (r"(?s)<[^>]*>", " "),
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"),
        (r"[ \t\r]+", " "),
        (r" ?\n ?", "\n"),
        (r"\n+", "\n"),
    ):
        html = F.regexp_replace(html, pattern, by)
    return F.trim(F.regexp_replace(html, r"^[\n ]+|[\n ]+$", ""))
