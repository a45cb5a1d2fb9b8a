"""Text to text in another language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotspark.functions.batches import prepare
from glotspark.functions.text import fresh, lines, pieces
from glotspark.operators.backends import Translator

GLOSSARY_ROWS = 10_000
REPEATS = 1000


def glossary_column(text: Column, glossary: dict[str, str]) -> Column:
    """Word by word by a small glossary, as an expression (no Python): a test
    double for a model. Words are what stands between single spaces."""
    if len(glossary) > GLOSSARY_ROWS:
        raise ValueError(f"more than {GLOSSARY_ROWS} words: use translate_words, which joins")
    pairs = [F.lit(x) for pair in glossary.items() for x in pair]
    known = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.array_join(F.transform(F.split(text, " ", -1), lambda w: F.coalesce(F.element_at(known, w) if pairs else w, w)), " ")


def content_key(*columns: Column) -> Column:
    """SHA-256 of the columns' values: the same in every attempt of a task, where a
    running number of rows behind a shuffle isn't. Equal rows share it."""
    exact = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.unhex(F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), exact), 256))


def _repeated(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as the column times says, which goes. Two steps, so that no
    array of all the numbers of a very frequent row is made."""
    step, nth = fresh("step", *df.columns), fresh("nth", *df.columns)
    many = F.col(times) - F.col(step) * REPEATS
    stepped = df.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / REPEATS).cast("long"))).alias(step))
    return stepped.select("*", F.explode(F.sequence(F.lit(1), F.least(many, F.lit(REPEATS)).cast("int"))).alias(nth)).drop(step, nth, times)


def translate_words(df: DataFrame, glossary: DataFrame, text_col: str = "text", out: str = "translated") -> DataFrame:
    """The same by a join with a glossary of any size (columns src, tgt; each src
    once). Every row keeps its own words; equal rows are put together once and
    repeated. Nothing hangs on the order of rows, so lost tasks may run again."""
    word, pos, row, of, times = (fresh(c, *df.columns, out) for c in ("word", "pos", "row", "of", "times"))
    others = [c for c in df.columns if c != out]
    rows = df.select(F.struct(*others).alias(row), content_key(*(F.col(f"`{c}`") for c in dict.fromkeys([*others, text_col]))).alias(of), F.col(text_col).alias(word))
    cut = rows.select(row, of, F.posexplode_outer(F.split(word, " ", -1)).alias(pos, word))
    cut = cut.withColumn(row, F.when(F.coalesce(pos, F.lit(0)) == 0, F.col(row)))  # a row goes with its first word alone
    met = cut.join(glossary.select(F.col("src").alias("s"), F.col("tgt").alias("t")), F.col(word) == F.col("s"), "left")
    placed = F.array_sort(F.collect_set(F.struct(F.col(pos).alias("p"), F.coalesce("t", word).alias("v"))))
    joined = F.when(F.count(word) > 0, F.array_join(F.transform(placed, lambda x: x["v"]), " "))
    whole = met.groupBy(of).agg(F.first(row, ignorenulls=True).alias(row), joined.alias(out), F.count(row).alias(times))
    return _repeated(whole.select(row, out, times), times).select(f"{row}.*", out)


def translator_udf(backend: Translator):
    """A Pandas UDF of text, source and target language. Declared without
    determinism, so that a result used twice isn't computed twice; put filters on
    source columns before it."""

    @F.pandas_udf(T.StringType())
    def translated(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = backend.load()
        for text, source, target in batches:
            out = pd.Series([None] * len(text), dtype=object)
            ready = text.notna() & source.notna() & target.notna()
            for (src, tgt), at in text[ready].groupby([source[ready], target[ready]], sort=False).groups.items():
                out.loc[at] = run(text.loc[at].tolist(), src, tgt)
            yield out

    return translated.asNondeterministic()


def translate(df: DataFrame, backend: Translator, text_col: str = "text", source: Column | str = "en", target: Column | str = "ko", out: str = "translated") -> DataFrame:
    """Adds the translation of each row's text; null for a null text. Texts go to
    Python in batches of a few MB (see ``prepare``)."""
    prepare(df.sparkSession)
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.withColumn(out, translator_udf(backend)(F.col(text_col), as_column(source), as_column(target)))


def translate_distinct(df: DataFrame, backend: Translator, text_col: str = "text", source: str = "en", target: str = "ko", out: str = "translated") -> DataFrame:
    """The same, but each distinct text goes through the model once.

    A text that a third of all rows share is one row before the model; the join
    back leaves hot texts to adaptive skew handling."""
    text, made = (fresh(c, *df.columns) for c in ("once", "made"))
    once = df.select(F.col(text_col).alias(text)).filter(F.col(text).isNotNull()).distinct()
    done = translate(once, backend, text, source, target, made)
    return df.join(done, df[text_col] == done[text], "left").select(*(df[c] for c in df.columns if c != out), done[made].alias(out))


def translate_documents(docs: DataFrame, backend: Translator, keys: list[str], text_col: str = "text", source: str = "en", target: str = "ko", out: str = "translated", longest: int = 1000) -> DataFrame:
    """Line by line, put together in order; keys and the translation. Each row is
    a document of its own, also where rows share their keys; rows that share keys
    and text are put together once and repeated. Nothing hangs on the order of rows,
    so lost tasks may run again.

    A line of more than ``longest`` characters is cut after sentences (or anywhere
    where a sentence is longer); white space around such a piece stays outside the
    model. Each distinct line or piece goes through the model once."""
    line = F.col("line")
    # a document's key, and its keys with its first line alone
    rows = docs.select(F.struct(*(F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys))).alias("row"), content_key(*(F.col(f"`{c}`") for c in (*keys, text_col))).alias("of"), F.col(f"`{text_col}`").alias("text"))
    cut = lines(rows).withColumn("row", F.when(F.col("pos") == 0, F.col("row")))
    cut = cut.withColumn("long", F.coalesce(F.length(line) > longest, F.lit(False)))
    parts = cut.select("row", "of", "pos", "long", F.posexplode_outer(F.when(F.col("long"), pieces(line, longest)).otherwise(F.array(line))).alias("nth", "part"))
    outside = lambda side: F.when(F.col("long"), F.regexp_extract("part", side, 0)).otherwise("")
    parts = parts.withColumn("row", F.when(F.col("nth") == 0, F.col("row"))).withColumns({"before": outside(r"^\s*"), "core": F.when(F.col("long"), F.regexp_replace("part", r"^\s+|\s+$", "")).otherwise(F.col("part"))})
    parts = parts.withColumn("after", F.when(F.col("core") == "", "").otherwise(outside(r"\s*$")))
    done = translate_distinct(parts.drop("part"), backend, "core", source, target, "made")
    made = F.when(F.col("long") & (F.col("core") == ""), F.col("core")).otherwise(F.col("made"))
    value = F.concat(F.when((F.col("nth") == 0) & (F.col("pos") > 0), "\n").otherwise(""), "before", made, "after")
    placed = F.array_sort(F.collect_set(F.struct("pos", "nth", value.alias("v"))))
    text = F.when(F.count("core") > 0, F.array_join(F.transform(placed, lambda x: x["v"]), ""))
    whole = done.groupBy("of").agg(F.first("row", ignorenulls=True).alias("row"), text.alias("text"), F.count("row").alias("times"))
    return _repeated(whole.select("row", "text", "times"), "times").select(*(F.col(f"row.k{i}").alias(k) for i, k in enumerate(keys)), F.col("text").alias(out))


def pivot(df: DataFrame, backend: Translator, source: Column | str, target: Column | str, text_col: str = "text", middle: str = "en") -> DataFrame:
    """By way of a middle language, which stays as a column of that name. The
    steps aren't fused: as one stage the first would run twice, once for the
    column and once for the second step, and the model costs far more than a
    pass through Arrow."""
    first = translate(df, backend, text_col, source, middle, middle)
    return translate(first, backend, middle, middle, target, "translated")
