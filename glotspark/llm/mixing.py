"""Mixing sources to target weights, by Sainte-Lague apportionment.

* Sources stand in code point order, null last. Each has a weight; together
  they share ``share`` times all words. A target stops at ``most`` times its
  source, and the excess is shared again by weight until none is above.
* The mix is made of blocks of ``block`` words. Blocks go to sources, and within
  a source to its shards (documents dealt by a seeded hash of id and text, about
  ``shard_words`` words each), by the highest quotients target / (2k + 1).
* Rows that share all that is carried of them are one row with a count; such a row is
  dealt in chunks of few words, and comes apart again in its shards. So rows
  without ids, rows that share one, and copies of one row fill no shard.
* With ``fine``, a source with a target below ``fine`` blocks has smaller blocks
  of its own, ``fine`` to its target or single words, so that its words come near
  the target however small it is; the others share the remaining blocks.
* In a shard, documents stand in seeded order and their words form one stream of
  blocks. Each block is taken as often as the quota has whole rounds; the rest
  of the quota is drawn by a seeded permutation of the block numbers. So no word
  is taken more than ``most`` times (2).

The driver holds one row for each source: at most ``max_sources``, or an error.
Shards are a row for each ``shard_words`` words, apportioned source by source.

Defined results: a null text has no words; null is a source of its own; repeated
rows are documents of their own; an empty table gives an empty result; other
columns are ignored. Runs agree.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from glotspark.llm.shared import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Rows and words of a chunk of equal rows; words that a row counts for at least where shards are numbered.
CHUNK_ROWS, CHUNK_WORDS, ROW_WORDS = 1000, 4096, 16


def draw(seed: int, id_col: str):
    """A seeded number from 0 to 2**32 - 1 for an id (null: as the text null), mark and chunk."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "mark", F.col("chunk").cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size."""
    out: list[float] = [0.0] * len(sizes)
    open_ = sorted(range(len(sizes)), key=lambda i: sizes[i] / weights[i])
    left, weight = float(total), float(sum(weights))
    for at, i in enumerate(open_):
        if left * weights[i] / weight < most * sizes[i]:
            for j in open_[at:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = float(most * sizes[i])
        left, weight = left - out[i], weight - weights[i]
    return out


def seats(shares: list[float], n: int, caps: list[int]) -> list[int]:
    """n seats by the highest quotients share / (2k + 1), at most caps each;
    of equal quotients the first comes first."""
    n = min(n, sum(caps))
    out = [0] * len(shares)
    if n <= 0 or not any(shares):
        return out
    # the least divisor found that gives n seats at most saves all but the last rounds
    give = lambda by: [min(c, math.floor(x / by + 0.5)) for x, c in zip(shares, caps, strict=True)]
    low, high = 0.0, 4 * max(shares)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(give(mid)) > n else (low, mid)
    out = give(high)
    heap = [(-x / (2 * k + 1), i) for i, (x, k) in enumerate(zip(shares, out, strict=True)) if k < caps[i]]
    heapq.heapify(heap)
    for _ in range(n - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-shares[i] / (2 * out[i] + 1), i))
    return out


def quotas(sizes: list[int], aims: list[float], total: float, most: int, block: int, fine: int | None) -> tuple[list[int], list[int]]:
    """Block size and number of blocks of each source."""
    blocks = [block if fine is None else max(1, min(block, int(a / fine))) for a in aims]
    caps = [most * math.ceil(s / b) for s, b in zip(sizes, blocks, strict=True)]
    out = [c if a >= most * s else min(c, math.floor(a / b + 0.5)) for s, a, b, c in zip(sizes, aims, blocks, caps, strict=True)]
    large = [i for i, b in enumerate(blocks) if b == block]
    left = total - sum(a for a, b in zip(aims, blocks, strict=True) if b < block)
    for i, n in zip(large, seats([aims[i] for i in large], math.floor(left / block + 0.5), [caps[i] for i in large]), strict=True):
        out[i] = n
    return blocks, out


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: int = 2,
    block: int = 16,
    shard_words: int = 1 << 18,
    seed: int = 1,
    max_sources: int = 1_000_000,
    keep: tuple[str, ...] = (),
    size_col: str | None = None,
    fine: int | None = None,
    mark_col: str | None = None,
) -> DataFrame:
    """size_col: a column with the number of words, where it is known; text_col
    isn't read then, and mark_col (a string) should name a digest of the text, so
    that rows that share an id are told apart. Columns to keep must be such that
    rows can be grouped by them. Returns doc_id, source, size, source_size, target, taken, spans (ranges of
    words taken, as first, end, times), shard and the columns named in keep."""
    spark = docs.sparkSession
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("source"),
        (F.col(f"`{size_col}`") if size_col else F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0))).cast("long").alias("size"),
        (F.coalesce(F.col(f"`{mark_col}`"), F.lit("")) if mark_col else F.lit("") if size_col else F.substring(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")), 1, 16)).alias("mark"),
        *(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)),
    )
    sized = checkpointed(sized.groupBy(*sized.columns).agg(F.count("*").alias("n")))
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    if len(per) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = [r["source_size"] for r in per]
    total = sum(sizes)
    aims = targets(sizes, [float(weights[i % len(weights)]) for i in range(len(per))], share * total, most)
    blocks, numbers = quotas(sizes, aims, share * total, most, block, fine)
    plan = spark.createDataFrame(
        [(r["source"], s, a, b, q, max(1, math.ceil(max(s, ROW_WORDS * r["n"]) / shard_words))) for r, s, a, b, q in zip(per, sizes, aims, blocks, numbers, strict=True)],
        T.StructType([T.StructField("source_", docs.schema[source_col].dataType)]).add("source_size", "long").add("target", "double").add("block", "long").add("quota", "long").add("shards", "long"),
    )

    # chunks of equal rows; two steps, so that no array of all chunks of a very frequent row is made
    most_rows = F.greatest(F.lit(1).cast("long"), F.least(F.lit(CHUNK_ROWS), F.floor(F.lit(CHUNK_WORDS) / (F.col("size") + 1)))).cast("long")
    chunks = F.floor((F.col("n") - 1) / most_rows).cast("long")
    stepped = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(chunks / CHUNK_ROWS).cast("long"))).alias("step_"))
    cut = stepped.select("*", F.explode(F.sequence(F.col("step_") * CHUNK_ROWS, F.least(chunks, F.col("step_") * CHUNK_ROWS + CHUNK_ROWS - 1))).alias("chunk"))
    cut = cut.withColumn("copies", F.least(most_rows, F.col("n") - F.col("chunk") * most_rows)).drop("step_", "n")

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(plan, df["source"].eqNullSafe(plan["source_"])).drop("source_").withColumn("shard", F.pmod(draw(seed, "doc_id"), F.col("shards")))

    def share_out(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard").reset_index(drop=True)
        words = [int(x) for x in pdf["words"]]
        block = int(pdf["block"].iloc[0])
        caps = [most * math.ceil(x / block) for x in words]
        got = seats([float(x) for x in words], int(pdf["quota"].iloc[0]), caps)
        out = pdf[["source", "shard"]].copy()
        n = [max(1, math.ceil(x / block)) for x in words]
        out["times"] = [q // k for q, k in zip(got, n, strict=True)]
        out["extra"] = [q % k for q, k in zip(got, n, strict=True)]
        out["blocks"] = n
        out["step"] = [next(a for a in range(max(1, int(k * 0.6180339887)), 2 * k + 2) if math.gcd(a, k) == 1) for k in n]
        out["shift"] = [(seed * 1000003 + 97 * int(s)) % k for s, k in zip(pdf["shard"], n, strict=True)]
        return out

    kind = docs.schema[source_col].dataType.simpleString()
    shards = dealt(cut).groupBy("source", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.first("quota").alias("quota"), F.first("block").alias("block"))
    drawn = shards.groupBy("source").applyInPandas(share_out, f"source {kind}, shard long, times long, extra long, blocks long, step long, shift long").select(F.col("source").alias("source_"), F.col("shard").alias("shard_"), "times", "extra", "blocks", "step", "shift")
    rows = dealt(cut)
    rows = rows.join(drawn, rows["source"].eqNullSafe(drawn["source_"]) & (rows["shard"] == drawn["shard_"]))
    order = W.partitionBy("source", "shard").orderBy(draw(seed + 1, "doc_id"), "doc_id", "mark", "chunk", "size", *(f"keep_{i}" for i in range(len(keep))))
    found = rows.withColumn("last", F.sum(F.col("size") * F.col("copies")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    found = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("before")).withColumn("end", F.col("last") - F.col("before") * F.col("size"))
    a, e, b = F.col("end") - F.col("size"), F.col("end"), F.col("block")

    def span(j):
        times = F.col("times") + F.when(F.pmod(F.col("step") * j + F.col("shift"), F.col("blocks")) < F.col("extra"), 1).otherwise(0)
        return F.struct((F.greatest(a, j * b) - a).alias("first"), (F.least(e, (j + 1) * b) - a).alias("end"), times.alias("times"))

    places = F.when(F.col("size") > 0, F.sequence(F.floor(a / b).cast("long"), F.floor((e - 1) / b).cast("long"))).otherwise(F.array().cast("array<long>"))
    spans = F.filter(F.transform(places, span), lambda s: s["times"] > 0)
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s["end"] - s["first"]) * s["times"])
    return found.withColumn("spans", spans).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "spans", "shard", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)))
