"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item, or the whole item
where it has fewer (but not none). With grams of k words and a minimum over w of
them, k + w - 1 = t, any t words that two texts share hold a gram that both
select, since the minimum over those w grams depends on them alone. Items with
fewer than ``window`` words get a smaller t, their own length, so the guarantee
holds for each length that occurs (at most ``window`` of them).

* One pass over the documents keeps the selected grams that pass a Bloom filter
  of the benchmark's (16 bits a gram, 2**28 bits at most: beyond that it passes
  more, and the join still decides). Texts are not shuffled.
* Grams that passed are joined with the benchmark's by key, each with the words
  around it; the hit is extended word by word to both sides, which also verifies
  the gram. A run of t words or more is a hit, and runs of a document are merged.
* Items that share a passage share a row in that join; their ids are looked up
  only for passages that were found.

Words: runs of digits, letters a-z and whatever is beyond ASCII, A-Z lower-cased.
A word of more than 64 bytes is compared by its 256-bit digest.

Defined results: a null or wordless text has no words and no hits; rows that share a
doc_id are documents of their own; items that share an id are one item; an item
without an id hits words, but isn't listed; empty tables give an empty result, or
no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glotspark.llm import shared
from glotspark.llm.kernels import BYTE_BASE, BYTE_CODES, U64, WORD_BASE, in_slabs, mix, prefix_hash, range_hash, runs, text_bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
SLAB_BYTES = 2 << 20
LONG_WORD = 64
BITS_A_GRAM, MOST_BITS, PROBES = 16, 28, 4
GRAMS = "row long, doc_id long, n_words long, key long, size int, at long, before array<string>, after array<string>"


class Passages:
    """The words of a slab of texts. first: per text the number of its first word."""

    def __init__(self, column: pa.ChunkedArray):
        data, offs = text_bytes(column)
        self.data = LOWER[data]
        self.start, self.end, self.first = runs(IS_WORD[self.data], offs)
        self.hash = range_hash(prefix_hash(BYTE_CODES[self.data], BYTE_BASE), self.start, self.end, BYTE_BASE)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def selected(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Winnowing for shared runs of ``size`` words: the last least gram of each
        window, as word numbers and keys."""
        k, w = gram_and_window(size)
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.arange(n - k + 1)
        grams = range_hash(prefix_hash(self.hash, WORD_BASE), at, at + k, WORD_BASE) ^ mix(np.array([size], U64))
        first = np.flatnonzero(self.row[: n - size + 1] == self.row[size - 1 :])
        chosen = np.zeros(n - k + 1, bool)
        for a in range(0, len(first), 1 << 18):
            some = first[a : a + (1 << 18)]
            window = grams[some[:, None] + np.arange(w - 1, -1, -1)]
            chosen[some + w - 1 - np.argmin(window, 1)] = True
        at = np.flatnonzero(chosen)
        return at, grams[at]

    def word(self, i: int) -> str:
        text = self.data[self.start[i] : self.end[i]].tobytes()
        return text.decode("utf-8", "replace") if len(text) <= LONG_WORD else "#" + hashlib.sha256(text).hexdigest()

    def around(self, at: np.ndarray, size: int) -> tuple[list, list]:
        """The words before each gram, nearest first, and those from its first on."""
        k, _ = gram_and_window(size)
        before, after = [], []
        for i in at.tolist():
            low, high = int(self.first[self.row[i]]), int(self.first[self.row[i] + 1])
            before.append([self.word(j) for j in range(i - 1, max(low, i - size + k) - 1, -1)])
            after.append([self.word(j) for j in range(i, min(high, i + size))])
        return before, after


def gram_and_window(size: int) -> tuple[int, int]:
    k = (size + 1) // 2
    return k, size - k + 1


def _bits(keys: np.ndarray, width: int) -> np.ndarray:
    """The bits of a filter of 2**width that stand for each key: (keys, PROBES)."""
    a, b = mix(keys), mix(keys ^ U64(0x9E3779B97F4A7C15)) | U64(1)
    return (a[:, None] + b[:, None] * np.arange(PROBES, dtype=U64)) >> U64(64 - width)


def _grams(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], width: int, sieve, whole_only: int = 0) -> DataFrame:
    """A row for each text (key null), and one for each selected gram that passes
    the filter. whole_only: texts of fewer words than this give grams of their own
    length only, the others of this size only."""

    def scan(batches):
        at_row = TaskContext.get().partitionId() << 40
        passing = None if sieve is None else sieve.value
        for table in in_slabs(batches, "text", SLAB_BYTES):
            texts = Passages(table["text"])
            ids, rows = table["doc_id"].combine_chunks(), at_row + np.arange(table.num_rows)
            at_row += table.num_rows
            n = len(rows)
            none = pa.nulls(n, pa.list_(pa.string()))
            yield pa.record_batch([pa.array(rows), ids, pa.array(texts.counts), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), none, none], names=NAMES)
            for size in sizes:
                at, keys = texts.selected(size)
                if whole_only:
                    own = texts.counts[texts.row[at]]
                    fit = own >= size if size == whole_only else own == size
                    at, keys = at[fit], keys[fit]
                if passing is not None and len(at):
                    probe = _bits(keys, width).astype(np.int64)
                    fit = ((passing[probe >> 3] >> (probe & 7).astype(np.uint8)) & 1).all(1)
                    at, keys = at[fit], keys[fit]
                for a in range(0, len(at), 4096):
                    some = at[a : a + 4096]
                    before, after = texts.around(some, size)
                    row = texts.row[some]
                    parts = [pa.array(rows[row]), ids.take(pa.array(row)), pa.nulls(len(some), pa.int64()), pa.array(keys[a : a + 4096].view(np.int64)), pa.array(np.full(len(some), size, np.int32)), pa.array(some - texts.first[row]), pa.array(before, pa.list_(pa.string())), pa.array(after, pa.list_(pa.string()))]
                    yield pa.record_batch(parts, names=NAMES)

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(scan, GRAMS)


NAMES = [part.split()[0] for part in GRAMS.split(", ")]


def _sieve(grams: DataFrame):
    """A Bloom filter of the keys. Tasks set bits, words of 64 bits are or-ed by a
    grouping, and the driver gets 2**MOST_BITS bits at most."""
    keys = grams.select("key").distinct()
    n = keys.count()
    width = min(MOST_BITS, max(16, int(n * BITS_A_GRAM).bit_length()))

    def mark(batches):
        for batch in batches:
            bits = _bits(batch["key"].to_numpy().view(U64), width).ravel()
            yield pa.record_batch([pa.array((bits >> U64(6)).astype(np.int64)), pa.array((U64(1) << (bits & U64(63))).view(np.int64))], names=["word", "bits"])

    words = keys.mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(1 << (width - 6), np.int64)
    whole[words["word"].to_numpy()] = words["bits"].to_numpy()
    return n, width, grams.sparkSession.sparkContext.broadcast(whole.view(np.uint8))


def _same(a: str, b: str):
    """How many leading words two arrays share; arrays pad each other with nulls."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10) -> DataFrame:
    """For each document: doc_id, n_words, n_hit (words inside an occurrence of a
    benchmark window), spans (those words as maximal runs of word numbers) and
    items (ids of the items found, as strings, sorted). See the module for the
    method and edge cases."""
    if window < 1:
        raise ValueError("a window has one word at least")
    spark = docs.sparkSession
    shared.prepare(spark)
    found = _grams(benchmark, item_col, item_text_col, list(range(1, window + 1)), 0, None, window).filter("key is not null")
    passage = F.sha2(F.concat_ws(" ", F.col("size").cast("string"), F.concat_ws(" ", "before"), F.lit("|"), F.concat_ws(" ", "after")), 256)
    known = shared.checkpointed(found.select(passage.alias("passage"), "key", "size", F.col("before").alias("b"), F.col("after").alias("a"), F.col("doc_id").alias("item")))
    sizes = sorted(r.size for r in known.select("size").distinct().collect())
    n, width, sieve = _sieve(known)
    scanned = shared.checkpointed(_grams(docs, id_col, text_col, sizes, width, sieve if n else None))
    texts = scanned.filter("key is null").select("row", "doc_id", "n_words")
    k = F.expr("(size + 1) div 2")
    once = known.groupBy("passage").agg(*(F.first(c).alias(c) for c in ("key", "size", "b", "a")))
    met = scanned.filter("key is not null").select("row", "key", "size", "at", "before", "after").join(once, ["key", "size"])
    met = met.select("row", "passage", "size", "at", k.alias("k"), _same("before", "b").alias("left"), _same("after", "a").alias("right"))
    hits = shared.checkpointed(met.filter("right >= k and left + right >= size").select("row", "passage", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + F.col("right")).alias("end")))
    by_row = W.partitionBy("row").orderBy("start", "end")
    so_far = F.max("end").over(by_row.rowsBetween(W.unboundedPreceding, -1))
    opened = hits.select("row", "start", "end").distinct().withColumn("opens", F.when(F.col("start") <= so_far, 0).otherwise(1))
    merged = opened.withColumn("run", F.sum("opens").over(by_row)).groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = merged.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length")))).alias("spans"))
    ids = known.filter("item is not null").select("passage", F.col("item").cast("string").alias("item")).distinct()
    items = hits.select("row", "passage").distinct().join(ids, "passage").select("row", "item").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    no_spans, no_items = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)"), F.expr("cast(array() as array<string>)")
    return texts.join(spans, "row", "left").join(items, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items"))
