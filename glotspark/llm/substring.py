"""Substring dedup on words, and suffix dedup on bytes.

Both find, without sorting all positions, every window of ``window`` units that
also starts earlier, and remove the units that such windows cover.

* *Cover sample.* Positions are numbered through a slab. With a difference
  cover D modulo v, for any two positions i and j some shift s < v puts both
  i+s and j+s on the cover. Two equal windows therefore hold, at the same
  place, two equal anchors of ``window - v + 1`` units that start on cover
  positions. Only anchors at cover positions are hashed and exchanged.
* *Extension.* Only windows that hold an anchor which occurs again can be
  repeated at all. Those, and no others, are compared whole: by 64-bit keys,
  sorted one range (bucket) at a time, each with its earliest document.
* Exact copies of whole documents are settled first by one key each, so that a
  group of copies costs one key for each copy, not its windows.

Defined results: a null text is empty; a null doc_id comes after all others;
rows that share a doc_id are documents of which none comes before the other;
an empty table gives an empty result; other columns are ignored. A false match
needs two different windows with equal 64-bit keys (about N*N/2**65 for N
windows that reach the second round).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glotspark.llm.kernels import BYTE_BASE, BYTE_CODES, LONG, U64, WORD_BASE, Words, mix, prefix_hash, range_hash, runs
from glotspark.llm.slabs import Answers, Keys, Slab, Slabs, blobs, part_of

#: Perfect and near perfect difference covers, by period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18), 31: (0, 1, 3, 8, 12, 18)}
COPIES, ANCHORS, WINDOWS = 1, 2, 3
SPANS = "array<struct<start:long,length:long>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))


def is_cover(period: int, members: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in members for b in members} == set(range(period))


class _Units:
    """Codes of the units (words or bytes) of a slab, end to end."""

    def __init__(self, slab: Slab, kind: str):
        self.slab, self.kind = slab, kind
        if kind == "word":
            self.words = Words(slab.data, slab.offs)
            codes, self.first, self.base = self.words.hash, self.words.first, WORD_BASE
            self.units = codes
        else:
            codes, self.first, self.base = BYTE_CODES[slab.data], slab.offs, BYTE_BASE
            self.units = slab.data
        self.n = len(codes)
        self.sums = prefix_hash(codes, self.base)
        self.counts = np.diff(self.first)

    def keys(self, start: np.ndarray, length: int) -> np.ndarray:
        return range_hash(self.sums, start, start + length, self.base, self.units if length > LONG else None)

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1

    def copies(self) -> Keys:
        key = range_hash(self.sums, self.first[:-1], self.first[1:], self.base, self.units) ^ mix(self.counts.astype(U64))
        return Keys(key, np.arange(len(self.slab)))

    def is_copy(self, answers: Answers) -> np.ndarray:
        """Rows whose whole text also belongs to a smaller doc_id."""
        keys = self.copies()
        return (answers.of(COPIES, keys) | False)[keys.of] | (self.slab.rank > self.slab.rank[keys.rows][keys.of])

    def anchors(self, skip: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray, Keys]:
        length = window - period + 1
        at = (np.arange(0, max(self.n - length + 1, 0), period)[:, None] + np.array(COVERS[period])[None, :]).ravel()
        at = at[at + length <= self.n]
        row = self.row_of(at)
        fit = (at + length <= self.first[row + 1]) & ~skip[row] & (self.counts[row] >= window)
        at, row = at[fit], row[fit]
        return at, row, Keys(self.keys(at, length), row)

    def windows(self, skip: np.ndarray, answers: Answers, window: int, period: int, bucket: tuple[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, Keys]:
        """Starts of the windows that hold a repeated anchor; with a bucket, of
        those only whose keys fall in that range of parts."""
        at, row, keys = self.anchors(skip, window, period)
        again = (answers.of(ANCHORS, keys) | (keys.counts > 1))[keys.of]
        at, row = at[again], row[again]
        low = np.maximum(at - period + 1, self.first[row])
        high = np.minimum(at, self.first[row + 1] - window) + 1
        some = high > low
        start = np.flatnonzero(_covered(low[some], high[some], self.n))
        keys = self.keys(start, window)
        if bucket:
            part = part_of(keys, answers.parts)
            inside = (part >= U64(bucket[0])) & (part < U64(bucket[1]))
            start, keys = start[inside], keys[inside]
        row = self.row_of(start)
        return start, row, Keys(keys, row)

    def removed(self, answers: Answers, window: int, period: int, within: bool) -> np.ndarray:
        copy = self.is_copy(answers)
        start, row, keys = self.windows(copy, answers, window, period)
        gone = answers.of(WINDOWS, keys)[keys.of] | (self.slab.rank[row] > self.slab.rank[keys.rows][keys.of])
        if within and len(row):
            by = row[keys.order]
            again = np.zeros(len(row), bool)
            again[1:] = (keys.group[1:] == keys.group[:-1]) & (by[1:] == by[:-1])
            gone[keys.order] |= again
        low = np.concatenate([start[gone], self.first[:-1][copy & (self.counts >= window)]])
        high = np.concatenate([start[gone] + window, self.first[1:][copy & (self.counts >= window)]])
        return _covered(low, high, self.n)


def _covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in some range low <= x < high."""
    edges = np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
    return np.cumsum(edges[:n]) > 0


def span_lists(gone: np.ndarray, first: np.ndarray) -> pa.Array:
    """For each text its maximal runs of true units, counted from its start."""
    start, end, numbers = runs(gone, first)
    base = first[np.searchsorted(first, start, "right") - 1] if len(start) else start
    pairs = pa.StructArray.from_arrays([pa.array(start - base, pa.int64()), pa.array(end - start, pa.int64())], fields=list(SPAN_TYPE.value_type))
    return pa.ListArray.from_arrays(pa.array(numbers, pa.int32()), pairs, type=SPAN_TYPE)


def joined_words(words: Words, keep: np.ndarray) -> pa.Array:
    """For each text its kept words, joined by one space."""
    data, offs = words.data.copy(), words.offs
    mask = _covered(words.start[keep], words.end[keep], len(data))
    kept = np.flatnonzero(keep)
    row = np.searchsorted(words.first, kept, "right") - 1
    gap = words.end[kept[:-1][row[:-1] == row[1:]]]
    data[gap] = 0x20
    mask[gap] = True
    return cut_bytes(data, offs, mask, pa.string())


def cut_bytes(data: np.ndarray, offs: np.ndarray, mask: np.ndarray, kind: pa.DataType) -> pa.Array:
    sums = np.concatenate([[0], np.cumsum(mask)])[offs].astype(np.int32)
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(sums), pa.py_buffer(np.ascontiguousarray(data[mask]))])


def _rounds(slabs: Slabs, kind: str, window: int, period: int, buckets: int) -> None:
    if window < period:
        raise ValueError("a window must be at least as long as the period")

    def copies(no, slab, answers, parts):
        yield from blobs(no, COPIES, _Units(slab, kind).copies(), parts, slab.ids)

    def anchors(no, slab, answers, parts):
        units = _Units(slab, kind)
        yield from blobs(no, ANCHORS, units.anchors(units.is_copy(answers), window, period)[2], parts, None)

    slabs.ask(copies)
    slabs.ask(anchors)
    for bucket in slabs.buckets(buckets):

        def windows(no, slab, answers, parts, bucket=bucket):
            units = _Units(slab, kind)
            yield from blobs(no, WINDOWS, units.windows(units.is_copy(answers), answers, window, period, bucket)[2], parts, slab.ids)

        slabs.ask(windows)


def _ids(slab: Slab) -> pa.ChunkedArray:
    return slab.table["doc_id"]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, period: int = 13, buckets: int = 1) -> DataFrame:
    """Removes each word that a run of ``window`` words covers which also starts
    earlier (in a document with a smaller id, or before in the same document).

    Returns doc_id, n_words, n_removed, spans (of removed words, in words) and
    text (kept words joined by one space). See the module for edge cases.
    """
    slabs = Slabs(docs, id_col, text_col)
    _rounds(slabs, "word", window, period, buckets)

    def result(no, slab, answers):
        units = _Units(slab, "word")
        gone = units.removed(answers, window, period, True)
        total = np.concatenate([[0], np.cumsum(gone)])
        return pa.table({"doc_id": _ids(slab), "n_words": units.counts, "n_removed": np.diff(total[units.first]), "spans": span_lists(gone, units.first), "text": joined_words(units.words, ~gone)})

    return slabs.finish(result, f"doc_id long, n_words long, n_removed long, spans {SPANS}, text string")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, period: int = 31, buckets: int = 3) -> DataFrame:
    """Removes each byte that a string of ``window`` bytes covers which also
    starts in a document with a smaller id.

    Not by a suffix array: as in ``substring_dedup``, hashed anchors tell which
    windows can be repeated, and these are compared by hash, one of ``buckets``
    ranges of hashes at a time, so that memory and shuffle files stay bounded.

    Returns doc_id, n_bytes, n_removed, spans (of removed bytes) and content
    (the remaining bytes). See the module for edge cases.
    """
    slabs = Slabs(docs, id_col, text_col)
    _rounds(slabs, "byte", window, period, buckets)

    def result(no, slab, answers):
        gone = _Units(slab, "byte").removed(answers, window, period, False)
        total = np.concatenate([[0], np.cumsum(gone)])
        return pa.table({"doc_id": _ids(slab), "n_bytes": np.diff(slab.offs), "n_removed": np.diff(total[slab.offs]), "spans": span_lists(gone, slab.offs), "content": cut_bytes(slab.data, slab.offs, ~gone, pa.binary())})

    return slabs.finish(result, f"doc_id long, n_bytes long, n_removed long, spans {SPANS}, content binary")
