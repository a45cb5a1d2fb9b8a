"""Line dedup by deletion neighbourhoods.

A line is what stands between line feeds; its units are its words. A line goes
if an earlier line (in a document with a smaller id, or above in the same
document) is equal in words, or within one word edit: a word put in, left out
or replaced, where both lines have ``min_words`` words at least. Lines without
words stay. Decisions are made on the input, so a line goes even where the
earlier line goes too; the earliest of all always stays.

* Equal lines are settled by one key a line.
* One edit leaves the first or the last half of the shorter line as it is. Only
  lines of which a half occurs in another line emit variants: no other can have
  a partner.
* Variants: the line without its i-th word. Two lines that agree in such a
  variant, in i and in length differ by one replacement. A line equal to
  another's variant differs by one word put in. So equal keys, with position
  and length, already verify the distance, and each key's earliest document
  (for a word put in: the earliest in the other role) tells what goes: no pairs are made, however many lines share a key.

Defined results: as in ``substring``; a text without words is never emptied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glotspark.llm.kernels import U64, PrimeSums, Words, mix
from glotspark.llm.slabs import Answers, Keys, Slab, Slabs, blobs
from glotspark.llm.substring import SPANS, _covered, cut_bytes, span_lists

EQUAL, HALVES, REPLACED, PUT_IN = 1, 2, 3, 5


class _Lines:
    def __init__(self, slab: Slab):
        self.slab = slab
        data, offs = slab.data, slab.offs
        feed = np.flatnonzero(data == 0x0A)
        self.start = np.sort(np.concatenate([offs[:-1], feed + 1]), kind="stable")
        row_first = np.searchsorted(feed, offs)  # line feeds before each text
        self.first = row_first + np.arange(len(offs))  # and one line more for each text
        self.end = np.append(self.start[1:] - 1, len(data))
        self.end[self.first[1:] - 1] = offs[1:]
        self.row = np.repeat(np.arange(len(slab)), np.diff(self.first))
        words = Words(data, offs)
        self.sums = PrimeSums(words.hash)
        self.low = np.searchsorted(words.start, self.start)
        self.high = np.searchsorted(words.start, self.end)
        self.n = self.high - self.low

    def range(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.sums.ranges((low, high))

    def equal(self) -> tuple[np.ndarray, Keys]:
        at = np.flatnonzero(self.n > 0)
        key = mix(self.range(self.low[at], self.high[at]) ^ mix(self.n[at].astype(U64)))
        return at, Keys(key, self.row[at])

    def not_first(self, answers: Answers) -> np.ndarray:
        at, keys = self.equal()
        gone = np.zeros(len(self.n), bool)
        gone[at] = answers.of(EQUAL, keys)[keys.of] | self.earlier(at, keys, None)
        return gone

    def earlier(self, line: np.ndarray, keys: Keys, role: np.ndarray | None) -> np.ndarray:
        """Within the slab: does the key (in the other role, if there are roles)
        also come from a smaller id, or from a line above in the same row?"""
        if not len(line):
            return np.zeros(0, bool)
        value = keys.keys[keys.of]
        row, rank = self.row[line], self.slab.rank[self.row[line]]
        order = np.lexsort((line, value))
        value, row_o, line_o, rank_o = value[order], row[order], line[order], rank[order]
        new = np.ones(len(line), bool)
        new[1:] = value[1:] != value[:-1]
        new_row = new.copy()
        new_row[1:] |= row_o[1:] != row_o[:-1]
        at, at_row, by, by_row = np.flatnonzero(new), np.flatnonzero(new_row), np.cumsum(new) - 1, np.cumsum(new_row) - 1
        out = np.zeros(len(line), bool)
        for r in (None,) if role is None else (0, 1):
            other = np.ones(len(line), bool) if r is None else role[order] != r
            least = np.minimum.reduceat(np.where(other, rank_o, len(self.slab)), at)[by]
            above = np.minimum.reduceat(np.where(other, line_o, len(self.n)), at_row)[by_row]
            found = (least < rank_o) | (above < line_o)
            out[order] |= found if r is None else found & ~other
        return out

    def halves(self, some: np.ndarray) -> tuple[np.ndarray, Keys]:
        """Keys of the halves that one edit may leave as they are. With m words
        in the shorter line these are its first m // 2 words or all the others;
        a line may be the shorter one, or the longer one with m + 1 words."""
        at = np.flatnonzero(some)
        n = self.n[at]
        even = n % 2 == 0
        line, keys = [], []
        for a, size, side in ((at, n // 2, 0), (at[even], n[even] // 2 - 1, 0), (at, n - n // 2, 1), (at[~even], n[~even] // 2, 1)):
            low = self.high[a] - size if side else self.low[a]
            line.append(a)
            keys.append(mix(self.range(low, low + size) ^ mix((size * 4 + side).astype(U64))))
        line, keys = np.concatenate(line), np.concatenate(keys)
        return line, Keys(keys, self.row[line])

    def candidates(self, answers: Answers, min_words: int) -> np.ndarray:
        some = ~self.not_first(answers) & (self.n >= min_words)
        line, keys = self.halves(some)
        again = answers.of(HALVES, keys) | (keys.counts > 1)
        out = np.zeros(len(self.n), bool)
        out[line[again[keys.of]]] = True
        return out

    def variants(self, some: np.ndarray, min_words: int) -> tuple[np.ndarray, Keys, np.ndarray, np.ndarray, Keys]:
        """Lines and keys for a word replaced; lines, roles (0: the line itself,
        1: the line without a word) and keys for a word put in."""
        at = np.flatnonzero(some)
        n = self.n[at]
        line = np.repeat(at, n)
        i = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
        low, high, gap = self.low[line], self.high[line], self.low[line] + i
        left = self.sums.ranges((low, gap), (gap + 1, high))
        replaced = Keys(mix(left ^ mix((i * 2 + 1).astype(U64) + mix(self.n[line].astype(U64)))), self.row[line])
        longer = self.n[line] > min_words
        both = np.concatenate([at, line[longer]])
        role = np.repeat(np.array([0, 1], np.uint8), [len(at), int(longer.sum())])
        put_in = mix(np.concatenate([self.range(self.low[at], self.high[at]), left[longer]]))
        return line, replaced, both, role, Keys(put_in, self.row[both], role)

    def gone(self, answers: Answers, min_words: int) -> np.ndarray:
        out = self.not_first(answers)
        line, replaced, both, role, put_in = self.variants(self.candidates(answers, min_words), min_words)
        out[line[answers.of(REPLACED, replaced)[replaced.of] | self.earlier(line, replaced, None)]] = True
        before = answers.least(PUT_IN, put_in)[put_in.of] < self.slab.ids[self.row[both]]
        out[both[before | self.earlier(both, put_in, role)]] = True
        return out

    def text(self, keep: np.ndarray) -> pa.Array:
        data = self.slab.data
        mask = _covered(self.start[keep], self.end[keep], len(data))
        kept = np.flatnonzero(keep)
        mask[self.end[kept[:-1][self.row[kept[:-1]] == self.row[kept[1:]]]]] = True
        return cut_bytes(data, self.slab.offs, mask, pa.string())


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, keep: tuple[str, ...] = ()) -> DataFrame:
    """Removes repeated lines; see the module.

    Returns doc_id, n_lines, n_removed, spans (of removed lines, in lines), text
    (the other lines, joined by line feeds), emptied (every line with words
    went) and the columns named in keep, unchanged.
    """
    if min_words < 4:
        raise ValueError("min_words: 4 at least, so that a half is never empty")
    slabs = Slabs(docs, id_col, text_col, keep)

    def equal(no, slab, answers, parts):
        yield from blobs(no, EQUAL, _Lines(slab).equal()[1], parts, slab.ids)

    def halves(no, slab, answers, parts):
        lines = _Lines(slab)
        some = ~lines.not_first(answers) & (lines.n >= min_words)
        yield from blobs(no, HALVES, lines.halves(some)[1], parts, None)

    def variants(no, slab, answers, parts):
        lines = _Lines(slab)
        _, replaced, _, _, put_in = lines.variants(lines.candidates(answers, min_words), min_words)
        yield from blobs(no, REPLACED, replaced, parts, slab.ids)
        yield from blobs(no, PUT_IN, put_in, parts, slab.ids)

    for work in (equal, halves, variants):
        slabs.ask(work)

    def result(no, slab, answers):
        lines = _Lines(slab)
        gone = lines.gone(answers, min_words)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[lines.first])
        worded = lines.n > 0
        out = {"doc_id": slab.table["doc_id"], "n_lines": np.diff(lines.first), "n_removed": total(gone), "spans": span_lists(gone, lines.first), "text": lines.text(~gone), "emptied": (total(gone) > 0) & (total(worded & ~gone) == 0)}
        return pa.table(out | {f"keep_{i}": slab.table[f"keep_{i}"] for i in range(len(keep))})

    schema = T._parse_datatype_string(f"doc_id long, n_lines long, n_removed long, spans {SPANS}, text string, emptied boolean")
    for i, c in enumerate(keep):
        schema = schema.add(f"keep_{i}", docs.schema[c].dataType)
    out = slabs.finish(result, schema)
    return out.select("doc_id", "n_lines", "n_removed", "spans", "text", "emptied", *(out[f"keep_{i}"].alias(c) for i, c in enumerate(keep)))
