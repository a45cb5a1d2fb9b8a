"""Language of a text, and of the spans of a mixed text.

* *Words* are runs of letters. A word's first letter gives its script, by code
  point ranges; only languages learned with that script are candidates for it.
* *Scores* of a word in each language come from counts of the word, of its first
  and of its last bytes, hashed into tables of fixed size.
* *Viterbi* finds the best sequence of languages, with a penalty for each
  switch. All chunks of ``CHUNK`` words of a slab go through it together: first
  the best score from each entering to each leaving language, then the chain of
  chunks, then the labels, so a very long text costs what its words cost.

The text's language is the one that labels most of its letters; the score is
that share times how surely the words it labels speak for it.

Defined results: ``und`` and 0 for a null text or one without letters (and for
all where nothing was learned); letters in a script that no language was learned
with count for none; of equal shares the first in code point order wins;
repeated rows each get a result; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.llm.gather import SUMS, packed, summed
from glotspark.llm.kernels import BYTE_BASE, BYTE_CODES, U64, in_slabs, mix, prefix_hash, range_hash, runs, text_bytes
from glotspark.llm.shared import prepare

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: First code points of the script ranges that are told apart, and their names.
SCRIPTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"), (0x0750, "Arabic"),
    (0x0780, "other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Burmese"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "other"), (0x3130, "Hangul"),
    (0x3190, "other"), (0x31F0, "Kana"), (0x3200, "other"), (0x3400, "Han"), (0xA000, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"),
    (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "other"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "other"), (0xFF21, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, "other"), (0x20000, "Han"), (0x30000, "other"),
)
RANGE_STARTS = np.array([a for a, _ in SCRIPTS])
NAMES = sorted({b for _, b in SCRIPTS})
RANGE_SCRIPT = np.array([NAMES.index(b) for _, b in SCRIPTS])
WORDS, ENDS = 1 << 17, 1 << 15
SIZE = WORDS + 2 * ENDS + len(NAMES)
CHUNK = 256
FAR = -8.0


def first_script(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The script of the code point that starts at each position."""
    at = lambda k: data[np.minimum(start + k, len(data) - 1)].astype(np.int64) & 0x3F
    lead = data[start].astype(np.int64)
    point = lead.copy()
    for low, bits, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        some = lead >= low
        value = lead & bits
        for k in range(1, more + 1):
            value = value << 6 | at(k)
        point[some] = value[some]
    return RANGE_SCRIPT[np.searchsorted(RANGE_STARTS, point, "right") - 1]


class Letters:
    """The words of a slab: row, byte length, script, and three buckets each."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        low = LOWER[data]
        self.start, self.end, self.first = runs(LETTER[data], offs)
        self.size = self.end - self.start
        sums = prefix_hash(BYTE_CODES[low], BYTE_BASE)
        word = range_hash(sums, self.start, self.end, BYTE_BASE) & U64(WORDS - 1)
        head = range_hash(sums, self.start, np.minimum(self.start + 3, self.end), BYTE_BASE) & U64(ENDS - 1)
        tail = mix(range_hash(sums, np.maximum(self.end - 3, self.start), self.end, BYTE_BASE)) & U64(ENDS - 1)
        self.buckets = (word.astype(np.int64), WORDS + head.astype(np.int64), WORDS + ENDS + tail.astype(np.int64))
        self.script = first_script(data, self.start) if len(self.start) else np.zeros(0, np.int64)


class Model:
    """Log likelihoods by language, in tables of fixed size (SIZE numbers each)."""

    def __init__(self, counts: dict[str, np.ndarray], switch: float = 10.0):
        self.names = sorted(counts)
        self.switch = switch
        k = len(self.names)
        self.table = np.zeros((SIZE, max(1, k)), np.float32)
        self.candidate = np.zeros((len(NAMES), max(1, k)), bool)
        for j, name in enumerate(self.names):
            c = counts[name].astype(np.float64)
            for a, b, weight in ((0, WORDS, 1.0), (WORDS, WORDS + ENDS, 0.5), (WORDS + ENDS, WORDS + 2 * ENDS, 0.5)):
                part = c[a:b]
                self.table[a:b, j] = weight * np.log((part + 0.5) / (part.sum() + 0.5 * (b - a)))
            scripts = c[WORDS + 2 * ENDS :]
            self.candidate[:, j] = scripts > 0.005 * max(1.0, scripts.sum())

    def word_scores(self, words: Letters) -> np.ndarray:
        """Per word and language; 0 is the best, FAR the least, all 0 where the
        script speaks for no language."""
        a, b, c = words.buckets
        score = self.table[a] + self.table[b] + self.table[c]
        open_ = self.candidate[words.script]
        score = np.where(open_, score, -np.inf)
        best = score.max(1, keepdims=True, initial=-np.inf)
        with np.errstate(invalid="ignore"):
            score = np.maximum(score - best, FAR)
        score[~open_.any(1)] = 0
        return score

    def labels(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best language of each word, by Viterbi over each text."""
        n, k = score.shape
        counts = np.diff(first)
        chunks = -(-counts // CHUNK)
        total = int(chunks.sum())
        if not total:
            return np.zeros(0, np.int64)
        chunk_first = np.concatenate([[0], np.cumsum(chunks)])
        row = np.repeat(np.arange(len(counts)), chunks)
        nth = np.arange(total) - chunk_first[:-1][row]
        at = first[:-1][row] + nth * CHUNK
        length = np.minimum(counts[row] - nth * CHUNK, CHUNK)
        order = np.argsort(-length, kind="stable")  # so that the chunks still going at any step stand first
        going = np.searchsorted(-length[order], -np.arange(CHUNK), "left")
        at_o, steps = at[order], int(length.max())
        # from entering to leaving language: only chunks of longer texts need it
        some = np.flatnonzero((chunks > 1)[row[order]])
        through = np.full((len(some), k, k), -np.inf, np.float32)
        through[:, np.arange(k), np.arange(k)] = 0
        still, slot = np.searchsorted(-length[order][some], -np.arange(CHUNK), "left"), np.zeros(total, np.int64)
        slot[some] = np.arange(len(some))
        for t in range(steps if len(some) else 0):
            part = through[: still[t]]
            np.maximum(part, part.max(2, keepdims=True) - self.switch, out=part)
            part += score[at_o[some[: still[t]]] + t][:, None, :]
        place = np.empty(total, np.int64)
        place[order] = np.arange(total)
        enter = np.zeros((total, k), np.float32)
        for j in range(1, int(chunks.max())):
            here = np.flatnonzero(nth == j) if j < 4 else chunk_first[:-1][chunks > j] + j
            before = place[here - 1]
            enter[place[here]] = (enter[before][:, :, None] + through[slot[before]]).max(1)
        state = enter.copy()
        stay = np.ones((steps, total, k), bool)
        come = np.zeros((steps, total), np.int8 if k < 128 else np.int32)
        for t in range(steps):
            m = going[t]
            part = state[:m]
            best = part.max(1, keepdims=True) - self.switch
            come[t, :m] = part.argmax(1)
            stay[t, :m] = part >= best
            state[:m] = np.maximum(part, best) + score[at_o[:m] + t]
        back = np.tile(np.arange(k), (total, 1))  # for each leaving language the entering one
        some = np.arange(total)[:, None]
        for t in range(steps - 1, -1, -1):
            m = going[t]
            part = back[:m]
            back[:m] = np.where(stay[t, :m][some[:m], part], part, come[t, :m, None])
        leave = np.zeros(total, np.int64)
        last = chunk_first[1:][chunks > 0] - 1
        leave[place[last]] = state[place[last]].argmax(1)
        for j in range(int(chunks.max()) - 1, 0, -1):
            here = place[chunk_first[:-1][chunks > j] + j]
            leave[place[chunk_first[:-1][chunks > j] + j - 1]] = back[here, leave[here]]
        out = np.zeros(n, np.int64)
        now = leave
        for t in range(steps - 1, -1, -1):
            m = going[t]
            out[at_o[:m] + t] = now[:m]
            now[:m] = np.where(stay[t, :m][np.arange(m), now[:m]], now[:m], come[t, :m])
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", switch: float = 10.0) -> Model:
    """Counts over all given rows whose language isn't null."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for table in in_slabs(batches, "text", 2 << 20):
            data, offs = text_bytes(table["text"])
            words = Letters(data, offs)
            names, which = np.unique(np.array(table["lang"].to_pylist(), object), return_inverse=True)
            of = np.repeat(which, np.diff(words.first))
            for j, name in enumerate(names):
                some = of == j
                total = sums.setdefault(name, np.zeros(SIZE, np.int64))
                for b in words.buckets:
                    total += np.bincount(b[some], minlength=SIZE)
                total += np.bincount(WORDS + 2 * ENDS + words.script[some], minlength=SIZE)
        yield from packed(sums, TaskContext.get().partitionId())

    prepare(docs.sparkSession)
    rows = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).filter("text is not null and lang is not null")
    return Model(summed(rows.mapInArrow(count, SUMS)), switch)


SPANS = "array<struct<start:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, lang_pred, score and spans (byte ranges and languages)."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model, 5))  # SIZE numbers for each language
    held: list[Model] = []

    def label(batches):
        if not held:
            held.append(pickle.loads(shared.value))
        model = held[0]
        k = len(model.names)
        names = pa.array(model.names, pa.string())
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
        for table in in_slabs(batches, "text", 2 << 20):
            data, offs = text_bytes(table["text"])
            words = Letters(data, offs)
            n = len(table)
            row = np.repeat(np.arange(n), np.diff(words.first))
            ascii_letter = np.concatenate([[0], np.cumsum(LETTER[data] & (data < 128))])
            lettered = np.diff(ascii_letter[offs]) > 0
            for i in np.flatnonzero(~lettered & (np.diff(words.first) > 0)):
                lettered[i] = any(map(str.isalpha, data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
            lettered &= k > 0
            score = model.word_scores(words)
            of = model.labels(score, words.first)
            weigh = np.where(model.candidate[words.script].any(1), words.size, 0)
            share = np.bincount(row * max(1, k) + of, weights=weigh, minlength=n * max(1, k)).reshape(n, max(1, k))
            pred = share.argmax(1)
            total = share.sum(1)
            # the words that the language labels: their evidence against each other language
            mine = of == pred[row]
            sums = np.stack([np.bincount(row[mine], weights=score[mine, j], minlength=n) for j in range(max(1, k))], 1)
            odds = np.exp(np.clip((sums - sums[np.arange(n), pred][:, None]) / 2, -50, 50)).sum(1)
            sure = np.where(total > 0, share[np.arange(n), pred] / np.maximum(total, 1), 1 / max(1, k)) / odds
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (row[1:] != row[:-1])
            new &= np.repeat(lettered, np.diff(words.first))
            keep = np.flatnonzero(new)
            ends = np.append(np.flatnonzero(new)[1:], len(of))
            ends = np.minimum(ends, words.first[1:][row[keep]]) - 1 if len(keep) else ends[:0]
            spans = pa.StructArray.from_arrays([pa.array((words.start[keep] - offs[row[keep]]).astype(np.int32)), pa.array((words.end[ends] - offs[row[keep]]).astype(np.int32)), names.take(pa.array(of[keep])) if k else pa.array([], pa.string())], fields=list(span))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(keep, words.first).astype(np.int32)), spans)
            lang = pa.array(np.where(lettered, np.array([*model.names, "und"], object)[np.where(lettered, pred, k)], "und"), pa.string())
            yield pa.record_batch({"doc_id": table["doc_id"].combine_chunks(), "lang_pred": lang, "score": pa.array(np.where(lettered, np.clip(sure, 0, 1), 0.0)), "spans": lists})

    prepare(docs.sparkSession)
    columns = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return columns.mapInArrow(label, f"doc_id long, lang_pred string, score double, spans {SPANS}")
