"""Toxicity by the nearest labelled examples, with exact TF-IDF cosine.

* *Terms* are all words and the first four characters of longer words, with A-Z
  in lower case. A term weighs ``(1 + ln count) * idf * phi``: document
  frequencies for the IDF come from all documents, and phi is the strength
  (phi coefficient) of the term's link with the label in the sample. No term is
  cut; one that no example has, or that tells nothing of the label, weighs 0.
* *Fitting* uses a bounded sample: the ``per_class`` labelled documents of each
  class that come first by a seeded hash, as far as their texts fit in
  ``budget`` bytes a class; a text that doesn't fit is passed over. A near copy of an earlier one of the
  same class (a Jaccard similarity of five-word shingles of 0.8, estimated by
  128 MinHashes) is passed over, and the next takes its place.
* *Search.* Products of terms that a sixteenth of the examples or more have are
  summed for many documents at once, by matrices; those of the other terms by an
  inverted index. The cosines to all examples are exact, and so are the k nearest.
* *Votes* weigh by squared cosine and by class, so that they speak for the share
  of toxic documents among all labelled ones. A document that is an example has
  no vote on itself; copies of it under other ids have. A logistic curve makes votes
  probabilities; it is fitted to votes of the examples in which neither the example nor one
  of the same text takes part. Votes stay as they
  are where the examples with a term of some weight are all of one class.

Defined results: a null or empty text, or one without a term of some weight, gets
the rate of such examples; so does every text where nothing could be learned
(with no labels at all: 0). Null labels aren't used; of several labels of a
document the highest counts. Equal cosines: the smaller doc_id is nearer.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotspark.llm.gather import SUMS, packed, summed
from glotspark.llm.kernels import BYTE_BASE, BYTE_CODES, U64, WORD_BASE, Words, in_slabs, mix, prefix_hash, range_hash, runs, text_bytes, trim
from glotspark.llm.langid import LETTER, LOWER
from glotspark.llm.shared import checkpointed, prepare

OFTEN = 16  # terms of one in so many examples or more aren't in the inverted index
TOGETHER = 64  # documents in a matrix
FILL = 256  # examples that go into the index at once
SLAB = 512 << 10  # bytes of text at once: a worker holds some 70 bytes for each, besides the model
HEAD = 4


def terms(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit number of each term of a slab, repeats included."""
    start, end, first = runs(LETTER[data], offs)
    low = LOWER[data]
    sums = prefix_hash(BYTE_CODES[low], BYTE_BASE)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    at = np.flatnonzero((data & 0xC0) != 0x80)  # where characters start
    nth = np.searchsorted(at, start)
    long = np.flatnonzero(np.searchsorted(at, end) - nth > HEAD)
    head = mix(range_hash(sums, start[long], at[nth[long] + HEAD], BYTE_BASE))
    return np.concatenate([row, row[long]]), np.concatenate([range_hash(sums, start, end, BYTE_BASE, low), head])


def counted(row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct numbers, ordered, and how often it has them."""
    order = np.lexsort((number, row))
    row, number = row[order], number[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    at = np.flatnonzero(new)
    return row[at], number[at], np.diff(np.append(at, len(row)))


def text_keys(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """64 bits for each text."""
    return range_hash(prefix_hash(BYTE_CODES[data], BYTE_BASE), offs[:-1], offs[1:], BYTE_BASE, data).view(np.int64)


class Vocabulary:
    """The terms of the examples, ordered."""

    def __init__(self, numbers: np.ndarray):
        self.numbers = np.sort(numbers.astype(U64))

    def __len__(self) -> int:
        return len(self.numbers)

    def found(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in the vocabulary and count, ordered, of the terms known."""
        if not len(self):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        row, number = terms(data, offs)
        maybe = np.zeros(1 << 22, bool)  # spares most searches for unknown terms
        maybe[self.numbers & U64(len(maybe) - 1)] = True
        some = np.flatnonzero(maybe[number & U64(len(maybe) - 1)])
        at = np.minimum(np.searchsorted(self.numbers, number[some]), len(self) - 1)
        known = self.numbers[at] == number[some]
        both = np.sort(row[some[known]] * len(self) + at[known])
        at = np.flatnonzero(np.diff(both, prepend=-1))
        return both[at] // len(self), both[at] % len(self), np.diff(np.append(at, len(both)))


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of lengths n, one after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Index:
    """Inverted index over unit vectors, and a matrix of frequent terms. ids, keys:
    of the examples and of their texts."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, vectors: Sequence[tuple[np.ndarray, np.ndarray]], size: int, keys: np.ndarray):
        """vectors: with distinct terms each; read twice, a few at a time, so they may be made on demand."""
        lead, n = np.full(len(ids), size, np.int64), np.zeros(size, np.int64)
        for i in range(len(ids)):
            t, w = vectors[i]
            if len(t):
                lead[i] = t[np.argmax(w)]
                n[t] += 1
        order = np.lexsort((ids, lead, toxic))
        self.ids, self.toxic, self.keys = ids[order], toxic[order], keys[order]
        often = np.flatnonzero(n * OFTEN >= max(1, len(ids)))
        self.place = np.full(size, -1, np.int32)
        self.place[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), len(ids)))
        n[often] = 0
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        self.who, self.weight = np.zeros(self.first[-1], np.int64), np.zeros(self.first[-1])
        free = self.first[:-1].copy()
        for low in range(0, len(order), FILL):
            part = [vectors[i] for i in order[low : low + FILL].tolist()]
            term = np.concatenate([t for t, _ in part]).astype(np.int64)
            by = np.argsort(term, kind="stable")  # examples of a term in order
            term, weight = term[by], np.concatenate([w for _, w in part])[by]
            who = np.repeat(np.arange(low, low + len(part)), [len(t) for t, _ in part])[by]
            place = self.place[term]
            dense, rare = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            self.dense[place[dense], who[dense]] = weight[dense]
            at = np.flatnonzero(np.diff(term[rare], prepend=-1))
            some, more = term[rare][at], np.diff(np.append(at, len(rare)))
            to = ranges(free[some], more)
            self.who[to], self.weight[to] = who[rare], weight[rare]
            free[some] += more
        place = np.argsort(self.ids, kind="stable")
        self.by_id = self.ids[place], place

    @property
    def edges(self) -> np.ndarray:
        """Where the cells that ``first`` counts begin in who and weight; a cell is one entry."""
        return np.arange(len(self.who) + 1)

    def own(self, doc_id: int | None) -> int | None:
        """The example with this id."""
        ids, place = self.by_id
        at = len(ids) if doc_id is None else int(np.searchsorted(ids, doc_id))
        return int(place[at]) if at < len(ids) and ids[at] == doc_id else None

    def bases(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the frequent terms add to the cosines of the vectors to all examples."""
        q = np.zeros((len(vectors), len(self.dense)))
        for i, (t, w) in enumerate(vectors):
            at = self.place[t]
            q[i, at[at >= 0]] = w[at >= 0]
        return q @ self.dense

    def nearest(self, t: np.ndarray, q: np.ndarray, k: int, without: np.ndarray | int | None = None, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest with a cosine above 0, but for the
        examples ``without``. base: the vector's row of ``bases``."""
        base = self.bases([(t, q)])[0] if base is None else base
        rare = self.place[t] < 0
        t, q = t[rare], q[rare]
        n = self.first[t + 1] - self.first[t]
        flat = ranges(self.first[t], n)
        score = base + np.bincount(self.who[flat], np.repeat(q, n) * self.weight[flat], len(base))
        if without is not None:
            score[without] = 0.0
        at = np.flatnonzero(score > 0)
        if len(at) > k:
            at = at[score[at] >= np.partition(score[at], -k)[-k] - 1e-8]
        best = at[np.lexsort((self.ids[at], -np.round(score[at], 9)))[:k]]
        return best, score[best]


class Model:
    """examples: id, class, places in the vocabulary, counts, key of the text."""

    def __init__(self, vocabulary: Vocabulary, weight: np.ndarray, examples: list[tuple[int, int, np.ndarray, np.ndarray, int]], share: float, k: int = 15):
        self.vocabulary, self.weight, self.share, self.k = vocabulary, weight, share, k
        self.ids, self.toxic, self.keys = (np.array([e[i] for e in examples], np.int64) for i in (0, 1, 4))
        self.edges = np.cumsum([0, *(len(e[2]) for e in examples)])
        self.at, self.n = (np.concatenate([np.zeros(0, np.int32), *(e[i] for e in examples)]) for i in (2, 3))
        ones, zeros = max(1, int(self.toxic.sum())), max(1, int((self.toxic == 0).sum()))
        self.scale = np.array([(1 - share) / zeros, share / ones]) * len(examples)
        none = np.bincount(np.repeat(np.arange(len(examples)), np.diff(self.edges)), weight[self.at], len(examples)) == 0
        w = self.scale[self.toxic]
        self.empty = float(((w * self.toxic)[none].sum() + share) / (w[none].sum() + 1)) if len(examples) else 0.0
        self.slope, self.shift = 1.0, 0.0
        self._index: Index | None = None

    def __getstate__(self) -> dict:
        """Without the index, which tasks build, with differences of places, which compress well, and counts as small as they are."""
        return self.__dict__ | {"_index": None, "at": np.diff(self.at, prepend=np.int32(0)), "n": self.n.astype(np.min_scalar_type(self.n.max(initial=0)))}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"at": np.cumsum(state["at"], dtype=np.int32), "n": state["n"].astype(np.int32)})

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = Index(self.ids, self.toxic, Vectors(self), max(1, len(self.vocabulary)), self.keys)
        return self._index

    def indexed(self) -> Model:
        """With its index only, without what that is made of: it scores, but can't be sent on."""
        _ = self.index
        self.at = self.n = np.zeros(0, np.int32)
        trim()
        return self

    def sent(self, spark: SparkSession):
        """A broadcast for ``received``: a bounded sample, compressed."""
        raw = pickle.dumps(self, 5)
        size, raw = len(raw), pa.compress(raw, codec="zstd", asbytes=True)
        trim()
        return spark.sparkContext.broadcast((size, raw))

    def vector(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of some weight and the unit vector of their weights."""
        w = self.weight[t] * (1 + np.log(n))
        t, w = t[w > 0], w[w > 0]
        return t, w / max(1e-12, float(np.sqrt((w * w).sum())))

    def vote(self, who: np.ndarray, score: np.ndarray) -> float:
        """Log odds."""
        w = score * score * self.scale[self.index.toxic[who]]
        p = min(max(float(((w * self.index.toxic[who]).sum() + 0.05 * self.share) / (w.sum() + 0.05)), 1e-6), 1 - 1e-6)
        return float(np.log(p / (1 - p)))

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """votes: of the examples with a term of some weight."""
        if not 0 < toxic.sum() < len(toxic):
            return
        x, w = np.column_stack([votes, np.ones(len(votes))]), self.scale[toxic]
        beta = np.array([1.0, 0.0])
        for _ in range(50):  # Newton's steps, with a weak prior for slope 1 and shift 0
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            g = x.T @ (w * (p - toxic)) + (beta - [1, 0])
            h = (x * (w * p * (1 - p))[:, None]).T @ x + np.eye(2)
            step = np.linalg.solve(h, g)
            beta = beta - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if beta[0] > 0:
            self.slope, self.shift = map(float, beta)

    def neighbours(self, t: np.ndarray, n: np.ndarray, edges: np.ndarray, without: list):
        """Numbers and cosines of the nearest examples of each row; edges: of the rows in t and n."""
        for low in range(0, len(without), TOGETHER):
            rows = range(low, min(low + TOGETHER, len(without)))
            vectors = [self.vector(t[edges[i] : edges[i + 1]], n[edges[i] : edges[i + 1]]) for i in rows]
            bases = self.index.bases(vectors)
            for i, (at, q), base in zip(rows, vectors, bases, strict=True):
                yield self.index.nearest(at, q, self.k, without[i], base) if len(at) else (np.zeros(0, np.int64), np.zeros(0))

    def score(self, who: np.ndarray, score: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-(self.slope * self.vote(who, score) + self.shift)))) if len(who) else self.empty


class Vectors(Sequence):
    """The vectors of a model's examples, made when they are read."""

    def __init__(self, model: Model):
        self.model = model

    def __len__(self) -> int:
        return len(self.model.ids)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        return m.vector(m.at[m.edges[i] : m.edges[i + 1]], m.n[m.edges[i] : m.edges[i + 1]])


_received: WeakKeyDictionary = WeakKeyDictionary()


def received(shared) -> Model:
    """The model in a broadcast, with its index. A Python worker keeps it for its next
    tasks as long as it has the broadcast, so until it gets a task without that."""
    if shared not in _received:
        size, raw = shared.value
        _received[shared] = pickle.loads(pa.decompress(raw, size, codec="zstd", asbytes=True)).indexed()
    return _received[shared]


SIGNS, NEAR, SHINGLE = 128, 0.8, 5
EQUAL = int(np.ceil(NEAR * SIGNS))  # MinHashes that near copies share
PROBES = SIGNS - EQUAL + 1  # of so many, near copies share one at least


def signatures(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """SIGNS MinHashes a text; a text without words has zeros."""
    words = Words(data, offs)
    out = np.zeros((len(offs) - 1, SIGNS), np.uint32)
    if not len(words):
        return out
    start = np.arange(len(words))
    row = np.repeat(np.arange(len(offs) - 1), words.counts)
    first, end = words.first[row], words.first[row + 1]
    fit = (start + SHINGLE <= end) | (start == first)  # a shorter text is one shingle
    row = row[fit]
    key = range_hash(prefix_hash(words.hash, WORD_BASE), start[fit], np.minimum(start + SHINGLE, end)[fit], WORD_BASE)
    at = np.flatnonzero(np.diff(row, prepend=-1))
    for i, factor in enumerate(mix(np.arange(1, SIGNS + 1, dtype=U64)) | U64(1)):
        out[row[at], i] = np.minimum.reduceat(key * factor, at) >> U64(32)
    return out


class Examples:
    """Signatures of which none is near another."""

    def __init__(self, most: int):
        self.n, self.signs = 0, np.zeros((most, SIGNS), np.uint32)

    def has_near(self, sign: np.ndarray) -> bool:
        some = np.flatnonzero((self.signs[: self.n, :PROBES] == sign[:PROBES]).any(1))
        return bool(len(some)) and int((self.signs[some] == sign).sum(1).max()) >= EQUAL

    def add(self, sign: np.ndarray) -> None:
        self.signs[self.n] = sign
        self.n += 1


def _examples(docs: DataFrame, known: DataFrame, per_class: int, budget: int) -> list[tuple[int, int]]:
    """doc_id and class of the examples. known: doc_id, toxic and h, the order.

    By rounds: the next labelled documents that are near no example so far are
    found on the executors, and of these the driver takes one after the other,
    until a class has per_class or no document is left. The driver holds at most
    2 * per_class signatures of each class besides those of the examples."""
    spark = docs.sparkSession
    seen = {c: Examples(per_class) for c in (0, 1)}
    after: dict[int, tuple[int, int] | None] = {0: None, 1: None}
    picked: dict[int, int] = {}
    left = {0: budget, 1: budget}
    width = per_class
    while after:
        parts = []
        for c, last in after.items():
            rest = known.filter(F.col("toxic") == c)
            if last is not None:
                rest = rest.filter((F.col("h") > last[0]) | ((F.col("h") == last[0]) & (F.col("doc_id") > last[1])))
            parts.append(rest.orderBy("h", "doc_id").limit(width))
        window = checkpointed(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))
        ends = {r["toxic"]: r for r in window.groupBy("toxic").agg(F.count("*").alias("n"), F.max(F.struct("h", "doc_id")).alias("last")).collect()}  # a row a class
        sent = spark.sparkContext.broadcast(pickle.dumps({c: (x.n, x.signs[: x.n]) for c, x in seen.items()}, 5))

        def fresh(batches, sent=sent):
            held = {}
            for c, (n, signs) in pickle.loads(sent.value).items():
                held[c] = Examples(0)
                held[c].n, held[c].signs = n, signs
            for table in in_slabs(batches, "text", SLAB):
                data, offs = text_bytes(table["text"])
                signs = signatures(data, offs)
                keep = [i for i, c in enumerate(table["toxic"].to_pylist()) if not held[c].has_near(signs[i])]
                yield from table.select(["doc_id", "toxic", "h"]).take(pa.array(keep, pa.int64())).append_column("sign", pa.array([signs[i].tobytes() for i in keep], pa.binary())).append_column("size", pa.array(np.diff(offs)[keep].astype(np.int64))).to_batches()

        found = checkpointed(_one_text(docs.join(F.broadcast(window), "doc_id"), "doc_id", "toxic", "h").mapInArrow(fresh, "doc_id long, toxic int, h long, sign binary, size long"))
        for c in list(after):
            rows = found.filter(F.col("toxic") == c).orderBy("h", "doc_id", "sign").limit(2 * per_class).collect()  # bounded
            for r in rows:
                sign = np.frombuffer(r["sign"], np.uint32)
                if seen[c].n < per_class and r["size"] <= left[c] and r["doc_id"] not in picked and not seen[c].has_near(sign):
                    seen[c].add(sign)
                    picked[r["doc_id"]] = c
                    left[c] -= r["size"]
            if len(rows) == 2 * per_class:
                after[c] = (rows[-1]["h"], rows[-1]["doc_id"])
            elif c in ends:
                after[c] = tuple(ends[c]["last"])
            if seen[c].n == per_class or (len(rows) < 2 * per_class and (c not in ends or ends[c]["n"] < width)):
                del after[c]
        width = min(4 * width, 64 * per_class)
    return list(picked.items())


def _one_text(rows: DataFrame, *keys: str) -> DataFrame:
    """A row for each id: where several share it, the least of their texts."""
    return rows.groupBy(*keys).agg(F.min("text").alias("text")).select(*keys, "text")


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4096, budget: int = 64 << 20, k: int = 15, seed: int = 1) -> Model:
    """labels: the rows that may be learned from, with id_col and label_col. An id
    that several rows of docs share is one example, with the least of their texts.
    The driver holds the terms of the sample: at most 2 * per_class texts, 2 * budget bytes."""
    docs = _columns(docs, id_col, text_col)
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    picked = _examples(docs, known.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")), per_class, budget)
    sample = checkpointed(_one_text(docs.join(F.broadcast(docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")), "doc_id"), "doc_id", "toxic").repartition(32, "doc_id"))

    def tally(batches):
        for table in in_slabs(batches, "text", 2 << 20):
            row, number, _ = counted(*terms(*text_bytes(table["text"])))
            both, n = np.unique(np.stack([number.view(np.int64), table["toxic"].to_numpy()[row]]), axis=1, return_counts=True)
            yield pa.record_batch({"term": pa.array(both[0]), "toxic": pa.array(both[1].astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    tallied = sample.mapInArrow(tally, "term long, toxic int, n long").groupBy("term").agg(F.sum(F.col("toxic") * F.col("n")).alias("a"), F.sum((1 - F.col("toxic")) * F.col("n")).alias("b")).toArrow()  # terms of the sample
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    ones, zeros = sizes.get(1, 0), sizes.get(0, 0)
    order = np.argsort(tallied["term"].to_numpy().view(U64))
    words = Vocabulary(tallied["term"].to_numpy().view(U64))
    a, b = (tallied[c].to_numpy()[order].astype(float) for c in ("a", "b"))
    phi = np.abs(a * (zeros - b) - b * (ones - a)) / np.sqrt(max(1, ones * zeros) * np.maximum(1.0, (a + b) * (ones + zeros - a - b)))

    def frequency(batches):
        total = np.zeros(len(words) + 1, np.int64)
        for table in in_slabs(batches, "text", SLAB):
            total[: len(words)] += np.bincount(words.found(*text_bytes(table["text"]))[1], minlength=len(words))
            total[-1] += len(table)
        yield from packed({"": total}, TaskContext.get().partitionId())

    total = summed(docs.select("text").mapInArrow(frequency, SUMS)).get("", np.zeros(len(words) + 1, np.int64))
    weight = phi * (np.log((total[-1] + 1) / (total[:-1] + 1)) + 1)

    def vectors(batches):
        for table in in_slabs(batches, "text", SLAB):
            row, at, n = words.found(*text_bytes(table["text"]))
            edges = np.searchsorted(row, np.arange(len(table) + 1)).tolist()
            at, n = at.astype(np.int32), n.astype(np.int32)
            cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
            yield from pa.table({"doc_id": table["doc_id"], "toxic": table["toxic"], "at": cut(at), "n": cut(n), "key": text_keys(*text_bytes(table["text"]))}).to_batches()

    rows = sample.mapInArrow(vectors, "doc_id long, toxic int, at binary, n binary, key long").orderBy("doc_id").collect()  # the sample, in places of the vocabulary
    model = Model(words, weight, [(r["doc_id"], r["toxic"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32), r["key"]) for r in rows], float(share), k)
    del rows, tallied, a, b, phi, order  # the driver holds the model alone from here
    shared = model.sent(docs.sparkSession)

    def votes(batches):
        got = received(shared)
        index = got.index
        for table in in_slabs(batches, "text", SLAB):
            row, at, n = got.vocabulary.found(*text_bytes(table["text"]))
            edges = np.searchsorted(row, np.arange(len(table) + 1))
            without = [np.flatnonzero(index.keys == key) for key in text_keys(*text_bytes(table["text"]))]
            found = got.neighbours(at, n, edges, without)
            some = np.bincount(row, got.weight[at], len(table)) > 0
            out = [got.vote(*x) if any_term else None for x, any_term in zip(found, some.tolist(), strict=True)]
            yield from pa.table({"doc_id": table["doc_id"], "toxic": table["toxic"], "vote": pa.array(out, pa.float64())}).to_batches()

    cast = sample.mapInArrow(votes, "doc_id long, toxic int, vote double").filter("vote is not null").orderBy("doc_id").collect()  # a row an example
    model.calibrate(np.array([r["vote"] for r in cast]), np.array([r["toxic"] for r in cast], np.int64))
    shared.destroy()
    trim()
    return model


EVIDENCE = "array<struct<doc_id:long,toxic:int,cosine:double>>"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns doc_id, score, evidence (the five nearest examples) and the
    columns named in keep."""
    shared = model.sent(docs.sparkSession)
    kinds = {"doc_id": pa.int64(), "toxic": pa.int32(), "cosine": pa.float64()}

    def rate(batches):
        model = received(shared)
        for table in in_slabs(batches, "text", SLAB):
            row, at, n = model.vocabulary.found(*text_bytes(table["text"]))
            edges = np.searchsorted(row, np.arange(len(table) + 1))
            scores, who, cosine = [], [], []
            for w, c in model.neighbours(at, n, edges, [model.index.own(x) for x in table["doc_id"].to_pylist()]):
                scores.append(model.score(w, c))
                who.append(w[:5])
                cosine.append(c[:5])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(w) for w in who])]).astype(np.int32))
            who = np.concatenate(who) if who else np.zeros(0, np.int64)
            values = (model.index.ids[who], model.index.toxic[who].astype(np.int32), np.concatenate(cosine) if cosine else np.zeros(0))
            near = pa.StructArray.from_arrays([pa.array(v, t) for v, t in zip(values, kinds.values(), strict=True)], fields=[pa.field(c, t) for c, t in kinds.items()])
            out = {"doc_id": table["doc_id"], "score": pa.array(scores, pa.float64()), "evidence": pa.ListArray.from_arrays(ends, near)}
            yield from pa.table(out | {f"keep_{i}": table[f"keep_{i}"] for i in range(len(keep))}).to_batches()

    prepare(docs.sparkSession)
    schema = T._parse_datatype_string(f"doc_id long, score double, evidence {EVIDENCE}")
    for i, c in enumerate(keep):
        schema = schema.add(f"keep_{i}", docs.schema[c].dataType)
    columns = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)))
    out = columns.mapInArrow(rate, schema)
    return out.select("doc_id", "score", "evidence", *(out[f"keep_{i}"].alias(c) for i, c in enumerate(keep)))
