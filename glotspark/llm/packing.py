"""Packing: documents as tokens, cut into pieces that fill sequences.

A document's pieces of full length fill a sequence each, where they are made.
What is left of it (one piece, less than a sequence) is packed by first-fit
decreasing: by descending length, each into the first sequence with room. A
tournament tree over the room in each sequence finds that one in logarithmic
time. Groups of about ``group_size`` documents, drawn by a seeded hash, are
packed independently, so a task holds one group at a time whatever the size of
the input; a group leaves about one sequence partly filled.

Defined results: a null text is empty and gives the end token alone; repeated
rows are documents of their own; an empty table gives an empty result; other
columns are ignored. Runs over the same partitions agree.
"""

from __future__ import annotations

import itertools
import math
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.llm.kernels import BYTE_BASE, BYTE_CODES, U64, Words, in_slabs, prefix_hash, range_hash, text_bytes
from glotspark.llm.shared import checkpointed, prepare

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, alone long, repeat long"
FILLED = 1 << 62
LOWER = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
LOWERED = np.frombuffer(LOWER, np.uint8)
STOP, PLAIN = np.zeros(256, bool), np.zeros(256, bool)
STOP[[ord("."), ord(",")]] = True
PLAIN[48:58] = PLAIN[97:123] = True


class _Memo:
    """Ids of words by the words' hashes, in arrays."""

    def __init__(self):
        self.keys, self.at, self.size, self.pool = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key whether it is there, and its place."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.keys[place] == keys, place

    def add(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray, pool: np.ndarray) -> None:
        """Words that aren't there yet, by ascending key, with their ids in a pool."""
        place = np.searchsorted(self.keys, keys)
        self.at = np.insert(self.at, place, len(self.pool) + np.cumsum(size) - size)
        self.pool = np.concatenate([self.pool, pool[ranges(at, size)]])
        self.keys, self.size = np.insert(self.keys, place, keys), np.insert(self.size, place, size)


def ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers from low to low + size - 1, one range after the other."""
    return np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Encoder:
    """Ids by a tokenizer that lowers case and drops white space, so that what
    stands between blanks can be encoded by itself and remembered.

    The distinct words of a slab are looked up by their 64-bit hashes. Words of
    letters are encoded many at a time: of a word's tokens only the last has the
    suffix for word ends. A full stop or comma after a letter or digit is a token
    of its own. Two generations of words are remembered, at most ``2 * room`` and
    what one slab adds; a word in use moves to the younger one.
    """

    def __init__(self, path: str, room: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(path), room
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.special = [t.content.encode().translate(LOWER) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young, self.old = _Memo(), _Memo()

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, end to end, and how many each has."""
        ids, sizes = [], []
        for at in range(0, len(words), 256):
            some = words[at : at + 256]
            got = self._alone([" ".join(some)])[0]
            ends = np.flatnonzero(self.last[got]) + 1
            if len(ends) == len(some) and ends[-1] == len(got):
                ids.append(got)
                sizes.append(np.diff(ends, prepend=0))
            else:
                each = self._alone(some)
                ids += each
                sizes.append(np.array([len(x) for x in each]))
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of the ids of each word in a pool."""
        letters = np.array([w.isalpha() for w in words], bool)
        pool, sizes = self._words([w for w, x in zip(words, letters, strict=True) if x])
        others = self._alone([w for w, x in zip(words, letters, strict=True) if not x])
        size = np.zeros(len(words), np.int64)
        size[letters], size[~letters] = sizes, [len(x) for x in others]
        at = np.zeros(len(words), np.int64)
        at[letters] = np.cumsum(sizes) - sizes
        at[~letters] = len(pool) + np.cumsum(size[~letters]) - size[~letters]
        return at, size, np.concatenate([pool, *others])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slab of texts end to end, and len+1 offsets of the texts."""
        as_given, data = data, LOWERED[data]
        words = Words(data, offs, hashed=False)
        start, end = words.start, words.end
        if not len(start):
            return np.zeros(0, "<u4"), np.zeros(len(offs), np.int64)
        stopped = np.flatnonzero((end - start > 1) & STOP[data[end - 1]] & PLAIN[data[np.maximum(end - 2, 0)]])
        cut_start, cut_end = np.concatenate([start, end[stopped] - 1]), np.concatenate([end, end[stopped]])
        cut_end[stopped] -= 1
        order = np.argsort(cut_start, kind="stable")
        start, end = cut_start[order], cut_end[order]
        key = range_hash(prefix_hash(BYTE_CODES[data], BYTE_BASE), start, end, BYTE_BASE, data)
        keys, first, of = np.unique(key, return_index=True, return_inverse=True)
        young, place_young = self.young.find(keys)
        old, place_old = self.old.find(keys)
        old &= ~young
        new = np.flatnonzero(~young & ~old)
        raw = data.tobytes()
        at_new, size_new, pool_new = self._encoded([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)])
        at, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        before = 0
        for memo, hit, place in ((self.young, young, place_young), (self.old, old, place_old)):
            at[hit], size[hit] = memo.at[place[hit]] + before, memo.size[place[hit]]
            before += len(memo.pool)
        at[new], size[new] = at_new + before, size_new
        pool = np.concatenate([self.young.pool, self.old.pool, pool_new])
        kept = old.copy()
        kept[new[end[first[new]] - start[first[new]] <= 64]] = True
        self.young.add(keys[kept], at[kept], size[kept], pool)
        if len(self.young.keys) > self.room:
            self.young, self.old = _Memo(), self.young
        ids = pool[ranges(at[of], size[of])]
        edges = np.concatenate([[0], np.cumsum(size[of])])[np.searchsorted(start, offs)]
        return self._with_specials(as_given, raw, offs, ids, edges)

    def _with_specials(self, as_given: np.ndarray, raw: bytes, offs: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts that spell a special token are encoded whole."""
        if not any(s in raw for s in self.special):
            return ids, edges
        each = [ids[a:b] for a, b in itertools.pairwise(edges.tolist())]
        for i, (a, b) in enumerate(itertools.pairwise(offs.tolist())):
            if any(s in raw[a:b] for s in self.special):
                each[i] = self._alone([as_given[a:b].tobytes().decode("utf-8", "replace")])[0]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])


_encoders: dict[str, Encoder] = {}


def token_ids(data: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path].encode(data, offs)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its sequence and its offset there."""
    n = len(lengths)
    size = 1 << max(1, (n - 1).bit_length()) if n > 1 else 2
    room = [capacity] * (2 * size)  # a node: the most room in a sequence below it
    which, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        k = 1
        while k < size:
            k *= 2
            if room[k] < need:
                k += 1
        which[i], offset[i] = k - size, capacity - room[k]
        room[k] -= need
        while k > 1:
            k //= 2
            most = max(room[2 * k], room[2 * k + 1])
            if room[k] == most:
                break
            room[k] = most
    return which, offset


def padded(length: int, capacity: int) -> int:
    """The stored length of a sequence: a power of two stays as it is."""
    return length if length & (length - 1) == 0 else capacity


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document with its end token.
    alone: for a piece that fills a sequence, a number for it; else null.
    repeat: how many documents with an equal last piece the task has met before."""

    def cut(batches) -> Iterator[pa.RecordBatch]:
        end, step = np.array([end_id], "<u4").tobytes(), capacity * 4
        seen: Counter = Counter()
        filled = FILLED + (TaskContext.get().partitionId() << 32)
        for table in in_slabs(batches, "text", 2 << 20):
            rows = []
            ids, edges = token_ids(*text_bytes(table["text"]), tokenizer)
            raw, bounds = ids.tobytes(), (edges * 4).tolist()
            for i, doc_id in enumerate(table["doc_id"].to_pylist()):
                own = raw[bounds[i] : bounds[i + 1]] + end
                for a in range(0, len(own), step):
                    piece = own[a : a + step]
                    crc, alone, repeat = zlib.crc32(piece), None, None
                    if len(piece) == step:
                        alone, filled = filled, filled + 1
                    else:
                        key = hash((doc_id, a, crc))
                        repeat = seen[key]
                        seen[key] += 1
                    rows.append((doc_id, a // 4, len(piece) // 4, crc, len(own) // 4, alone, repeat))
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.record_batch({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*rows, strict=True), strict=True)})

    prepare(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 2, group_size: int = 4096, seed: int = 1) -> DataFrame:
    """Packs all documents. Returns per piece: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, sequence_length and padded_length."""
    pieces = checkpointed(tokenized(docs, tokenizer, id_col, text_col, capacity, end_id))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rest = pieces.filter("alone is null")
    groups = max(1, math.ceil(rest.count() / group_size))
    keyed = rest.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "doc_tokens", "ids_crc32", "repeat"), F.lit(groups)))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "repeat")])
        which, offset = first_fit_decreasing(table["length"].to_numpy(), capacity)
        used = np.bincount(which, weights=table["length"].to_numpy()).astype(np.int64)[which]
        stored = np.where(used & (used - 1) == 0, used, capacity)
        out = table.select(columns)
        for name, values in (("sequence_id", (table["group"].to_numpy() << 32) + which), ("offset", offset), ("sequence_length", used), ("padded_length", stored)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, padded_length long"
    size = F.lit(capacity).cast("long")
    full = pieces.filter("alone is not null").select(*columns, F.col("alone").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), size.alias("sequence_length"), size.alias("padded_length"))
    return keyed.groupBy("group").applyInArrow(fill, schema).unionByName(full)
