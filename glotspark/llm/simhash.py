"""SimHash fingerprints, their search by permuted block tables, and a probe.

* A text's terms are its words. Each weighs (1 + log count) * IDF, rounded to a
  whole number of eighths; document frequencies are counted over all texts in a
  hashed table of fixed size. The bits of a term's hash vote with that weight, and
  the signs of the sums are the fingerprint's bits. Sums are exact, so that equal
  texts have equal fingerprints. A text without words has all bits 0.
* *Search*: two fingerprints that differ in at most ``radius`` bits agree in
  ``blocks - radius`` of ``blocks`` blocks at least. Each table permutes the
  bits so that one choice of that many blocks comes first, and looks up equal
  leading blocks; over all choices no pair within the radius is missed.
* *Probe*: each text is edited (its second half replaced by the beginning of the
  next document's) to show what a fingerprint makes of an edit.

Documents stand in descending order of doc_id, nulls last; of equal ids the
smaller text hash comes first. They are dealt in ranges of about equal bytes,
compressed; each range also gets the first document of the next one. Rows that
share a doc_id are cut by text hash where they are many; only rows that have id
and text in common stay together.

Defined results: a null text is empty; with one row the next document is the row
itself; an empty table gives an empty result; other columns are ignored. The least long as
a doc_id ranks with null.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.llm.gather import SUMS, packed, summed
from glotspark.llm.graph import hot_floor, in_tiles, looked_up, tiles
from glotspark.llm.kernels import BYTE_BASE, BYTE_CODES, U64, Words, in_slabs, mix, prefix_hash, range_hash, text_bytes
from glotspark.llm.shared import checkpointed, prepare
from glotspark.llm.slabs import _frozen, _thawed

BITS = 128
TABLE = 1 << 20
WEIGHT_STEP, MOST_WEIGHT, EXACT, BLOCK_TERMS = 8, 4095, 4096, 1 << 15
FIRST = np.iinfo(np.int64).min


def _row_terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct words of each text, by row."""
    row = np.repeat(np.arange(len(words.offs) - 1), words.counts)
    order = np.lexsort((words.hash, row))
    row, number = row[order], words.hash[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
    at = np.flatnonzero(new)
    return row[at], number[at], np.diff(np.append(at, len(row)))


class Weights:
    """Whole-number weights of terms: of a term that a text has so often,
    WEIGHT_STEP * (1 + log count) * IDF, rounded, from 1 to MOST_WEIGHT."""

    def __init__(self, documents: int, frequency: np.ndarray):
        self.idf = np.log((documents + 1) / (frequency + 1)) + 0.1

    def of(self, number: np.ndarray, count: np.ndarray) -> np.ndarray:
        weight = np.rint(WEIGHT_STEP * (1 + np.log(count)) * self.idf[(number & U64(TABLE - 1)).astype(np.int64)])
        return np.clip(weight, 1, MOST_WEIGHT).astype(np.float32)


def _votes(number: np.ndarray) -> np.ndarray:
    """For each term its bits as 0 and 1."""
    code = np.stack([mix(number + U64(2 * k + 1)) for k in range(BITS // 64)], 1)
    return np.unpackbits(code.view(np.uint8).reshape(len(number), BITS // 8), axis=1).astype(np.float32)


def fingerprints(data: np.ndarray, offs: np.ndarray, weights: Weights) -> np.ndarray:
    """Per text BITS / 8 bytes. Weights are whole numbers and no sum of EXACT
    terms reaches 2**24, so float32 adds them exactly, in whatever order and
    company: equal texts have equal fingerprints."""
    out = np.zeros((len(offs) - 1, BITS // 8), np.uint8)
    row, number, count = _row_terms(Words(data, offs))
    weight = weights.of(number, count)
    rows = row[np.flatnonzero(np.diff(row, prepend=-1))]
    edges = np.append(np.searchsorted(row, rows), len(row)).tolist()
    at = 0
    while at < len(rows):  # about BLOCK_TERMS terms of whole rows, or one longer row
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOCK_TERMS, "right")) - 1)
        votes = np.zeros((to - at, BITS))
        for low in range(edges[at], edges[to], BLOCK_TERMS):
            high = min(edges[to], low + BLOCK_TERMS)
            bits = _votes(number[low:high])
            for i in range(at, to):
                for a in range(max(low, edges[i]), min(high, edges[i + 1]), EXACT):
                    b = min(high, edges[i + 1], a + EXACT)
                    votes[i - at] += weight[a:b] @ bits[a - low : b - low]
        total = np.add.reduceat(weight[edges[at] : edges[to]], np.array(edges[at:to]) - edges[at], dtype=np.float64)
        out[rows[at:to]] = np.packbits(2 * votes > total[:, None], axis=1)
        at = to
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b).sum(1) / BITS


def _text_key(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(BYTE_CODES[data], BYTE_BASE), offs[:-1], offs[1:], BYTE_BASE, data).view(np.int64)


def _ordered(table: pa.Table) -> pa.Table:
    """By descending id, then text key."""
    ids = table["doc_id"].fill_null(FIRST).to_numpy()
    return table.take(pa.array(np.lexsort((_text_key(*text_bytes(table["text"])), ~ids))))


class _Ranges:
    """Ranges of documents in their order, between cut points (id, text key). An
    id that many rows share is cut by its text keys too."""

    def __init__(self, cuts: list[int]):
        """cuts: quantiles of the ids, ascending; an id with many rows repeats."""
        points: list[tuple[int, int]] = []
        self.heavy = []
        for c, n in sorted(Counter(cuts).items(), reverse=True):
            points.append((c, FIRST))
            if n > 1:
                self.heavy.append(c)
                points += [(c, FIRST + (2**64 * i) // n) for i in range(1, n)]
                if c > FIRST:
                    points.append((c - 1, FIRST))
        points = sorted(set(points), key=lambda p: (-p[0], p[1]))
        self.ids = ~np.array([p[0] for p in points], np.int64)
        self.keys = np.array([p[1] for p in points], np.int64)
        self.n = len(points) + 1

    def of(self, ids: np.ndarray, keys: np.ndarray | None) -> np.ndarray:
        """keys: needed only where a heavy id occurs."""
        low, high = (np.searchsorted(self.ids, ~ids, side) for side in ("left", "right"))
        out = high.copy()
        for h in self.heavy:
            some = np.flatnonzero(ids == h)
            if len(some):
                a, b = low[some[0]], high[some[0]]
                out[some] = a + np.searchsorted(self.keys[a:b], keys[some], "right")
        return out

    def keys_for(self, table: pa.Table, ids: np.ndarray) -> np.ndarray | None:
        return _text_key(*text_bytes(table["text"])) if len(self.heavy) and np.isin(ids, self.heavy).any() else None


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].fill_null(FIRST).to_numpy()


def probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_chars, edited (the edited text's sha256), fingerprint
    and edited_fingerprint (hex), near_edited and near_next."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [i / (8 * parts) for i in range(1, 8 * parts)]
    cuts = docs.agg(F.percentile_approx(F.coalesce("doc_id", F.lit(FIRST)), by, 80 * max(parts, 125))).first()[0]  # eight numbers for each shuffle partition
    fine = _Ranges([int(c) for c in cuts or []])

    def heads(batches):
        top: dict[int, tuple[int, int]] = {}
        for table in in_slabs(batches, "text", 4 << 20) if fine.heavy else (pa.Table.from_batches([b]) for b in batches):
            ids = _ids(table)
            keys = fine.keys_for(table, ids) if fine.heavy else None
            p = fine.of(ids, keys)
            order = np.lexsort((~ids if keys is None else keys, ~ids, p))
            for i in order[np.flatnonzero(np.diff(p[order], prepend=-1))].tolist():
                mine = (~int(ids[i]), int(keys[i]) if int(ids[i]) in fine.heavy else FIRST)
                top[int(p[i])] = min(top.get(int(p[i]), mine), mine)
        yield pa.record_batch({"p": pa.array(list(top), pa.int32()), "id": pa.array([x for x, _ in top.values()], pa.int64()), "key": pa.array([x for _, x in top.values()], pa.int64())})

    tops = docs.select("doc_id", *(["text"] if fine.heavy else [])).mapInArrow(heads, "p int, id long, key long").groupBy("p").agg(F.min(F.struct("id", "key")).alias("top"))
    tops = {r["p"]: (~r["top"]["id"], r["top"]["key"]) for r in tops.collect()}  # a row for each range

    def count(batches):
        terms, sizes = np.zeros(TABLE + 1, np.int64), np.zeros(fine.n, np.int64)
        for table in in_slabs(batches, "text", 2 << 20):
            data, offs = text_bytes(table["text"])
            terms[:TABLE] += np.bincount((_row_terms(Words(data, offs))[1] & U64(TABLE - 1)).astype(np.int64), minlength=TABLE)
            terms[TABLE] += len(table)
            ids = _ids(table)
            sizes += np.bincount(fine.of(ids, fine.keys_for(table, ids)), weights=np.diff(offs) + 100, minlength=fine.n).astype(np.int64)
        yield from packed({"terms": terms, "sizes": sizes}, TaskContext.get().partitionId())

    found = summed(docs.mapInArrow(count, SUMS))
    terms, sizes = found.get("terms", np.zeros(TABLE + 1, np.int64)), found.get("sizes", np.zeros(fine.n, np.int64))
    shared = spark.sparkContext.broadcast(pickle.dumps(Weights(int(terms[TABLE]), terms[:TABLE]), 5))  # TABLE numbers
    # ranges of about equal bytes: a new one begins where the sum passes a multiple
    begun = (np.cumsum(sizes) - sizes) // max(1 << 20, int(sizes.sum()) // parts)
    coarse = np.unique(begun, return_inverse=True)[1]
    firsts: dict[int, tuple[int, int]] = {}
    for p in sorted(tops):
        firsts.setdefault(int(coarse[p]), tops[p])
    before = {firsts[b]: a for a, b in itertools.pairwise(firsts)}  # the first document of each range, and the range before it

    def deal(batches):
        for table in in_slabs(batches, "text", 4 << 20):
            ids = _ids(table)
            keys = fine.keys_for(table, ids)
            p = coarse[fine.of(ids, keys)]
            for k in np.unique(p).tolist():
                yield pa.record_batch({"p": pa.array([k], pa.int32()), "next": pa.array([False]), "payload": pa.array([_frozen(table.filter(pa.array(p == k)))], pa.binary())})
            present = set(np.unique(ids).tolist())
            for (top, key), k in before.items():
                if top in present:
                    mine = ids == top if top not in fine.heavy else (ids == top) & (keys == key)
                    first = _ordered(table.filter(pa.array(mine))).slice(0, 1)
                    if len(first):
                        yield pa.record_batch({"p": pa.array([k], pa.int32()), "next": pa.array([True]), "payload": pa.array([_frozen(first)], pa.binary())})

    def rate(blobs: pa.Table) -> pa.Table:
        weights = pickle.loads(shared.value)
        tables = {flag: [_thawed(x) for x, f in zip(blobs["payload"].to_pylist(), blobs["next"].to_pylist(), strict=True) if f is flag] for flag in (False, True)}
        mine = _ordered(pa.concat_tables(tables[False]).combine_chunks())
        after = _ordered(pa.concat_tables(tables[True]).combine_chunks()).slice(0, 1) if tables[True] else mine.slice(len(mine) - 1)
        both = pa.concat_tables([mine, after]).combine_chunks()
        out = {c: [] for c in ("n_chars", "edited_sha256", "print", "edited", "next")}
        sizes = np.diff(text_bytes(mine["text"])[1])
        at = 0
        while at < len(mine):
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 2 << 20, "right")))
            some = both.slice(at, to - at + 1)
            texts = some["text"].to_pylist()
            edited = []
            for t, n in itertools.pairwise(texts):
                half = len(t) // 2
                edited.append(t[: len(t) - half] + n[:half])
                out["n_chars"].append(len(t))
                out["edited_sha256"].append(hashlib.sha256(edited[-1].encode("utf-8", "surrogatepass")).hexdigest())
            own = fingerprints(*text_bytes(some["text"]), weights)
            out["print"].append(own[:-1])
            out["next"].append(own[1:])
            out["edited"].append(fingerprints(*text_bytes(pa.array(edited, pa.large_string())), weights))
            at = to
        prints, edits, nexts = (np.concatenate(out[c]) for c in ("print", "edited", "next"))
        hexed = lambda x: pa.array([r.tobytes().hex() for r in x], pa.string())
        return pa.table({"doc_id": mine["doc_id"], "n_chars": pa.array(out["n_chars"], pa.int64()), "edited_sha256": pa.array(out["edited_sha256"], pa.string()), "fingerprint": hexed(prints), "edited_fingerprint": hexed(edits), "near_edited": likeness(prints, edits), "near_next": likeness(prints, nexts)})

    if firsts:  # the first document of all comes after the last
        before[firsts[min(firsts)]] = max(firsts)
    dealt = docs.mapInArrow(deal, "p int, next boolean, payload binary")
    return dealt.groupBy("p").applyInArrow(rate, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _table_keys(prints: np.ndarray, radius: int, blocks: int) -> np.ndarray:
    """Per fingerprint and table a key of the table's leading blocks. Two that
    differ in at most ``radius`` bits share a key in some table."""
    bits = np.unpackbits(prints, axis=1)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [np.packbits(bits[:, a:b], axis=1) for a, b in itertools.pairwise(edges)]
    codes = np.stack([range_hash_rows(p) for p in parts], 1)
    out = []
    for table, chosen in enumerate(itertools.combinations(range(blocks), blocks - radius)):
        key = np.full(len(prints), table + 1, U64)
        for b in chosen:
            key = mix(key ^ codes[:, b])
        out.append(key)
    return np.stack(out, 1)


def range_hash_rows(rows: np.ndarray) -> np.ndarray:
    """64 bits for each row of bytes."""
    out = np.zeros(len(rows), U64)
    for j in range(rows.shape[1]):
        out = mix(out * U64(257) + rows[:, j].astype(U64) + U64(1))
    return out


def _first_tables(radius: int, blocks: int) -> np.ndarray:
    """For each set of blocks that differ (as bits) the first table that has only
    blocks that agree; -1 where there is none."""
    chosen = [sum(1 << b for b in c) for c in itertools.combinations(range(blocks), blocks - radius)]
    return np.array([next((i for i, c in enumerate(chosen) if not c & differ), -1) for differ in range(1 << blocks)])


def _near_counts(table: pa.Table, radius: int, blocks: int, first: np.ndarray) -> pa.Table:
    """For each member of a bucket (or of two of its tiles) how many others are
    within the radius and share no earlier table with it."""
    ids, side, which = (table[c].to_numpy() for c in ("cid", "side", "which"))
    prints = np.frombuffer(b"".join(table["print"].to_pylist()), U64).reshape(len(ids), BITS // 64)
    rows, cols = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    n = np.zeros(len(ids), np.int64)
    edges = [BITS * i // blocks for i in range(blocks)]
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        apart = sum(np.bitwise_count(prints[some, k][:, None] ^ prints[cols, k][None, :]).astype(np.int64) for k in range(BITS // 64))
        a, b = np.nonzero((apart <= radius) & (some[:, None] != cols[None, :]))
        a, b = some[a], cols[b]
        bits = np.unpackbits((prints[a] ^ prints[b]).view(np.uint8).reshape(len(a), BITS // 8), axis=1)
        differ = np.bitwise_or.reduce((np.add.reduceat(bits, edges, axis=1) > 0).astype(np.int64) << np.arange(blocks), axis=1) if len(a) else a
        here = first[differ] == which[a]
        np.add.at(n, a[here], 1)
        if side.any():
            np.add.at(n, b[here], 1)
    return pa.table({"cid": ids, "n": n})


def search(prints: DataFrame, radius: int = 4, blocks: int = 6, tile: int = 4096) -> DataFrame:
    """prints: doc_id and fingerprint (hex). Returns for each distinct fingerprint
    class_id (its least doc_id) and n_near (how many other fingerprints differ in
    at most ``radius`` bits), by permuted block tables: exact, whatever the data.

    With blocks - radius leading blocks of BITS / blocks bits, chance meetings are
    rare (42 bits here). Members of a bucket are compared in its tiles; a pair
    counts in the first table that it shares, so it counts once."""
    if not 0 <= radius < blocks:
        raise ValueError("more blocks than the radius are needed")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")).withColumn("print", F.unhex("fingerprint"))
    distinct = checkpointed(distinct.withColumn("cid", F.monotonically_increasing_id()))
    first = _first_tables(radius, blocks)

    def keys(batches):
        for batch in batches:
            if batch.num_rows:
                found = _table_keys(np.frombuffer(b"".join(batch["print"].to_pylist()), np.uint8).reshape(-1, BITS // 8), radius, blocks)
                n, tables = found.shape
                of = pa.array(np.repeat(np.arange(n), tables))
                yield pa.record_batch({"cid": batch["cid"].take(of), "print": batch["print"].take(of), "which": pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), "key": pa.array(found.ravel().view(np.int64))})

    keyed = distinct.select("cid", "print").mapInArrow(keys, "cid long, print binary, which int, key long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("d")).filter("d > 1").select(F.col("key").alias("k"), F.col("d").alias("m"), "d")
    met = looked_up(keyed, "key", "cid", sizes, hot_floor(distinct.count() * math.comb(blocks, radius))).filter("m is not null")
    members = met.withColumn("tiles", tiles(F.col("m"), tile)).withColumn("t", F.pmod(F.xxhash64("cid"), "tiles")).drop("m")
    near = in_tiles(members).groupBy("key", "i", "j").applyInArrow(lambda t: _near_counts(t, radius, blocks, first), "cid long, n long")
    near = near.groupBy(F.col("cid").alias("c")).agg(F.sum("n").alias("n"))
    return distinct.join(near, F.col("cid") == F.col("c"), "left").select("fingerprint", "class_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_near"))
