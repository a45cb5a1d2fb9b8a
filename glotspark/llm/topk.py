"""Exact top-k search by inner product over norm-sorted blocks.

* Vectors become integers, floor(scale * x), and stand by descending length in
  blocks of bounded size.
* An orthogonal rotation from the singular vectors of the first block (the
  longest vectors) moves most of the length into the first coordinates. Any
  rotation gives exact results; a good one prunes more.
* Each query starts with its k-th best score in the first block. A block is sent
  to a block of queries only if |q| * |x| can still reach a query's bound
  (Cauchy-Schwarz). Inside, the prefix of vectors that are long enough is taken;
  the partial sum over the first rotated coordinates plus |rest of q| * |rest of
  x| bounds the score; what is left is scored exactly in integers.
* A block of queries is shared among stripes of blocks, so that few queries over
  many rows also run in parallel; each stripe goes by descending length and
  raises its bounds as it goes. The stripes' results are merged by rank.

Defined results: vectors that are null or hold null or non-finite components
take no part; shorter vectors are filled up with zeros; repeated rows are rows
of their own (a query never meets its own row, but its copies); a null vec_id is
no query and comes last among ties; scores beyond a long stop at its limits; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from glotspark.llm.kernels import NULL_ID
from glotspark.llm.shared import checkpointed

PAIRS_AT_ONCE = 1 << 14
PARTITION_ROWS, BLOCK_CELLS, QUERY_BLOCK, STRIPE_BLOCKS = 65536, 1 << 19, 1024, 16
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products of integer matrices (given as doubles)."""
    if not len(a):
        return np.zeros(0, np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)]
    return np.array([min(max(x, int(LOW)), int(HIGH)) for x in whole], np.int64)


class Block:
    """Vectors by descending length. row: a number for each, unique in the table."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, x: np.ndarray):
        self.ids, self.row, self.x = ids, row, x
        self.norm = np.sqrt(np.einsum("ij,ij->i", x, x))

    def pack(self) -> bytes:
        small = np.abs(self.x).max(initial=0) < 2**31
        return pickle.dumps((self.ids, self.row, self.x.astype(np.int32) if small else self.x), 5)

    @classmethod
    def unpack(cls, payload: bytes) -> Block:
        ids, row, x = pickle.loads(payload)
        return cls(ids, row, x.astype(np.float64))

    def take(self, at) -> Block:
        return Block(self.ids[at], self.row[at], self.x[at])


def rotation(x: np.ndarray) -> np.ndarray:
    if not len(x):
        return np.eye(x.shape[1])
    scaled = x / max(1.0, float(np.abs(x).max()))
    return np.linalg.eigh(scaled.T @ scaled)[1][:, ::-1]


class Best:
    """The k best of each query so far."""

    def __init__(self, queries: Block, k: int, turn: np.ndarray, head: int):
        self.q, self.k, self.turn, self.head = queries, k, turn, head
        self.y = queries.x @ turn
        self.rest = np.sqrt(np.einsum("ij,ij->i", self.y[:, head:], self.y[:, head:]))
        self.bound = np.full(len(queries.ids), -np.inf)
        self.who = np.zeros(0, np.int64)
        self.ids, self.score = self.who, self.who

    def meet(self, block: Block) -> None:
        if not len(block.ids):
            return
        reach = self.q.norm * block.norm[0] * (1 + 1e-9) + 1
        for at in range(0, len(self.q.ids), 256):
            some = at + np.flatnonzero(reach[at : at + 256] >= self.bound[at : at + 256])
            if len(some):
                self._meet(some, block)

    def _meet(self, some: np.ndarray, block: Block) -> None:
        need = self.bound[some]
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(need > 1, (need - 1) / (self.q.norm[some] * (1 + 1e-9)), 0).min()
        n = int(np.searchsorted(-block.norm, -least, "right"))  # of the vectors, those that are long enough for some query
        y = block.x[:n] @ self.turn
        rest = np.sqrt(np.einsum("ij,ij->i", y[:, self.head :], y[:, self.head :]))
        slack = 1 + 1e-9 * np.outer(self.q.norm[some], block.norm[:n])
        upper = self.y[some, : self.head] @ y[:, : self.head].T + np.outer(self.rest[some], rest) + slack
        upper[self.q.row[some][:, None] == block.row[:n][None, :]] = -np.inf
        fresh = np.isneginf(need)
        if fresh.any() and n > 4 * self.k:  # a first bound: the k-th of the scores that look best
            f = np.flatnonzero(fresh)
            near = np.argpartition(-upper[f], self.k, axis=1)[:, : self.k]
            flat = exact_scores(np.repeat(self.q.x[some[f]], self.k, 0), block.x[near.ravel()]).reshape(len(f), self.k)
            own = (self.q.row[some[f]][:, None] == block.row[near]).any(1)
            need = need.copy()
            need[f] = np.where(own, -np.inf, flat.min(1))
        a, b = np.nonzero((upper >= need[:, None]) & ~np.isneginf(upper))
        parts = range(0, len(a), PAIRS_AT_ONCE)  # a weak bound leaves many pairs; their vectors are gathered in parts
        score = np.concatenate([np.zeros(0, np.int64), *(exact_scores(self.q.x[some[a[i : i + PAIRS_AT_ONCE]]], block.x[b[i : i + PAIRS_AT_ONCE]]) for i in parts)])
        pick = score >= need[a]
        self._merge(some[a[pick]], block.ids[b[pick]], score[pick])

    def _merge(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        who, ids, score = (np.concatenate(x) for x in ((self.who, who), (self.ids, ids), (self.score, score)))
        order = np.lexsort((ids, ~score, who))
        who, ids, score = who[order], ids[order], score[order]
        first = np.searchsorted(who, who, "left")
        keep = np.arange(len(who)) - first < self.k
        self.who, self.ids, self.score = who[keep], ids[keep], score[keep]
        last = np.searchsorted(self.who, np.arange(len(self.bound)), "right")
        full = last - np.searchsorted(self.who, np.arange(len(self.bound)), "left") == self.k
        self.bound[full] = self.score[last[full] - 1]


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """Queries: rows whose id is divisible by ``every``. Returns query_id, rank
    (from 1), vec_id and score."""
    spark = vectors.sparkSession
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = (
        vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        .filter(v.isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .select("id", F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"))
        .withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    )
    n, width = whole.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(1, width)
    block_rows = max(64, BLOCK_CELLS // width)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, math.ceil(n / PARTITION_ROWS), min(shuffle, math.ceil(n / 4096)))

    def blocks(batches):
        pid, at, held = TaskContext.get().partitionId() << 32, 0, []

        def made(rows):
            nonlocal at
            x = np.zeros((len(rows), width))
            for i, (_, v) in enumerate(rows):
                x[i, : len(v)] = v
            ids = np.array([NULL_ID if r is None else r for r, _ in rows], np.int64)
            b = Block(ids, pid + at + np.arange(len(rows)), x)
            at += len(rows)
            is_query = np.array([r is not None and r % every == 0 for r, _ in rows])
            yield pa.record_batch({"block": pa.array([int(b.row[0])], pa.int64()), "norm": pa.array([float(b.norm.max(initial=0))]), "queries": pa.array([int(is_query.sum())], pa.int64()), "payload": pa.array([b.pack()], pa.binary()), "asking": pa.array([b.take(is_query).pack()], pa.binary())})

        for batch in batches:
            held += zip(batch["id"].to_pylist(), (x.values.to_numpy() for x in batch["v"]), strict=True)
            while len(held) >= block_rows:
                yield from made(held[:block_rows])
                held = held[block_rows:]
        if held:
            yield from made(held)

    order = (F.col("norm2").desc(), F.col("id").asc_nulls_last())
    laid = whole.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "v")
    laid = checkpointed(laid.mapInArrow(blocks, "block long, norm double, queries long, payload binary, asking binary"))
    top = laid.orderBy("block").limit(1).select("payload").collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not top:
        return empty
    first = top[0]["payload"]
    asked = laid.agg(F.sum("queries")).first()[0]
    groups = max(1, math.ceil(asked / QUERY_BLOCK))
    turn = rotation(Block.unpack(first).x)
    head = max(1, width // 4)
    shared_first = spark.sparkContext.broadcast((first, turn))  # one block: BLOCK_CELLS numbers at most, or 64 rows

    def gather(table: pa.Table) -> pa.Table:
        got = [Block.unpack(x) for x in table["asking"].to_pylist()]
        ids, row, x = (np.concatenate([getattr(b, c) for b in got]) for c in ("ids", "row", "x"))
        payload, turn = shared_first.value
        longest = Block.unpack(payload)
        out = {"asker": [], "ratio": [], "bounds": [], "asking": []}
        for at in range(0, len(ids), QUERY_BLOCK):
            q = Block(*(y[at : at + QUERY_BLOCK] for y in (ids, row, x)))
            best = Best(q, k, turn, head)
            best.meet(longest)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(best.bound > 1, (best.bound - 1) / (q.norm * (1 + 1e-9)), 0)
            out["asker"].append(int(q.row[0]))
            out["ratio"].append(float(ratio.min()))
            out["bounds"].append(best.bound.tobytes())
            out["asking"].append(q.pack())
        return pa.table({c: pa.array(out[c], t) for c, t in (("asker", pa.int64()), ("ratio", pa.float64()), ("bounds", pa.binary()), ("asking", pa.binary()))})

    askers = laid.filter("queries > 0").select("asking", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g")).groupBy("g").applyInArrow(gather, "asker long, ratio double, bounds binary, asking binary")
    askers = checkpointed(askers)
    ratios = askers.select("asker", "ratio").collect()  # two numbers for each QUERY_BLOCK queries or so: 16 bytes for 100,000 vectors
    if not ratios:
        return empty
    stripes = max(math.ceil(2 * shuffle / len(ratios)), math.ceil(laid.count() / STRIPE_BLOCKS))
    reach = F.broadcast(spark.createDataFrame([tuple(r) for r in ratios], "asker long, ratio double"))
    sent = laid.select("block", "norm", "payload", F.pmod(F.xxhash64("block"), F.lit(stripes)).alias("stripe"))
    sent = sent.join(reach, reach["ratio"] <= sent["norm"] * (1 + 1e-9)).select("asker", "stripe", "block", "payload")

    def search(table: pa.Table, others: pa.Table) -> pa.Table:
        payload, turn = shared_first.value
        rows = {c: [] for c in ("asker_row", "query_id", "vec_id", "score")}
        for i in range(table.num_rows):
            q = Block.unpack(table["asking"][i].as_py())
            best = Best(q, k, turn, head)
            best.bound = np.frombuffer(table["bounds"][i].as_py(), np.float64).copy()
            for j in np.argsort(others["block"].to_numpy(), kind="stable").tolist():
                best.meet(Block.unpack(others["payload"][j].as_py()))
            rows["asker_row"].append(q.row[best.who])
            rows["query_id"].append(q.ids[best.who])
            rows["vec_id"].append(best.ids)
            rows["score"].append(best.score)
        out = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in rows.items()}
        vec = pa.array(out["vec_id"], pa.int64(), mask=out["vec_id"] == NULL_ID)
        return pa.table({"asker_row": out["asker_row"], "query_id": out["query_id"], "vec_id": vec, "score": out["score"]})

    striped = askers.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)).cast("array<long>")))
    found = striped.groupBy("asker", "stripe").cogroup(sent.groupBy("asker", "stripe")).applyInArrow(search, "asker_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("asker_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
