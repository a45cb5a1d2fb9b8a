"""N-gram Jaccard join of documents, and near-duplicate groups.

* A document's set holds its runs of ``gram`` words (all its words, if it has
  fewer). Documents with equal sets form a *class*; only classes are compared.
* *Banding*: rows and bands of MinHashes are chosen for the target recall at the
  threshold. Band hashes are shuffled with class numbers; those of one bucket
  are tied to its least member, so a bucket costs its members, not its pairs.
* Ties give candidate components. Each class sends its set once to its
  component (to a row and column of tiles of ``tile`` members, where one is
  larger), and there every pair is verified on the full sets. So links that no
  band shows are found too, if others connect the two.
* Links are counted and grouped where they are found; pairs are never rows.

Defined results: a text without words links to nothing and is a class of its
own; a null doc_id sorts last, after the largest long too; repeated rows are one class; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotspark.llm.graph import candidates, components, hot_floor, in_tiles, looked_up
from glotspark.llm.kernels import U64, WORD_BASE, Words, mix, prefix_hash, range_hash
from glotspark.llm.shared import checkpointed, release
from glotspark.llm.slabs import Slab, Slabs


def bands_for(threshold: float, recall: float, hashes: int = 200) -> tuple[int, int]:
    """Bands and rows a band: the most rows (fewest chance meetings) that reach
    the recall at the threshold with so many hashes."""
    for rows in range(20, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("no bands reach this recall with so few hashes")


def gram_sets(slab: Slab, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of each text, ascending, end to end; len+1 edges."""
    words = Words(slab.data, slab.offs)
    n = len(words)
    start = np.arange(n)
    row = np.repeat(np.arange(len(slab)), words.counts)
    short = words.counts < gram
    fit = np.where(short[row], start == words.first[row], start + gram <= words.first[row + 1]) if n else np.zeros(0, bool)
    start, row = start[fit], row[fit]
    key = range_hash(prefix_hash(words.hash, WORD_BASE), start, np.minimum(start + gram, words.first[row + 1]), WORD_BASE)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return key[new], np.searchsorted(row[new], np.arange(len(slab) + 1))


def _signed(no: int, slab: Slab, gram: int, bands: int, rows: int) -> pa.Table:
    key, edges = gram_sets(slab, gram)
    size = np.diff(edges)
    some = np.flatnonzero(size)
    sums = [np.zeros(len(slab), U64) for _ in range(2)]
    out = np.zeros((len(some), bands), U64)
    if len(some):
        at = edges[:-1][some]
        for i in range(2):
            sums[i][some] = np.add.reduceat(mix(key + U64(i * 2 + 1)), at)
        factor = mix(np.arange(1, bands * rows + 1, dtype=U64)) | U64(1)
        for b in range(bands):
            code = np.full(len(some), b + 1, U64)
            for r in range(rows):
                code = mix(code ^ np.minimum.reduceat(key * factor[b * rows + r], at))
            out[:, b] = code
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)), pa.array(out.ravel().view(np.int64)))
    n = len(slab)
    return pa.table({"slab": np.full(n, no, np.int64), "row": np.arange(n), "doc_id": slab.ids, "none": slab.table["doc_id"].is_null(), "n": size, "s1": sums[0].view(np.int64), "s2": sums[1].view(np.int64), "bands": lists})


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def verified(sets: list[np.ndarray], cols: list[np.ndarray] | None, threshold: float):
    """For each set, the numbers of those (among cols, or among the sets after
    it) with which its Jaccard similarity reaches the threshold."""
    others = sets if cols is None else cols
    size = np.array([len(x) for x in others])
    if not len(size):
        return
    _, code = np.unique(np.concatenate([*others, *(sets if cols is not None else [])]), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(size)])
    own = np.concatenate([[0], np.cumsum([len(x) for x in sets])]) + (edges[-1] if cols is not None else 0)
    mark = np.zeros(int(code.max(initial=0)) + 1, np.int32)
    flat = code[: edges[-1]]
    for i in range(len(sets)):
        low = i + 1 if cols is None else 0
        if low >= len(others):
            break
        mine = code[own[i] : own[i + 1]]
        mark[mine] = 1
        both = np.add.reduceat(mark[flat[edges[low] :]], edges[low:-1] - edges[low])
        mark[mine] = 0
        yield i, low + np.flatnonzero(both >= threshold * (size[low:] + len(mine) - both) - 1e-9)


FOUND = "a long, b long, n long, root long"


def _tile(table: pa.Table, threshold: float) -> pa.Table:
    """Rows (class, null, links, root) and, of a forest of the links, (a, b, null,
    null). A component in one tile is settled here: its classes get the least
    class of their group as root, and its forest isn't needed."""
    ids = table["cid"].to_numpy()
    side = table["side"].to_numpy()
    alone = table["tiles"][0].as_py() == 1
    sets = [np.frombuffer(x, U64) for x in table["grams"].to_pylist()]
    order = np.argsort(ids, kind="stable")
    first = [i for i in order if side[i] != 2]
    second = [i for i in order if side[i] == 2]
    place = {x: k for k, x in enumerate(order.tolist())}  # so that a root is the least class
    forest, links, a, b = _Forest(len(ids)), np.zeros(len(ids), np.int64), [], []
    pool = first if not second else second
    for i, found in verified([sets[i] for i in first], [sets[i] for i in second] if second else None, threshold):
        for j in found.tolist():
            x, y = first[i], pool[j]
            if forest.tie(place[x], place[y]) and not alone:
                a.append(ids[x])
                b.append(ids[y])
        links[first[i]] += len(found)
        np.add.at(links, np.array(pool)[found], 1)
    m = len(ids)
    roots = [int(ids[order[forest.root(place[x])]]) if alone else None for x in range(m)]
    return pa.table({"a": pa.array([*ids.tolist(), *a], pa.int64()), "b": pa.array([None] * m + b, pa.int64()), "n": pa.array(links.tolist() + [None] * len(a), pa.int64()), "root": pa.array(roots + [None] * len(a), pa.int64())})


class NearDuplicates:
    """Classes, links and groups of a table; see the module."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = 5, threshold: float = 0.8, recall: float = 0.9999, keep: tuple[str, ...] = (), tile: int = 2048):
        bands, rows = bands_for(threshold, recall)
        self.slabs = Slabs(docs, id_col, text_col, keep)
        self.docs, self.keep = docs, keep

        def sign(batches):
            for batch in batches:
                for no, payload in zip(batch["slab"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                    yield from _signed(no, Slab(payload), gram, bands, rows).to_batches()

        self.rows = checkpointed(self.slabs.rows.mapInArrow(sign, "slab long, row long, doc_id long, none boolean, n long, s1 long, s2 long, bands array<long>"))
        least = F.min(F.struct("doc_id", "none", "slab", "row")).alias("least")
        self.classes = self.rows.filter("n > 0").groupBy("s1", "s2", "n").agg(least, F.any_value("bands").alias("bands"))
        self.classes = checkpointed(self.classes.select("s1", "s2", "n", "least.*", "bands", F.monotonically_increasing_id().alias("cid")))
        self._link(gram, threshold, tile)

    def _link(self, gram: int, threshold: float, tile: int) -> None:
        found = candidates(self.classes.select("cid", F.explode("bands").alias("key")), tile)
        wanted = self.classes.select("cid", "slab", "row").join(found, F.col("cid") == F.col("node")).select("slab", "row", "cid", "root", "tiles", "t")

        def send(no: int, slab: Slab | None, want: pa.Table) -> pa.Table:
            some = want.select(["cid", "root", "tiles", "t"])
            grams = []
            if slab is not None:
                key, edges = gram_sets(slab, gram)
                grams = [key[edges[i] : edges[i + 1]].tobytes() for i in want["row"].to_pylist()]
            return (some if slab is not None else some.slice(0, 0)).append_column("grams", pa.array(grams, pa.binary()))

        sent = self.slabs.meet(wanted, send, "cid long, root long, tiles long, t long, grams binary")
        links = checkpointed(in_tiles(sent).groupBy("root", "i", "j").applyInArrow(lambda table: _tile(table, threshold), FOUND))
        release(self.slabs.spark)  # shuffle files with the sets
        self.links = links.filter("b is null").groupBy(F.col("a").alias("cid_")).agg(F.sum("n").alias("n_links"))
        spread = components(links.filter("b is not null").select("a", "b"))
        self.groups = spread.unionByName(links.filter("root is not null").select(F.col("a").alias("node"), "root"))

    def _with_groups(self) -> DataFrame:
        """Classes with the least document of their group."""
        joined = self.classes.select("cid", "s1", "s2", "n", "doc_id", "none", "slab", "row").join(self.groups, F.col("cid") == F.col("node"), "left").withColumn("group", F.coalesce("root", "cid")).drop("node", "root")
        first = joined.groupBy("group").agg(F.min(F.struct("doc_id", "none", "slab", "row")).alias("m"), F.count("*").alias("d")).withColumnRenamed("group", "k")
        return looked_up(joined, "group", "cid", first, hot_floor(self.classes.count())).withColumnRenamed("m", "first")

    def table(self) -> DataFrame:
        """Per row: doc_id, class_id (least doc_id with an equal set), n_links (of
        its class to other classes) and group_id (least doc_id of its group)."""
        classes = self._with_groups().join(self.links, F.col("cid") == F.col("cid_"), "left")
        classes = classes.select(F.col("s1").alias("k1"), F.col("s2").alias("k2"), F.col("n").alias("k3"), F.struct("doc_id", "none").alias("class"), F.struct("first.doc_id", "first.none").alias("group"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
        joined = self.rows.join(classes, (F.col("s1") == F.col("k1")) & (F.col("s2") == F.col("k2")) & (F.col("n") == F.col("k3")), "left")
        own = F.struct("doc_id", "none")
        shown = lambda c: F.when(~c["none"], c["doc_id"])
        return joined.select(shown(own).alias("doc_id"), shown(F.coalesce("class", own)).alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), shown(F.coalesce("group", own)).alias("group_id"))

    def first_of_each(self) -> DataFrame:
        """The rows of documents that come first in their group, with doc_id, text
        and the columns named in keep; a text without words stays."""
        firsts = self._with_groups().select("first.slab", "first.row").distinct()
        rows = firsts.unionByName(self.rows.filter("n = 0").select("slab", "row"))
        names = ["doc_id", "text", *(f"keep_{i}" for i in range(len(self.keep)))]
        schema = T._parse_datatype_string("doc_id long, text string")
        for i, c in enumerate(self.keep):
            schema = schema.add(f"keep_{i}", self.docs.schema[c].dataType)
        empty = pa.table({"x": [0]}).slice(0, 0)

        def take(no: int, slab: Slab | None, want: pa.Table) -> pa.Table:
            if slab is None:
                return empty
            return slab.table.select(names).take(want["row"])

        out = self.slabs.meet(rows, take, schema)
        return out.select("doc_id", "text", *(out[f"keep_{i}"].alias(c) for i, c in enumerate(self.keep)))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """See NearDuplicates.table."""
    return NearDuplicates(docs, **options).table()
