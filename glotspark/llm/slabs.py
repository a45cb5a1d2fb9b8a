"""Slabs: the texts of a table as compressed columnar blocks, and exchanges of
hashed keys between them.

Operators that ask, of millions of short ranges of text, which also occur
elsewhere need a key for each range but not a row. Here the table is first laid
out as slabs of a few MB, hash partitioned and checkpointed. A *round* then
sends, from each slab, every distinct key once (sorted, packed in a binary for
each range of keys) to the task that owns that range, which answers with one
bit a key (and a document for the few keys that met the other role). Keys that occur very often are therefore combined before the
shuffle: a key reaches its owner at most once from each slab, so no common
passage, line or group of copies makes one task grow. Answers are
checkpointed, and meet their slab without moving its text again.

A lost executor costs only its own tasks: slabs and answers are in the shared
checkpoint folder, the rest is ordinary lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark.llm import shared
from glotspark.llm.kernels import NULL_ID, U64, in_slabs, text_bytes, trim

SLAB_BYTES = 2 << 20
SLAB = "slab long, n_bytes long, payload binary"
SENT = "slab long, part int, kind int, keys binary, docs binary, roles binary"
ANSWER = "slab long, part int, kind int, bits binary, least binary"


def _frozen(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _thawed(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


class Slab:
    """Rows of the input, ordered by doc_id with nulls last. ids: doc_id, a null
    as the largest long. rank: dense rank of the id, equal for equal ids."""

    def __init__(self, payload: bytes):
        self.table = _thawed(payload)
        self.data, self.offs = text_bytes(self.table["text"])
        self.ids = self.table["doc_id"].fill_null(NULL_ID).to_numpy()
        self.rank = np.concatenate([[0], np.cumsum(np.diff(self.ids) != 0)])[: len(self.ids)]

    def __len__(self) -> int:
        return len(self.ids)


class Keys:
    """Distinct keys of a slab in ascending order, each with its earliest
    document. of: for each item, the number of its key.

    An item's document is a number of a row; rows stand in order of doc_id, so
    the first item of a key in that order has the least one."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, roles: np.ndarray | None = None):
        n = len(keys)
        self.order = np.argsort(keys, kind="stable") if roles is None else np.lexsort((roles, keys))
        ordered = keys[self.order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if roles is not None:
            new[1:] |= roles[self.order][1:] != roles[self.order][:-1]
        self.at = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.of = np.empty(n, np.int64)
        self.of[self.order] = self.group
        self.keys = ordered[self.at]
        self.roles = None if roles is None else roles[self.order][self.at]
        self.rows = np.minimum.reduceat(rows[self.order], self.at) if n else np.zeros(0, np.int64)
        self.counts = np.diff(np.append(self.at, n))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range of keys that a key belongs to: ascending with the key."""
    return ((keys >> U64(32)) * U64(parts)) >> U64(32)


def blobs(slab_no: int, kind: int, keys: Keys, parts: int, ids: np.ndarray | None) -> Iterator[dict]:
    """Rows of SENT. Without ids only the low half of each key is sent."""
    owner = part_of(keys.keys, parts).astype(np.int64)
    edges = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = keys.keys[a:b]
        row = {"slab": slab_no, "part": int(owner[a]), "kind": kind, "roles": None if keys.roles is None else keys.roles[a:b].astype(np.uint8).tobytes()}
        if ids is None:
            yield row | {"keys": part.astype(np.uint32).tobytes(), "docs": None}
        else:
            table, where = np.unique(ids[keys.rows[a:b]], return_inverse=True)
            wide = where.astype(np.uint16 if len(table) <= 1 << 16 else np.uint32)
            yield row | {"keys": part.tobytes(), "docs": np.array([len(table)], np.int64).tobytes() + table.tobytes() + wide.tobytes()}


def _docs(blob: bytes, n: int) -> np.ndarray:
    m = int(np.frombuffer(blob, np.int64, 1)[0])
    table = np.frombuffer(blob, np.int64, m, 8)
    return table[np.frombuffer(blob, np.uint16 if m <= 1 << 16 else np.uint32, n, 8 + 8 * m)]


def sent_table(rows: list[dict]) -> pa.Table:
    types = {"slab": pa.int64(), "part": pa.int32(), "kind": pa.int32(), "keys": pa.binary(), "docs": pa.binary(), "roles": pa.binary()}
    return pa.table({k: pa.array([r[k] for r in rows], t) for k, t in types.items()})


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _resolved(table: pa.Table) -> pa.Table:
    """What the owner of a range of keys answers, one bit a key sent.

    kind even: the key came from two slabs at least (with roles: two different
    low bytes of role hashes came with it). kind odd: another slab sent the key
    with a strictly smaller document. With roles a slab's key stands for lines of
    several documents, so the bit says only that some slab sent the key in the
    other role, and ``least`` gives its least document for each bit set.
    """
    out = {"slab": [], "part": [], "kind": [], "bits": [], "least": []}
    for kind in pc.unique(table["kind"]).to_pylist():
        some = table.filter(pc.equal(table["kind"], kind))
        raw = some["keys"].to_pylist()
        width = np.uint64 if kind % 2 else np.uint32
        parts = [np.frombuffer(x, width) for x in raw]
        sizes = [len(x) for x in parts]
        keys = np.concatenate(parts)
        roles = some["roles"].to_pylist()
        others = None
        if kind % 2 == 0:
            order, at, group = _groups(keys)
            said = np.empty(len(keys), bool)
            said[order] = (np.diff(np.append(at, len(keys))) > 1)[group]
        else:
            docs = np.concatenate([_docs(x, n) for x, n in zip(some["docs"].to_pylist(), sizes, strict=True)])
            order, at, group = _groups(keys)
            said = np.empty(len(keys), bool)
            if roles[0] is None:
                said[order] = np.minimum.reduceat(docs[order], at)[group] < docs[order]
            else:
                role = np.concatenate([np.frombuffer(x, np.uint8) for x in roles])[order]
                by = [np.minimum.reduceat(np.where(role == r, docs[order], NULL_ID), at) for r in (0, 1)]
                others = np.empty(len(keys), np.int64)
                others[order] = np.where(role == 0, by[1][group], by[0][group])
                said = others != NULL_ID  # a null id is before no other
        edges = np.concatenate([[0], np.cumsum(sizes)])
        out["slab"] += some["slab"].to_pylist()
        out["part"] += some["part"].to_pylist()
        out["kind"] += [kind] * len(sizes)
        out["bits"] += [np.packbits(said[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        out["least"] += [None if others is None else others[a:b][said[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"slab": pa.array(out["slab"], pa.int64()), "part": pa.array(out["part"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "bits": pa.array(out["bits"], pa.binary()), "least": pa.array(out["least"], pa.binary())})


class Answers:
    """The answers that a slab got, by kind."""

    def __init__(self, table: pa.Table, parts: int):
        self.parts, self.bits, self.docs = parts, {}, {}
        for kind, part, bits, least in zip(*(table[c].to_pylist() for c in ("kind", "part", "bits", "least")), strict=True):
            self.bits[kind, part] = bits
            self.docs[kind, part] = least

    def of(self, kind: int, keys: Keys) -> np.ndarray:
        out = np.zeros(len(keys.keys), bool)
        owner = part_of(keys.keys, self.parts).astype(np.int64)
        edges = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            out[a:b] = np.unpackbits(np.frombuffer(self.bits[kind, int(owner[a])], np.uint8), count=b - a)
        return out

    def least(self, kind: int, keys: Keys) -> np.ndarray:
        """For keys with roles: the least document that has the key in the other
        role, in any slab; the largest long where there is none."""
        out = np.full(len(keys.keys), NULL_ID)
        some = np.flatnonzero(self.of(kind, keys))
        owner = part_of(keys.keys[some], self.parts).astype(np.int64)
        for part in np.unique(owner).tolist():
            out[some[owner == part]] = np.frombuffer(self.docs[kind, part], np.int64)
        return out


class Slabs:
    """A table of documents laid out as slabs.

    docs: any table; id_col and text_col become ``doc_id`` (long) and ``text``.
    keep: further columns to carry, under names of their own inside the slab.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), slab_bytes: int = SLAB_BYTES):
        self.spark: SparkSession = docs.sparkSession
        shared.prepare(self.spark)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        columns = [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")]
        columns += [F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)]

        def pack(batches):
            at = TaskContext.get().partitionId() << 32
            for k, table in enumerate(in_slabs(batches, "text", slab_bytes)):
                table = table.take(pc.sort_indices(table["doc_id"], null_placement="at_end"))
                yield pa.record_batch({"slab": pa.array([at + k], pa.int64()), "n_bytes": pa.array([int(text_bytes(table["text"])[1][-1])], pa.int64()), "payload": pa.array([_frozen(table)], pa.binary())})

        self.rows = shared.laid_out(docs.select(*columns).mapInArrow(pack, SLAB), "slab")
        shared.release(self.spark)
        self.parts = 4 * n
        self.answers: DataFrame | None = None

    def _with_answers(self, work: Callable, schema: str) -> DataFrame:
        """work(number, slab, answers) gives a table; slabs aren't moved."""
        parts = self.parts
        if self.answers is None:

            def alone(batches):
                for batch in batches:
                    for no, payload in zip(batch["slab"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                        yield from work(no, Slab(payload), None).to_batches()
                trim()

            return self.rows.mapInArrow(alone, schema)

        empty = pa.table({"x": [0]}).slice(0, 0)

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            made = [work(left["slab"][0].as_py(), Slab(left["payload"][i].as_py()), Answers(right, parts)) for i in range(left.num_rows)]
            trim()
            return pa.concat_tables(made) if made else empty

        return self.rows.groupBy("slab").cogroup(self.answers.groupBy("slab")).applyInArrow(both, schema)

    def buckets(self, n: int) -> list[tuple[int, int]]:
        """n ranges of parts, for rounds that take one bucket of keys at a time."""
        edges = [self.parts * i // n for i in range(n + 1)]
        return list(zip(edges[:-1], edges[1:], strict=True))

    def ask(self, work: Callable) -> None:
        """A round: work(number, slab, answers, parts) yields rows of SENT. When
        it has ended, its shuffle files can go."""
        parts = self.parts
        sent = self._with_answers(lambda no, slab, answers: sent_table(list(work(no, slab, answers, parts))), SENT)
        got = shared.checkpointed(sent.groupBy("part").applyInArrow(_resolved, ANSWER))
        self.answers = got if self.answers is None else self.answers.unionByName(got)
        del sent, got
        shared.release(self.spark)

    def meet(self, rows: DataFrame, work: Callable, schema) -> DataFrame:
        """work(number, slab, rows of that slab) gives a table; rows have a
        column slab. Slabs aren't moved; those without rows give nothing."""

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return work(0, None, right)
            return work(left["slab"][0].as_py(), Slab(left["payload"][0].as_py()), right)

        return self.rows.groupBy("slab").cogroup(rows.groupBy("slab")).applyInArrow(both, schema)

    def finish(self, work: Callable, schema: str) -> DataFrame:
        """work(number, slab, answers) gives the result rows of a slab."""
        return self._with_answers(work, schema)
