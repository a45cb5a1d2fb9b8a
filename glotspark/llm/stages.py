"""Stages of the corpus pipeline: documents in, documents (or pieces) out.

For all: every row is a document of its own, also where rows repeat or share a
doc_id (the operators say what ties mean); a null or empty text is kept (the mix
takes no words of it, packing gives it the end token alone); columns besides
doc_id and text pass unchanged, whatever their names, but for n_chars, which
counts the new text; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotspark.llm import lines, mixing, near, packing, toxicity
from glotspark.llm.kernels import Words, trim
from glotspark.llm.queries import LEARNED
from glotspark.llm.shared import checkpointed
from glotspark.llm.slabs import Slab, Slabs

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _others(docs: DataFrame) -> tuple[str, ...]:
    """All columns but those that a stage makes anew."""
    return tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))


def _renamed(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...], list]:
    """docs with its columns but doc_id and text under names that no operator
    uses, those names, and expressions for the columns of docs."""
    names = {c: c if c in ("doc_id", "text") else f"column {i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    return plain, tuple(n for n in names.values() if n.startswith("column ")), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def _documents(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """rows with the columns of docs in their order; n_chars counts the new text."""
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, unchanged. The labels of the
    learning folds train the scores."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(LEARNED)
    model = toxicity.learn(docs, labels)
    plain, names, back = _renamed(docs)
    return toxicity.score(plain, model, keep=("text", *names)).filter("score < 0.5").select(*back)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines. One that loses every line with
    words goes; one that had none stays."""
    plain, names, back = _renamed(docs)
    return _documents(lines.line_dedup(plain, keep=names).filter("not emptied").select(*back), docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group, unchanged."""
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    first = near.NearDuplicates(docs, keep=keep).first_of_each()
    return first.select(*(F.col(f"`{c}`") for c in docs.columns))


def cut_text(raw: bytes, words: Words, row: int, spans: list[dict]) -> str:
    """A text reduced to ranges of words (first, end, times), as they stand in it
    with the white space between their words. Adjacent ranges run on; others are
    set apart by a line feed; a round for each time that a range is taken."""
    base, pieces = words.first[row], []
    for time in range(max((s["times"] for s in spans), default=0)):
        last = -1
        for s in spans:
            if s["times"] > time:
                if s["first"] == last:
                    pieces[-1][1] = s["end"]
                else:
                    pieces.append([s["first"], s["end"]])
                last = s["end"]
    return b"\n".join(raw[words.start[base + a] : words.end[base + b - 1]] for a, b in pieces).decode("utf-8", "replace")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; documents of which it takes nothing
    go, unless they have no words at all. Blocks have 256 words, fewer in small
    sources. Sizes and ranges are shuffled, texts stay in their slabs."""
    keep = _others(docs)
    slabs = Slabs(docs, "doc_id", "text", keep)
    source = f"keep_{keep.index('source')}"

    def measure(batches):
        for batch in batches:
            for no, payload in zip(batch["slab"].to_pylist(), batch["payload"].to_pylist(), strict=True):
                slab = Slab(payload)
                size = Words(slab.data, slab.offs, hashed=False).counts
                mark = [hashlib.md5(slab.data[a:b], usedforsecurity=False).hexdigest()[:16] for a, b in zip(slab.offs[:-1], slab.offs[1:], strict=True)]
                yield from pa.table({"slab": np.full(len(slab), no), "row": np.arange(len(slab)), "doc_id": slab.table["doc_id"], "source": slab.table[source], "size": size, "mark": mark}).to_batches()
            trim()

    sized = slabs.rows.mapInArrow(measure, "slab long, row long, doc_id long, source string, size long, mark string")
    mixed = mixing.mix(sized, size_col="size", mark_col="mark", keep=("slab", "row"), block=256, fine=16)
    wanted = mixed.filter("taken > 0 or size = 0").select("slab", "row", "spans")
    names = ["doc_id", *(f"keep_{i}" for i in range(len(keep)))]
    schema = T.StructType().add("doc_id", "long")
    for i, c in enumerate(keep):
        schema = schema.add(f"keep_{i}", docs.schema[c].dataType)
    schema = schema.add("text", "string")
    nothing = docs.select("doc_id", *(docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)), "text").limit(0).toArrow()

    def cut(no: int, slab: Slab | None, want: pa.Table) -> pa.Table:
        if slab is None:  # no document of the slab is wanted
            return nothing
        words, raw = Words(slab.data, slab.offs, hashed=False), slab.data.tobytes()
        known = slab.table["text"].is_valid().to_pylist()
        texts = []
        for row, spans in zip(want["row"].to_pylist(), want["spans"].to_pylist(), strict=True):
            whole = raw[slab.offs[row] : slab.offs[row + 1]].decode("utf-8", "replace") if known[row] else None
            texts.append(cut_text(raw, words, row, spans) if spans else whole)
        trim()
        return slab.table.select(names).take(want["row"]).append_column("text", pa.array(texts, pa.string()))

    out = slabs.meet(wanted, cut, schema)
    return _documents(out.select("doc_id", "text", *(out[f"keep_{i}"].alias(c) for i, c in enumerate(keep))), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
