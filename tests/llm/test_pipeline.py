"""The pipeline's stages on small tables, one after the other."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glotspark.llm import mixing, stages
from tests.conftest import SF
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, copies, near copies and toxic texts; labels."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [r[:4] for r in fx.documents()]
    rng = random.Random(8)
    mild = lambda: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(rng.randint(12, 30)))
    rows += [(1000 + i, mild() + (" grumbol snarkel vexipod grumbol " if i % 4 == 0 else " plain ") + mild(), "en", "a") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    clash = {"score": F.lit(0.7), "emptied": F.lit(True), "evidence": F.lit("e"), "spans": F.lit(1), "n_lines": F.lit(2), "n_removed": F.lit(3), "taken": F.lit(4), "column 0": F.lit(5)}
    docs.withColumns(clash).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1000 + i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, docs_schema = docs.collect(), docs.schema
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame((out := stage(spark, docs, folder)).collect(), out.schema)
        kept.append(docs.collect())
    toxic, lines, near, mixed, packed = kept
    is_toxic = lambda r: r.text is not None and "grumbol" in r.text
    assert fx.bag(toxic) == fx.bag(r for r in before if not is_toxic(r))
    pairs = [(r.doc_id, r.text) for r in toxic]
    want = fx.bag((i, x) for (i, t), x in zip(pairs, fx.without_lines(pairs, 10), strict=True) if x == (t or "") or fx.words(x))
    assert fx.bag((r.doc_id, r.text) for r in lines) == want
    pairs = [(r.doc_id, r.text) for r in lines]
    first = [(r.doc_id, r.text) for r, (_, _, _, g) in zip(lines, fx.near(pairs), strict=True) if r.doc_id == g or not fx.words(r.text)]
    assert {r.doc_id for r in near} == {i for i, _ in first} and all((r.doc_id, r.text) in pairs for r in near)
    text = {r.doc_id: r.text for r in near}
    for r in mixed:
        assert set(fx.words(r.text)) <= set(fx.words(" ".join(t or "" for i, t in pairs if i == r.doc_id))) and r.n_chars == (None if r.text is None else len(r.text))
    assert {r.doc_id for r in mixed} <= set(text)
    assert all(r.score == 0.7 and r.emptied and (r.evidence, r.spans, r.n_lines, r.n_removed, r.taken, r["column 0"]) == ("e", 1, 2, 3, 4, 5) for rows in kept[:4] for r in rows)
    mix = mixing.mix(spark.createDataFrame(near, docs_schema), block=256, fine=16, keep=("text",)).collect()
    assert fx.bag((r.doc_id, r.text) for r in mixed) == fx.bag((r.doc_id, fx.taken(r.text, r.spans)) for r in mix if r.taken or not r.size)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    ids = [(r.doc_id, np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")) for r in mixed]
    want = fx.bag((i, a, len(x[a : a + 4096]), zlib.crc32(x[a : a + 4096].tobytes()), len(x)) for i, x in ids for a in range(0, len(x), 4096))
    assert fx.bag((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == want
    sequences = defaultdict(list)
    for r in packed:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 4096


def test_small_sources_stay_in_the_mix(spark, folder):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(400)), "en", "large") for i in range(40)]
    rows += [(100 + i, " ".join(f"t{i}x{k}" for k in range(i + 1)), "en", f"tiny{i:02}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    taken = {r.source: r.n for r in stages.mix_sources(spark, docs, folder).groupBy("source").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).collect()}
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert set(taken) == set(target)
    assert all(abs(taken[s] - target[s]) <= (0.5 if s != "large" else 2 * 256) for s in target)


def test_a_slab_of_which_nothing_is_wanted(spark, folder):
    rows = [(i, " ".join(["w"] * 600), "en", "b") for i in range(40)] + [(100, "t", "en", "a"), (200 , "u", "en", "b")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize([rows[:-1], rows[-1:]], 2).flatMap(list), "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    wanted = mixing.mix(docs, block=256, fine=16).filter("taken > 0")
    got = {r.doc_id for r in stages.mix_sources(spark, docs, folder).collect()}
    assert got == {r.doc_id for r in wanted.collect()}


def test_empty_and_run(spark, folder):
    nothing = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0
    assert corpus_pipeline.run(spark, SF).count() > 0
