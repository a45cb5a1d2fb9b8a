"""Each operator against a plain version on an awkward table, and edge cases."""

from __future__ import annotations

import gc
import itertools
import pickle
import random
import tracemalloc
import weakref
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glotspark.llm import graph, kernels, langid, lines, mixing, near, packing, simhash, substring, topk, toxicity
from glotspark.llm.queries import OP9_SQL
from tests.llm import fixtures as fx


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    return fx.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return fx.table(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], fx.COLUMNS)


def bare(rows):
    return [(r[0], r[1]) for r in rows]


# 1. packing


def test_packing(docs, rows, nothing, tokenizer):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer)
    got = packing.pack(docs, tokenizer, capacity=256, group_size=16).collect()
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, (_, t) in enumerate(bare(rows))}
    want = fx.bag((rows[i][0], a, len(x[a : a + 256]), zlib.crc32(x[a : a + 256].tobytes()), len(x)) for i, x in ids.items() for a in range(0, len(x), 256))
    assert fx.bag((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256 and {p.sequence_length for p in pieces} == {at} and {p.padded_length for p in pieces} == {packing.padded(at, 256)}
    assert fx.bag(got) == fx.bag(packing.pack(docs, tokenizer, capacity=256, group_size=16).collect())
    assert packing.pack(nothing, tokenizer).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(lengths):
    which, offset = packing.first_fit_decreasing(np.array(lengths, np.int64), 50)
    bins: list[int] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, used in enumerate(bins) if used + lengths[i] <= 50), len(bins))
        if at == len(bins):
            bins.append(0)
        assert (which[i], offset[i]) == (at, bins[at])
        bins[at] += lengths[i]


def test_special_strings_and_memo(rows, tokenizer):
    encoder = packing.Encoder(tokenizer, room=50)
    texts = ["Don't stop.. it's 12.5, x.", "<|endoftext|> a", "<|ENDOFTEXT|> a", "", "Straße, ΟΔΟΣ. été. 1st, 2., ..., .,.", *(t or "" for _, t in bare(rows))]
    for _ in range(2):
        ids, edges = encoder.encode(*kernels.text_bytes(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(edges)] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


# 2. n-gram Jaccard join


def test_near_duplicates(docs, rows, nothing):
    want = fx.bag(fx.near(bare(rows)))
    assert fx.bag(near.near_duplicates(docs).collect()) == want
    assert fx.bag(near.near_duplicates(docs, tile=4).collect()) == want  # components larger than a tile
    assert near.near_duplicates(nothing).count() == 0


def test_largest_id_is_no_null(spark):
    last, t = 2**63 - 1, " ".join(f"w{k}" for k in range(20))
    for some in ([(last, t), (None, t)], [(last, t), (None, t + " x")], [(None, t), (None, t + " x")], [(last, ""), (None, None)]):
        want = fx.bag(fx.near(some))
        assert fx.bag(near.near_duplicates(spark.createDataFrame(some, "doc_id long, text string").repartition(2)).collect()) == want


def test_one_of_each_group_stays(docs, rows, nothing):
    kept = near.NearDuplicates(docs, keep=("lang", "slab")).first_of_each().collect()
    first = {i for (i, t), (_, _, _, g) in zip(bare(rows), fx.near(bare(rows)), strict=True) if fx.words(t) and i == g}
    texts = {t for _, t in bare(rows) if fx.words(t)}
    assert {r.doc_id for r in kept if fx.words(r.text)} == first
    assert {r.text for r in kept if fx.words(r.text)} <= texts and all(r.slab == 1 for r in kept)
    assert sum(not fx.words(r.text) for r in kept) == sum(not fx.words(t) for _, t in bare(rows))
    assert near.NearDuplicates(nothing).first_of_each().count() == 0


def test_bands_reach_the_recall():
    bands, per = near.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**per) ** bands >= 0.9999 and bands * per <= 200


@settings(max_examples=30, deadline=None)
@given(st.lists(st.frozensets(st.integers(0, 12), min_size=1), min_size=1, max_size=8), st.integers(1, 4))
def test_verification(sets, split):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    alike = lambda a, b: len(a & b) >= 0.5 * len(a | b)
    got = {(i, j) for i, found in near.verified(arrays, None, 0.5) for j in found.tolist()}
    assert got == {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if alike(sets[i], sets[j])}
    got = {(i, j) for i, found in near.verified(arrays[:split], arrays[split:], 0.5) for j in found.tolist()}
    assert got == {(i, j) for i in range(len(sets[:split])) for j in range(len(sets[split:])) if alike(sets[i], sets[split + j])}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 3. mixing


def test_mixing(docs, rows, nothing):
    got = mixing.mix(docs, shard_words=500).collect()
    assert fx.bag((r.doc_id, r.source, r.size) for r in got) == fx.bag((r[0], r[3], len(fx.words(r[1]))) for r in rows)
    sources = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: s.encode()) + [None]
    size = {s: sum(len(fx.words(r[1])) for r in rows if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, capped = {}, set()
    while True:  # by rounds: whoever is above stops, the rest is shared again
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in capped)
        target = {s: 2.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in sources if x not in capped) for s in sources}
        over = {s for s in sources if s not in capped and target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == sum((s.end - s.first) * s.times for s in r.spans) and all(0 <= s.first < s.end <= r.size for s in r.spans)
    for s in sources:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 16 * (2 + size[s] / 500 * 2)
    key = lambda rs: fx.bag((r.doc_id, r.source, r.size, r.taken) for r in rs)
    assert key(got) == key(mixing.mix(docs.repartition(3), shard_words=500).collect())
    assert mixing.mix(nothing).count() == 0


def test_mixing_of_rows_without_ids_and_of_one_row_often(spark):
    some = [(None, f"a b c d {i % 700}", "s") for i in range(2700)] + [(i, "a b c d e", "s") for i in range(200)] + [(7, "x y " * 30, "s")] * 3000 + [(None, None, None)] * 2000 + [(None, "", "s")] * 900
    df = spark.createDataFrame(some, "doc_id long, text string, source string")
    mixed = mixing.mix(df, shard_words=4000)
    got = mixed.groupBy("doc_id", "size", "source_size", "taken").agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == len(some) and all(0 <= r.taken <= 2 * r.size for r in got)
    total = sum(len(fx.words(r[1])) for r in some)
    assert abs(sum(r.taken * r.n for r in got) - 1.5 * total) <= 16 * (2 + total / 4000 * 2)
    again = mixing.mix(df.repartition(3), shard_words=4000).groupBy("doc_id", "size", "source_size", "taken").agg(F.count("*").alias("n"))
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    dealt = mixing.mix(df, shard_words=4000).groupBy("source", "shard").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()
    words = sorted(r.words for r in dealt if r.source == "s")
    assert len(words) > 40 and words[-1] < 3 * words[len(words) // 2]
    assert sum(r.n for r in dealt if r.source is None) == 2000 and len([r for r in dealt if r.source is None]) > 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=7), st.integers(0, 60))
def test_highest_quotients(shares, n):
    caps = [2 * -(-s // 3) for s in shares]
    want = [0] * len(shares)
    for _ in range(min(n, sum(caps)) if any(shares) else 0):
        open_ = [i for i in range(len(shares)) if want[i] < caps[i]]
        want[min(open_, key=lambda i: (-shares[i] / (2 * want[i] + 1), i))] += 1
    assert mixing.seats([float(s) for s in shares], n, caps) == want


# 4. substring dedup and 10. suffix dedup


@pytest.mark.parametrize("window,period", [(20, 13), (8, 7)])
def test_substring_dedup(docs, rows, nothing, window, period):
    units = [fx.words(t) for _, t in bare(rows)]
    gone = fx.repeated(units, [i for i, _ in bare(rows)], window, True)
    want = fx.bag((i, len(u), sum(g), " ".join(w for w, x in zip(u, g, strict=True) if not x)) for (i, _), u, g in zip(bare(rows), units, gone, strict=True))
    got = substring.substring_dedup(docs, window=window, period=period)
    assert fx.bag(got.select("doc_id", "n_words", "n_removed", "text").collect()) == want
    assert substring.substring_dedup(nothing).count() == 0


@pytest.mark.parametrize("buckets", [1, 4])
def test_suffix_dedup(docs, rows, nothing, buckets):
    units = [list((t or "").encode()) for _, t in bare(rows)]
    gone = fx.repeated(units, [i for i, _ in bare(rows)], 50, False)
    runs = lambda g: sum(x and not y for x, y in zip(g, [False, *g], strict=False))
    want = fx.bag((i, len(u), sum(g), runs(g), bytes(b for b, x in zip(u, g, strict=True) if not x)) for (i, _), u, g in zip(bare(rows), units, gone, strict=True))
    got = substring.suffix_dedup(docs, buckets=buckets).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "content")
    assert fx.bag((*r[:4], bytes(r.content)) for r in got.collect()) == want
    assert substring.suffix_dedup(nothing).count() == 0


@pytest.mark.parametrize("n", [2048, 4096])
def test_texts_with_units_exchanged_are_not_equal(spark, n):
    """Two units in the order of the Thue-Morse sequence, and the same exchanged."""
    rng = random.Random(n)
    bit = [i.bit_count() % 2 for i in range(n)]
    noise = [chr(rng.randrange(0x3E00, 0x9000)) for _ in range(n)]
    made = lambda a, b, by: by.join((b if x else a) + (c if by == "" else f" {c}{i}") for i, (x, c) in enumerate(zip(bit, noise, strict=True)))
    plain = lambda a, b, by: by.join(b if x else a for x in bit)
    for texts in ([made("a", "b", ""), made("b", "a", "")], [made("a", "b", " "), made("b", "a", " ")]):
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        assert {r.n_removed for r in substring.suffix_dedup(table).collect()} == {0} or " " in texts[0]
        assert {r.n_removed for r in substring.substring_dedup(table).collect()} == {0}
        assert {r.n_removed for r in lines.line_dedup(table).collect()} == {0}
    words = [plain("a", "b", " ") + " x", plain("b", "a", " ") + " x"]
    assert {r.n_removed for r in lines.line_dedup(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()} == {0}
    for key in (simhash._text_key, toxicity.text_keys):
        a, b = (int(key(*kernels.text_bytes(pa.array([plain(*x, "")])))[0]) for x in (("a", "b"), ("b", "a")))
        assert a != b
    assert kernels.Words(*kernels.text_bytes(pa.array([plain("a", "b", "") + " " + plain("b", "a", "")]))).hash[0] != kernels.Words(*kernels.text_bytes(pa.array([plain("b", "a", "")]))).hash[0]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40), st.data())
def test_sums_modulo_primes(units, data):
    codes = kernels.mix(np.array(units, np.uint64) + np.uint64(1))
    sums = kernels.PrimeSums(codes)
    spans = []
    for _ in range(2):
        low = data.draw(st.integers(0, len(units) - 1))
        high = data.draw(st.integers(low + 1, len(units)))
        spans.append((low, data.draw(st.integers(low, high - 1)), high))
    low, gap, high = (np.array(x) for x in zip(*spans, strict=True))
    a, b = sums.ranges((low, high))
    assert (a == b) == (units[slice(spans[0][0], spans[0][2])] == units[slice(spans[1][0], spans[1][2])])
    a, b = sums.ranges((low, gap), (gap + 1, high))
    left = [units[x:y] + units[y + 1 : z] for x, y, z in spans]
    assert (a == b) == (left[0] == left[1])


def test_covers():
    assert all(substring.is_cover(v, d) for v, d in substring.COVERS.items())


# 5. SimHash


def test_simhash(docs, rows, nothing):
    got = simhash.probe(docs).collect()
    assert fx.bag((r.doc_id, r.n_chars) for r in got) == fx.bag((i, len(t or "")) for i, t in bare(rows))
    prints = defaultdict(set)
    alone = [r for r in bare(rows) if sum(r[0] == i for i, _ in bare(rows)) == 1 and r[0] is not None]
    by = {r.doc_id: r for r in got}
    for i, t in alone:
        prints[t or ""].add(by[i].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    ordered = sorted(alone, reverse=True)
    prints = fx.simhashes([t for _, t in bare(rows)], [t for _, t in bare(rows)])
    want = {(i, t): p for (i, t), p in zip(bare(rows), prints, strict=True)}
    assert fx.bag((r.doc_id, r.fingerprint) for r in got) == fx.bag((i, p) for (i, _), p in want.items() for _ in range(sum(x == (i, _) for x in bare(rows))))
    for (i, t), (j, u) in zip(ordered, ordered[1:], strict=False):
        between = [k for k, _ in bare(rows) if k is not None and j < k < i]
        if not between:  # the very next document
            t, u = t or "", u or ""
            edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            assert by[i].edited_sha256 == fx.sha(edited)
            assert by[i].edited_fingerprint == fx.simhashes([t for _, t in bare(rows)], [edited])[0]
            apart = (int(by[i].fingerprint, 16) ^ int(by[i].edited_fingerprint, 16)).bit_count()
            assert by[i].near_edited == pytest.approx(1 - apart / simhash.BITS)
            apart = (int(by[i].fingerprint, 16) ^ int(by[j].fingerprint, 16)).bit_count()
            assert by[i].near_next == pytest.approx(1 - apart / simhash.BITS)
    assert simhash.probe(nothing).count() == 0
    one = simhash.probe(docs.filter("doc_id = -7")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def test_fingerprints_alone_and_in_company():
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 30))) for _ in range(800)] + [" ".join(f"v{i}" for i in range(9000))]
    weights = simhash.Weights(1000, np.where(np.arange(simhash.TABLE) % 3 == 0, 1, 7))
    print_of = lambda some: simhash.fingerprints(*kernels.text_bytes(pa.array(some)), weights)
    together = print_of(texts)
    assert all((print_of([t])[0] == p).all() for t, p in zip(texts, together, strict=True))
    assert (print_of(texts[::-1])[::-1] == together).all()


def test_probe_over_many_partitions_and_one_id(spark):
    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randint(0, 25)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want, before = None, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("4", "1", "90"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = fx.bag(simhash.probe(df.repartition(3 + int(parts) // 30)).collect())
            assert want in (None, got)
            want = got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    key = lambda r: (-(r[0] if r[0] is not None else simhash.FIRST), int(simhash._text_key(*kernels.text_bytes(pa.array([r[1]])))[0]))
    ordered = sorted(rows, key=key)
    edited = [(i, fx.sha(t[: len(t) - len(t) // 2] + n[: len(t) // 2])) for (i, t), (_, n) in zip(ordered, [*ordered[1:], ordered[0]], strict=True)]
    assert fx.bag((r[0], r[2]) for r in want.elements()) == fx.bag(edited)


def test_permuted_block_tables(spark):
    rng = random.Random(6)
    prints = [rng.getrandbits(128) for _ in range(40)] + [0]
    for _ in range(160):
        x = rng.choice(prints)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(128)
        prints.append(x)
    df = spark.createDataFrame([(i, f"{x:032x}") for i, x in enumerate(prints)], "doc_id long, fingerprint string")
    for tile in (4096, 7):
        got = {int(r.fingerprint, 16): (r.class_id, r.n_near) for r in simhash.search(df, tile=tile).collect()}
        assert got == {x: (prints.index(x), sum(y != x and (x ^ y).bit_count() <= 4 for y in set(prints))) for x in set(prints)}
    assert simhash.search(df.limit(0)).count() == 0


# 6. toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        w = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(5, 40))]
        for _ in range(2 + toxic if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["grumbol", "snarkel", "vexipod"]))
        rows.append((i, " ".join([*w, *("".join(rng.choices("abcdefgh", k=3)) for _ in range(3))])))  # rare words
        labels.append((i, int(toxic)))
    labels += [(None, 1), (3, None), (99999, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark, labelled, docs, nothing):
    texts, labels = labelled
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = toxicity.learn(texts, labels.filter(~held), per_class=150)
    got = toxicity.score(texts.filter(held), model).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got) and any(r.evidence for r in got)
    index, term = model.index, np.repeat(np.arange(len(model.index.first) - 1), np.diff(model.index.edges[model.index.first]))
    dense = np.zeros((len(index.ids), len(model.vocabulary)))
    dense[index.who, term] = index.weight
    often = np.flatnonzero(index.place >= 0)
    dense[:, often] = index.dense[index.place[often]].T
    assert len(often) and len(index.who)
    for x in dense:  # block-max search is exact
        t = np.flatnonzero(x)
        _, found = index.nearest(t, x[t], 7) if len(t) else (None, np.zeros(0))
        want = np.sort(dense @ x)[::-1][:7]
        assert np.allclose(found, want[want > 1e-12])
    own = toxicity.score(texts, model).collect()  # no row is its own evidence
    assert all(e.doc_id != r.doc_id for r in own for e in r.evidence) and {e.doc_id for r in own for e in r.evidence} & {r.doc_id for r in own}
    assert toxicity.score(docs, model, keep=("lang", "row")).count() == docs.count()
    assert toxicity.score(nothing, model).count() == 0
    none = toxicity.learn(nothing, labels.limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


@pytest.mark.parametrize("noise", [0.0, 0.2])
def test_toxicity_by_brute_force(spark, noise):
    """Weights of all terms, votes, calibration and scores; with an empty text and
    one that has the text of an example. With labels of one class: their rate."""
    rng = random.Random(31)
    plain = "alpha beta gamma delta epsilon zeta eta theta iota kappa été".split()
    rows, labels = [], {}
    for i in range(400):
        w = [rng.choice(plain) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(5, 40))]
        odd = 2 + i % 3 if i % 4 == 0 else rng.random() < noise
        for _ in range(odd * (rng.random() >= noise / 2)):
            w.insert(rng.randrange(len(w)), rng.choice(["grumbol", "snarkel", "Vexipod"]))
        rows.append((i, " ".join(w)))
        if i % 3:
            labels[i] = int(i % 4 == 0)
    rows += [(500, None), (501, ""), (502, rows[4][1]), (503, "Grumbol grumbol GRUMBOL grumbol é"), (504, "nothing known")]
    labels[99999] = 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = toxicity.learn(docs, spark.createDataFrame([*labels.items(), (7, None), (None, 1)], "doc_id long, toxic int"))
    assert (model.slope, model.shift) != (1, 0)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    want = dict(zip([i for i, _ in rows], fx.toxic_scores(rows, labels), strict=True))
    assert got == pytest.approx(want, abs=1e-4) and max(want.values()) > 0.7 and min(want.values()) < 0.1
    same = toxicity.learn(docs, spark.createDataFrame([(i, 0) for i in labels], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, same).collect()} == {0.0}


def test_an_id_that_many_rows_share_is_one_example(spark):
    some = [(i % 3 if i < 600 else i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta", "epsilon"], k=30))) for i in range(700)] + [(1, None)]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 2)) for i in {x[0] for x in some}], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels, per_class=4)
    ids = model.index.ids.tolist()
    assert len(ids) == len(set(ids)) and int(model.index.toxic.sum()) == 2 and len(ids) == 6
    assert model.index.keys.tolist() == toxicity.learn(docs.repartition(7), labels, per_class=4).index.keys.tolist()
    assert toxicity.score(docs, model).count() == len(some)


def test_examples_pass_over_near_copies_only(spark):
    rng = random.Random(9)
    say = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    licence, long = say(60), say(300)
    texts, toxic = [], []
    for i in range(60):  # a shared passage: a Jaccard similarity of about 0.45
        texts.append(say(20) + licence + say(20))
        toxic.append(i % 2)
    for i in range(40):  # near copies of one text, of both classes
        k = rng.randrange(300)
        texts.append([*long[:k], f"edit{i}", *long[k + 1 :]])
        toxic.append(i % 2)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    ids = lambda n: sorted(toxicity.learn(docs, labels, per_class=n).index.ids.tolist())
    got = ids(100)
    assert got[:60] == list(range(60)) and sorted(toxic[i] for i in got[60:]) == [0, 1]
    for n in (4, 25, 31):  # filled up, in several rounds
        got = ids(n)
        assert [sum(toxic[i] == c for i in got) for c in (0, 1)] == [n, n]
        assert all(sum(i >= 60 and toxic[i] == c for i in got) <= 1 for c in (0, 1))


# 7. language


def test_language(spark, docs, nothing):
    rng = random.Random(2)
    parts = {"aa": "ka lo mi", "bb": "zur wex pod", "cc": "дом лес", "dd": "été ça où"}
    say = lambda lang, n: " ".join(rng.choice(parts[lang].split()) + rng.choice(["", rng.choice(parts[lang].split())]) for _ in range(n))
    rows = [(i, say(lang, rng.randint(3, 30)), lang) for i, lang in enumerate([*parts] * 40)] + [(900, None, "aa"), (901, "x", None)]
    learned = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = say("aa", 40) + " " + say("cc", 30) + "\n" + say("bb", 80)
    cases = [(1, say("bb", 9), "bb"), (2, say("cc", 4), "cc"), (3, say("dd", 20), "dd"), (4, None, "und"), (5, "", "und"), (6, "12 — 34!", "und"), (7, mixed, "bb"), (8, "汉字", None)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([c[:2] for c in cases], "doc_id long, text string"), learned).collect()}
    for i, _, want in cases:
        assert got[i].lang_pred == want or want is None and got[i].lang_pred in parts
        assert 0 <= got[i].score <= 1
    assert [s.lang for s in got[7].spans] == ["aa", "cc", "bb"]
    assert langid.identify(docs, learned).count() == docs.count() and langid.identify(nothing, learned).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(nothing)).collect()} == {"und"}


def test_language_by_brute_force(spark):
    """Word scores, script candidates, spans of texts longer than a chunk, document scores."""
    rng = random.Random(21)
    parts = {"aa": "ka lo mi shared", "bb": "zur wex pod shared", "cc": "дом лес ka", "dd": "été ça où mi", "ee": "лес бор"}
    say = lambda lang, n: " ".join(rng.choice(parts[lang].split()) + rng.choice(["", "", rng.choice(parts[lang].split())]) for _ in range(n))
    learned = [(say(lang, rng.randint(3, 30)), lang) for lang in [*parts] * 30] + [(None, "aa"), ("x", None), (say("cc", 20).upper(), "bb")]
    texts = [say(lang, rng.randint(1, 12)) for lang in [*parts] * 8] + [None, "", "12 — 34!", "汉字", "汉字 ka lo", "Ka LO, mi!", "αβγ"]
    texts += [" ".join(say(rng.choice([*parts]), rng.randint(5, 300)) for _ in range(6)) for _ in range(10)]
    model = langid.learn(spark.createDataFrame(learned, "text string, lang string").repartition(3))
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), model).collect()}
    for i, (lang, score) in enumerate(fx.languages(learned, texts)):
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(score, rel=1e-3, abs=1e-4), texts[i]


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    model = langid.Model({}, 3.0)
    counts = [600, 0, 1, 256, 257, 90]
    first = np.concatenate([[0], np.cumsum(counts)])
    score = -4 * rng.random((first[-1], 3)).astype(np.float32)
    of = model.labels(score, first)
    for a, b in zip(first[:-1], first[1:], strict=True):
        best = np.zeros(3)
        for t in range(a, b):
            best = np.maximum(best, best.max() - 3) + score[t]
        if b > a:
            assert score[np.arange(a, b), of[a:b]].sum() - 3 * (np.diff(of[a:b]) != 0).sum() == pytest.approx(best.max(), rel=1e-4)


# 8. line dedup


def test_line_dedup(docs, rows, nothing):
    want = fx.without_lines(bare(rows), 4)
    got = lines.line_dedup(docs, min_words=4, keep=("source", "part")).collect()
    assert fx.bag((r.doc_id, r.text) for r in got) == fx.bag((i, t) for (i, _), t in zip(bare(rows), want, strict=True))
    assert lines.line_dedup(nothing).count() == 0


def test_one_word_edits(spark):
    base = [f"w{i}" for i in range(12)]
    rows = [(0, " ".join(base))]
    for i in range(12):
        rows += [(len(rows), " ".join([*base[:i], "new", *base[i + 1 :]])), (len(rows) + 1, " ".join(base[:i] + base[i + 1 :])), (len(rows) + 2, " ".join([*base[:i], "put", *base[i:]]))]
    rows.append((900, " ".join(["a", "b", *base[2:]])))
    got = {r.doc_id: r.text for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = fx.without_lines(rows, 10)
    assert got == {i: t for (i, _), t in zip(rows, want, strict=True)} and got[900]


def test_put_in_across_slabs(spark):
    base = [f"w{i}" for i in range(12)]
    longer = lambda i: " ".join([*base[:i], f"put{i}", *base[i:]])
    apart = lambda *parts: spark.createDataFrame(spark.sparkContext.parallelize(parts, len(parts)).flatMap(list), "doc_id long, text string")
    first, second = [(5, longer(3)), (20, longer(7)), (30, longer(9)), (None, longer(2))], [(10, " ".join(base))]
    for parts in ((first, second), (second, first), ([(3, " ".join(base)), *first], second)):
        rows = [r for p in parts for r in p]
        got = fx.bag((r.doc_id, r.text) for r in lines.line_dedup(apart(*parts)).collect())
        assert got == fx.bag((i, t) for (i, _), t in zip(rows, fx.without_lines(rows, 10), strict=True))
    rng = random.Random(12)
    rows = []
    for i in rng.sample(range(60), 60):
        line = list(base[:6])
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(line))
            line[k : k + rng.randint(0, 1)] = rng.choice([[], ["x"], ["y"]])
        rows.append((i, " ".join(line)))
    got = fx.bag((r.doc_id, r.text) for r in lines.line_dedup(apart(rows[:20], rows[20:40], rows[40:]), min_words=4).collect())
    assert got == fx.bag((i, t) for (i, _), t in zip(rows, fx.without_lines(rows, 4), strict=True))


# 9. top k


@pytest.mark.parametrize("scale", [1.0, 30.0])
def test_top_k(spark, scale):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(size=8) * (scale if i % 7 else 1))], 1) for i in range(900)]
    rows += [(1000 + i, rows[3][1], 0) for i in range(30)] + [(2000, None, 1), (2100, [1.0, None] + [0.0] * 6, 1), (2200, [float("nan")] * 8, 1), (2300, [float("inf")] * 8, 1), (2400, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    con = duckdb.connect()
    con.register("e", df.select("vec_id", "embedding").toArrow())
    con.execute("CREATE VIEW embeddings AS SELECT * FROM e")
    assert fx.bag(topk.top_k(df).select("query_id", "rank", "vec_id", "score").collect()) == fx.bag(con.sql(f"SELECT query_id, rank, vec_id, score FROM ({OP9_SQL})").fetchall())


def test_top_k_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], kind)).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0])], kind)).count() == 0
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [3.0]), (5, [3e30, 3e30])]
    got = topk.top_k(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 6 and {r.vec_id for r in got if r["rank"] == 1} == {5} and max(r.score for r in got) == 2**63 - 1


# kernels


@settings(max_examples=50, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    import pyarrow as pa

    w = kernels.Words(*kernels.text_bytes(pa.array(texts, pa.string())))
    found = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    assert found == [fx.words(t) for t in texts]
    same = defaultdict(set)
    for a, b, h in zip(w.start, w.end, w.hash, strict=True):
        same[w.data[a:b].tobytes()].add(int(h))
    assert all(len(h) == 1 for h in same.values()) and len({min(h) for h in same.values()}) == len(same)


def test_a_large_group_of_near_copies_has_one_tie_a_member(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(cid, band * 1000 + rng.choice([0, 0, 0, cid])) for cid in range(400) for band in range(31)]
    buckets = defaultdict(set)
    for cid, key in rows:
        buckets[key].add(cid)
    edges = [(min(b), x) for b in buckets.values() for x in b if len(b) > 1]
    root = list(range(400))
    for _ in range(10):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    ties, plain = [], graph.components
    monkeypatch.setattr(graph, "components", lambda found: ties.append(found.count()) or plain(found))
    got = {r.node: r.root for r in graph.candidates(spark.createDataFrame(rows, "cid long, key long"), 2048).collect()}
    assert got == {x: root[x] for b in buckets.values() if len(b) > 1 for x in b}
    assert ties[0] <= 400 + 31


def test_each_entry_of_the_index_is_read_once(monkeypatch):
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(300):
        t = np.unique(rng.integers(0, 3000, 40))
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.Index(np.arange(300), np.arange(300) % 2, vectors, 3000, np.arange(300))
    read, plain = [], toxicity.ranges
    monkeypatch.setattr(toxicity, "ranges", lambda start, n: read.append(int(n.sum())) or plain(start, n))
    t, q = vectors[7]
    who, cosine = index.nearest(t, q, 5)
    exact = sorted((-round(sum(q[t == a].sum() * b for a, b in zip(*v, strict=True)), 9), i) for i, v in enumerate(vectors))[:5]
    assert index.ids[who].tolist() == [i for _, i in exact] and np.allclose(cosine, [-c for c, _ in exact])
    assert sum(read) <= sum(len(np.intersect1d(t, v[0])) for v in vectors)


class Shared:
    """What a Python worker has of a broadcast."""

    def __init__(self, model):
        raw = pickle.dumps(model, 5)
        self.value = len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def large_model(n: int) -> toxicity.Model:
    rng = np.random.default_rng(5)
    places = [np.unique((20_000 * rng.random(400) ** 3).astype(np.int32)) for _ in range(n)]
    counts = [rng.integers(1, 5, len(t)).astype(np.int32) for t in places]
    return toxicity.Model(toxicity.Vocabulary(np.arange(20_000)), rng.random(20_000), [(i, i % 2, t, c, i) for i, (t, c) in enumerate(zip(places, counts, strict=True))], 0.5)


def test_a_worker_makes_the_index_in_little_more_than_its_size():
    model = large_model(3000)
    tracemalloc.start()
    index = model.index
    now, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert index.who.nbytes > 8 * 200_000 and most < 1.4 * now
    got = {(t, e): w for t in range(20_000) for e, w in zip(index.ids[index.who[index.first[t] : index.first[t + 1]]].tolist(), index.weight[index.first[t] : index.first[t + 1]], strict=True)}
    for e, (t, w) in enumerate(toxicity.Vectors(model)):
        rare = index.place[t] < 0
        assert [got.pop((a, e)) for a in t[rare].tolist()] == w[rare].tolist()
        assert index.dense[index.place[t[~rare]], np.flatnonzero(index.ids == e)[0]].tolist() == w[~rare].tolist()
    assert not got


def test_a_worker_keeps_a_model_as_long_as_its_broadcast():
    shared = Shared(large_model(50))
    model = toxicity.received(shared)
    assert toxicity.received(shared) is model and len(model.at) == 0
    model = weakref.ref(model)
    assert model() is not None
    del shared
    gc.collect()
    assert model() is None
