"""Benchmark decontamination against a plain version."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from glotspark.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, row long, key string, at long, passage string"
ITEMS = "item_id long, text string, size int, doc_id string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window):
    known = {}
    for i, text in items:
        w = words(text)
        n = min(len(w), window)
        for p in range(len(w) - n + 1) if n else ():
            known.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for d, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for n in range(1, window + 1):
            for p in range(len(w) - n + 1):
                got = known.get(tuple(w[p : p + n]))
                if got:
                    found |= got
                    hit[p : p + n] = [True] * n
        spans, p = [], 0
        while p < len(w):
            if hit[p]:
                q = next((q for q in range(p, len(w)) if not hit[q]), len(w))
                spans.append((p, q - p))
                p = q
            p += 1
        out.append((d, len(w), sum(hit), tuple(spans), tuple(sorted(str(i) for i in found if i is not None))))
    return Counter(out)


def cases(seed, short):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "é", "x1", "Ü", "of", "12", "한", "Q" * 70])
    prose = lambda n: "".join(word() + rng.choice([" ", "  ", ", ", "-", "\n"]) for _ in range(n))
    items = [(i, prose(rng.randint(10, 25))) for i in range(12)] + [(3, prose(30)), (None, prose(14)), (20, None), (21, " .,"), (22, prose(12).upper())]
    items += [(23, items[0][1]), (24, items[0][1]), (24, items[0][1]), (25, "same " * 12)]
    if short:
        items += [(30, "zz yy xx"), (31, "Zz"), (32, prose(9)), (33, prose(4))]
    docs = [(i, prose(rng.randint(0, 40)) + rng.choice(items)[1].__str__() + prose(rng.randint(0, 9))) for i in range(60)]
    docs += [(None, items[1][1]), (100, None), (101, ""), (102, "..."), (103, " ".join(words(items[2][1])[2:12])), (104, " ".join(words(items[2][1])[2:11])), (105, "same " * 40), (105, "SAME-" * 10), (106, "zz. yy! xx zz")]
    docs += [docs[3], docs[3], (107, prose(3000) + items[4][1] + prose(50)), (-5, items[0][1] + items[1][1]), (2**63 - 1, items[5][1])]
    return docs, items


@pytest.mark.parametrize(("window", "short"), [(10, True), (10, False), (4, True), (1, True)])
def test_against_plain_version(spark, window, short):
    docs, items = cases(window, short)
    left = spark.createDataFrame([(*d, 1, "k", 2, "p") for d in docs], DOCS).repartition(5)
    right = spark.createDataFrame([(*i, 3, "d") for i in items], ITEMS).repartition(3)
    got = dc.decontaminate(left, right, window=window)
    assert got.columns == ["doc_id", "n_words", "n_hit", "spans", "items"]
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in got.collect()) == plain(docs, items, window)


def test_empty_tables(spark):
    docs, items = cases(1, True)
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.decontaminate(no_docs, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    got = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), no_items).collect()
    assert len(got) == len(docs) and not any(r.n_hit or r.spans or r["items"] for r in got)


@pytest.mark.parametrize("size", range(1, 12))
def test_every_shared_run_shares_a_selected_gram(size):
    rng = random.Random(size)
    for alphabet in ("ab", "abcdefgh"):
        run = [rng.choice(alphabet) for _ in range(size)]
        texts = [" ".join([rng.choice(alphabet) for _ in range(rng.randint(0, 20))] + run + [rng.choice(alphabet) for _ in range(rng.randint(0, 20))]) for _ in range(8)]
        chosen = [set(dc.Passages(pa.chunked_array([[t]])).selected(size)[1].tolist()) for t in texts]
        own = set(dc.Passages(pa.chunked_array([[" ".join(run)]])).selected(size)[1].tolist())
        assert len(own) == 1 and all(own <= c for c in chosen)


def test_the_filter_passes_what_it_holds(spark):
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000)
    n, width, sieve = dc._sieve(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    some = lambda x: ((lambda b: ((sieve.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1).all(1))(dc._bits(x.view(np.uint64), width).astype(np.int64)))
    assert n == len(set(keys.tolist())) and some(keys).all()
    assert some(np.random.default_rng(2).integers(0, 1 << 63, 100_000)).mean() < 0.01
