"""The prefix trie of conversations, and sums over an order, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glotspark.llm import ordered, queries, trie

TURNS = "conv_id long, turn long, role string, text string, depth string, part long, chain int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def grouped(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{len(text)}:{text}"), role, text))
    return {c: [x[3:] for x in sorted(x)] for c, x in own.items()}


def plain(rows, openings=True):
    own = grouped(rows)
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if openings else 0
        head = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(head, [])[:h] + x[h:]
    members, kids, words = defaultdict(list), defaultdict(set), {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
            words[tuple(x[:d])] = len(re.findall(r"[^\x20\x09-\x0D]+", x[d - 1][1])) if d else 0
            if d:
                kids[tuple(x[: d - 1])].add(tuple(x[:d]))
    leaves, saved = Counter(), Counter()
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(members[node]) - 1) * words[node]
    return Counter(
        (min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], sha(",".join(map(str, sorted(c for c in m if len(built[c]) == len(k)))))) for k, m in members.items()
    )


def cases(seed):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", None, ""]), rng.choice(["a b c", "a", "", None, "x  y\n", "é 한"]))
    rows = []
    for c in rng.sample(range(-60, 200), 120):
        n = rng.choice([1, 1, 2, 3, 3, 4, 6, 9])
        rows += [(c, t if rng.random() < 0.9 else None, *turn()) for t in range(n)]
    for c in range(9000, 9040):  # one conversation many times, ranges of ids apart
        rows += [(c * 100, t, "user", f"same {t}") for t in range(5)]
    for c, n in ((500, 150), (520, 150), (541, 149), (600, 130)):  # more than one block
        rows += [(c, t, "user", f"t{t // 2}") for t in range(n)]
    return rows + [rows[0], rows[0], (None, 1, "user", "nobody"), (2**62, None, None, None), (700, 5, "user", "w " * 9000)]


def digest_of(tree):
    nothing = F.lit(sha(""))
    found = tree.nodes.join(tree.ends, ["depth", "chain"], "left")
    return Counter(tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_a_table(spark, seed):
    rows = cases(seed)
    table = spark.createDataFrame([(*r, "d", 1, 2) for r in rows], TURNS).repartition(6)
    tree = trie.prefix_trie(table)
    assert digest_of(tree) == plain(rows, False)
    nodes = {(r.depth, bytes(r.chain)): r for r in tree.nodes.collect()}
    assert sorted(r.position for r in nodes.values()) == list(range(1, len(nodes) + 1))
    for r in nodes.values():  # intervals nest
        if r.depth:
            above = nodes[r.depth - 1, bytes(r.previous)]
            assert above.position < r.position <= r.subtree_end <= above.subtree_end


@pytest.mark.parametrize("seed", [3, 4])
def test_openings(spark, seed, tmp_path):
    rows = cases(seed)
    spark.createDataFrame([(*r, "d", 1, 2) for r in rows], TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    assert Counter(tuple(r) for r in queries.op12_prefix_trie(spark, str(tmp_path)).collect()) == plain(rows)


def test_empty_and_turnless(spark, tmp_path):
    empty = spark.createDataFrame([], TURNS)
    tree = trie.prefix_trie(empty)
    assert tree.nodes.count() == 0 and tree.ends.count() == 0
    rows = [(c, 0, "user", "hi") for c in range(21, 30)]  # no conversation 20: some have no turns left
    spark.createDataFrame([(*r, "d", 1, 2) for r in rows], TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert Counter(tuple(r) for r in queries.op12_prefix_trie(spark, str(tmp_path)).collect()) == plain(rows)


def test_one_key_in_all_partitions(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2, 2, 2, 3]), i, bytes([rng.randrange(256)] * 16) if rng.random() < 0.9 else None, rng.randint(-5, 5)) for i in range(400)]
    laid = ordered.in_order(spark.createDataFrame(rows, "k long, i long, c binary, v long"), "k", "i")
    assert laid.filter("k = 2").select("part").distinct().count() > 1
    state, want = {}, {}
    for k, i, c, _ in sorted(rows, key=lambda r: r[:2]):
        n, h = state.get(k, (0, 0))
        state[k] = (n + 1, (h * ordered.BASE + int.from_bytes(c)) % ordered.PRIME) if c else (n, h)
        want[k, i] = (*state[k], h.to_bytes(16) if c else None)
    got = {(r.k, r.i): (r.nth, int.from_bytes(r.chain), r.previous and bytes(r.previous)) for r in ordered.chained(laid, "k", "c").collect()}
    assert got == want
    total = 0
    for place, r in enumerate(sorted(ordered.numbered(laid, "place", {"v": "so_far"}).collect(), key=lambda r: (r.k, r.i)), 1):
        total += r.v
        assert (r.place, r.so_far) == (place, total)
