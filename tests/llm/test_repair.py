"""Repair of conversations against a plain search over edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glotspark.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string, uid string, part long, page int"
WHITE = " \t\n\x0b\x0c\r"
NEXT = {("E", "s"): "S", ("E", "u"): "U", ("S", "u"): "U", ("A", "u"): "U", ("U", "a"): "A"}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def damage(rows):
    out = []
    for c, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(c, turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def edits(turns):
    """Cost, audit and turns of the cheapest edits of (role, text, fault); audit
    strings are kept whole and compared after each row."""
    layers = [{"E": (0, "", [])}]
    for role, text, fault in turns:
        after = {}
        for state, (cost, audit, made) in spread(layers[-1]):
            ways = [(state, 2, "D", [])]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                for new in ("user", "assistant"):
                    if (state, new[0]) in NEXT:
                        ways.append((NEXT[state, new[0]], 1 + more, "R", [f"{new}:{text}"]))
                if (state, role[:1]) in NEXT:
                    ways.append((NEXT[state, role[:1]], more, "K", [f"{role}:{text}"]))
            for to, price, letter, made_more in ways:
                way = (cost + price, audit + letter, made + made_more)
                if to not in after or way[:2] < after[to][:2]:
                    after[to] = way
        layers.append(after)
    return min((x for state, x in spread(layers[-1]) if state in "EA"), key=lambda x: x[:2])


def spread(layer):
    """States with what inserts add; all ways, since an audit that begins another
    doesn't come before it in every continuation."""
    out = []
    for state, way in layer.items():
        for _ in range(4):
            out.append((state, way))
            role = "assistant" if state == "U" else "user"
            state, way = NEXT[state, role[0]], (way[0] + 5, way[1] + "I", [*way[2], f"{role}:"])
    return out


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text, turn))
    out = {}
    for c, some in own.items():
        some.sort(key=lambda r: r[:3])
        seen, turns = set(), []
        for *_, role, text, _ in some:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "fine"
            seen.add((role, text))
            turns.append((role, text, fault))
        known = {r[5] for r in some if r[5] is not None}
        count = Counter(t[2] for t in turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, made = edits(turns)
        out[c] = (c, max(known) - min(known) + 1 - len(known) if known else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha("\n".join(made)))
    return out


def cases(seed):
    rng = random.Random(seed)
    turn = lambda: (rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["a. ", "b", "c!", "", " \n", None, "é?\t", "x.y", "한.", "long " * 50 + "."]))
    rows = []
    for c in range(60):
        rows += [(c, t + (rng.random() < 0.1), *turn()) for t in range(rng.choice([1, 2, 3, 5, 9, 14])) if rng.random() < 0.9]
        if rng.random() < 0.2:
            rows.append((c, None, *turn()))
    rows += [(900, t, *turn()) for t in range(700)] + [(901, t, ("user", "assistant")[t % 2], f"t{t}.") for t in range(300)] + [(902, 3, "user", "again.")] * 40
    rows += [(None, t, *turn()) for t in range(6)] + [(2**63 - 1, None, None, None), (-3, 2**62, "user", "w. " * 9000), rows[0], rows[0]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "page"), [(1, 4096), (2, 7), (3, 1)])
def test_against_plain_search(spark, seed, page):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in cases(seed)]
    table = spark.createDataFrame([(*r, "u", 1, 2) for r in cases(seed)], TURNS).repartition(5)
    done = repair.Repair(table, page_rows=page)
    want = plain(rows)
    assert {r.conv_id: tuple(r) for r in done.summary.collect()} == {c: x[:7] for c, x in want.items()}
    assert {r.conv_id: (r.audit, r.repaired_sha256) for r in done.digests.collect()} == {c: x[7:] for c, x in want.items()}
    made = defaultdict(str)
    for r in done.rebuilt.orderBy("conv_id", "part", "page").collect():
        made[r.conv_id] += "".join(t.role[0] for t in r.turns)
        assert r.audit.count("D") + len(r.turns) == len(r.audit)
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in made.values())
    if page < 10:
        assert done._assigned.filter("conv_id = 900").select("part").distinct().count() > 1


def test_query_on_damaged_rows(spark, tmp_path):
    rows = cases(4)
    spark.createDataFrame([(*r, "u", 1, 2) for r in rows], TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = plain(damage(rows))
    nothing = {c: (c, 0, 0, 0, 0, 0, 0, "", sha("")) for c, *_ in rows}
    assert {r.conv_id: tuple(r) for r in queries.op13_structure_repair(spark, str(tmp_path)).collect()} == nothing | want


def test_empty(spark):
    done = repair.Repair(spark.createDataFrame([], TURNS))
    assert done.summary.count() == done.digests.count() == done.rebuilt.count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from([0, 1, 2])), max_size=9), st.integers(1, 9))
def test_segments_give_what_the_whole_gives(rows, cut):
    faults = ("fine", "blank", "truncated")
    cost, audit, _ = edits([(i, "t", faults[f]) for i, f in rows])
    layer, total = repair.alone(repair.EMPTY), 0
    parents, parts = [], [rows[a : a + cut] for a in range(0, len(rows), cut)]
    for part in parts:
        layer, grown, before = repair.joined(layer, [repair.table(part, s) for s in range(4)])
        total += grown
        parents.append(before)
    end = repair.finished(layer)
    got = "I" * repair.ENDING[end]
    total += layer[end][0] + 5 * repair.ENDING[end]
    for part, before in zip(parts[::-1], parents[::-1], strict=True):
        got = "".join(code for code, _ in repair.read_back(part, before[end], end)) + got
        end = before[end]
    assert (total, got) == (cost, audit)


def test_codes_are_prefix_free():
    assert all(not b.startswith(a) for a in repair.CODES for b in repair.CODES if a != b)
    assert repair.CODES == sorted(repair.CODES)
