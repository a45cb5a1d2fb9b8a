"""Small tables with what is awkward, and plain versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, slab long, row long, part int, keys string, n long, size long, target string"


def documents(seed: int = 1) -> list[tuple]:
    """doc_id, text, lang, source and columns whose names clash with inner ones:
    nulls in each column, empty and blank texts, repeated rows, one id for two
    texts, copies, near copies, shared passages, a long text, odd characters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß한") for _ in range(rng.randint(1, 6)))
    prose = lambda n: "".join(word() + rng.choice("     \n\t.") for _ in range(n))
    shared, base = prose(60), prose(120)
    texts: list[str | None] = [None, "", " \n\t ", "one", "a b c", base, base, shared, prose(5000), "\x1cab\x1d  x y z 🎉 é", "x " * 70, "\n\n", "x\nx\n\nx"]
    for i in range(30):
        texts.append(prose(rng.randint(5, 60)) + (shared if i % 3 == 0 else "") + prose(rng.randint(5, 60)))
    words = base.split(" ")
    for i in range(12):
        near = list(words)
        near[rng.randrange(len(near))] = word()
        if i % 3 == 0:
            del near[rng.randrange(len(near))]
        texts.append(" ".join(near))
    ids: list[int | None] = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "é", "B", None])) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[5], rows[5], (None, base, None, None), (None, None, "en", "a"), (rows[7][0], prose(40), "fr", "b"), (-7, shared + shared, "en", "a")]
    rng.shuffle(rows)
    return [(*r, 1, 2, 3, "k", 4, 5, "t") for r in rows]


def table(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, COLUMNS).repartition(5)


def order(i) -> tuple:
    return (i is None, i or 0)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def repeated(units: list[list], ids: list, window: int, within: bool) -> list[list[bool]]:
    """Per row, which units windows cover that also start earlier."""
    seen: dict[tuple, list] = {}
    for r, u in enumerate(units):
        for i in range(len(u) - window + 1):
            seen.setdefault(tuple(u[i : i + window]), []).append((r, i))
    out = [[False] * len(u) for u in units]
    for places in seen.values():
        least = min(order(ids[r]) for r, _ in places)
        first: dict[int, int] = {}
        for r, i in places:
            first[r] = min(i, first.get(r, i))
        for r, i in places:
            if least < order(ids[r]) or within and first[r] < i:
                out[r][i : i + window] = [True] * window
    return out


def one_edit(a: list, b: list) -> bool:
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def without_lines(rows: list[tuple], least: int) -> list[str]:
    lines = [(order(i), r, k, words(x), x) for r, (i, t) in enumerate(rows) for k, x in enumerate((t or "").split("\n"))]
    kept: list[list[str]] = [[] for _ in rows]
    for o, r, k, w, x in lines:
        gone = bool(w) and any((p < o or (q == r and j < k)) and (v == w or (min(len(v), len(w)) >= least and one_edit(v, w))) for p, q, j, v, _ in lines)
        if not gone:
            kept[r].append(x)
    return ["\n".join(x) for x in kept]


def grams(text: str | None, n: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near(rows: list[tuple], threshold: float = 0.8) -> list[tuple]:
    """Per row: doc_id, class_id, n_links, group_id."""
    sets = [grams(t) for _, t in rows]
    classes: dict[frozenset, list] = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s:
            classes.setdefault(s, []).append(i)
    keys = list(classes)
    links = {k: [j for j in keys if j is not k and len(j & k) >= threshold * len(j | k) - 1e-9] for k in keys}
    group: dict[frozenset, frozenset] = {}
    for k in keys:
        if k not in group:
            todo = [k]
            members = {k}
            while todo:
                fresh = [j for j in links[todo.pop()] if j not in members]
                members.update(fresh)
                todo += fresh
            for j in members:
                group[j] = frozenset(members)
    out = []
    for (i, _), s in zip(rows, sets, strict=True):
        if not s:
            out.append((i, i, 0, i))
        else:
            out.append((i, min(classes[s], key=order), len(links[s]), min((x for j in group[s] for x in classes[j]), key=order)))
    return out


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def bag(rows) -> Counter:
    return Counter(tuple(r) for r in rows)


def _mixed(x: int) -> int:
    top = 2**64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % top
    x = (x ^ x >> 27) * 0x94D049BB133111EB % top
    return x ^ x >> 31


def simhashes(corpus: list[str | None], texts: list[str | None]) -> list[str]:
    """Fingerprints of texts with the document frequencies of the corpus."""
    import math

    import pyarrow as pa

    from glotspark.llm import kernels, simhash

    number = lambda w: int(kernels.Words(*kernels.text_bytes(pa.array([w]))).hash[0])
    cut = lambda t: Counter(WORD.findall(t or ""))
    df: Counter = Counter()
    for t in corpus:
        df.update(number(w) % simhash.TABLE for w in cut(t))
    out = []
    for t in texts:
        votes = [0] * 128
        for w, n in cut(t).items():
            x = number(w)
            weight = min(4095, max(1, round(8 * (1 + math.log(n)) * (math.log((len(corpus) + 1) / (df[x % simhash.TABLE] + 1)) + 0.1))))
            raw = b"".join(_mixed((x + 2 * k + 1) % 2**64).to_bytes(8, "little") for k in (0, 1))
            for i in range(128):
                votes[i] += weight if raw[i // 8] >> (7 - i % 8) & 1 else -weight
        out.append(sum((v > 0) << (127 - i) for i, v in enumerate(votes)).to_bytes(16, "big").hex())
    return out


LETTERS = re.compile(rb"[A-Za-z\x80-\xff]+")


def letters(text: str | None) -> list[bytes]:
    return LETTERS.findall((text or "").encode())


def lowered(word: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def languages(learned: list[tuple], texts: list[str | None], switch: float = 10.0) -> list[tuple]:
    """Per text the language and its score; learned: texts and languages. Words,
    heads and tails are counted as they are, not in buckets of a table."""
    import math

    from glotspark.llm import langid

    kinds = lambda w: (lowered(w), lowered(w)[:3], lowered(w)[-3:])
    script = lambda w: max((a, b) for a, b in langid.SCRIPTS if a <= ord(w.decode()[0]))[1]
    names = sorted({lang for t, lang in learned if t is not None and lang is not None})
    counts = {(lang, k): Counter() for lang in names for k in range(4)}
    for t, lang in learned:
        for w in letters(t) if lang is not None else ():
            for k, x in enumerate((*kinds(w), script(w))):
                counts[lang, k][x] += 1
    sums = {key: sum(c.values()) for key, c in counts.items()}
    sizes = (langid.WORDS, langid.ENDS, langid.ENDS)

    def scores(w: bytes) -> list[float] | None:
        open_ = [counts[lang, 3][script(w)] > 0.005 * max(1, sums[lang, 3]) for lang in names]
        if not any(open_):
            return None
        raw = [sum((1.0, 0.5, 0.5)[k] * math.log((counts[lang, k][x] + 0.5) / (sums[lang, k] + 0.5 * sizes[k])) for k, x in enumerate(kinds(w))) for lang in names]
        best = max(s for s, o in zip(raw, open_, strict=True) if o)
        return [max(s - best, -8.0) if o else -8.0 for s, o in zip(raw, open_, strict=True)]

    out = []
    for t in texts:
        if not names or not any(c.isalpha() for c in t or ""):
            out.append(("und", 0.0))
            continue
        found = [(len(w), scores(w)) for w in letters(t)]
        n = len(names)
        best, come = [0.0] * n, []
        for _, s in found:
            top = max(range(n), key=lambda j: best[j])
            come.append([j if best[j] >= best[top] - switch else top for j in range(n)])
            best = [max(best[j], best[top] - switch) + (s[j] if s else 0) for j in range(n)]
        now, of = max(range(n), key=lambda j: best[j]), []
        for back in reversed(come):
            of.append(now)
            now = back[now]
        of.reverse()
        share = [sum(size for (size, s), j in zip(found, of, strict=True) if s and j == i) for i in range(n)]
        pred = max(range(n), key=lambda j: share[j])
        total = [sum(s[j] for (_, s), i in zip(found, of, strict=True) if s and i == pred) for j in range(n)]
        odds = sum(math.exp(min(50, max(-50, (x - total[pred]) / 2))) for x in total)
        out.append((names[pred], (share[pred] / sum(share) if sum(share) else 1 / n) / odds))
    return out


def toxic_scores(corpus: list[tuple], labels: dict, k: int = 15) -> list[float]:
    """Score of each text of the corpus; labels: class by id, also of ids without a text."""
    import math

    import numpy as np

    def terms(text: str | None) -> Counter:
        seen = Counter()
        for w in (lowered(x).decode() for x in letters(text)):
            seen["word", w] += 1
            if len(w) > 4:
                seen["head", w[:4]] += 1
        return seen

    counts = [terms(t) for _, t in corpus]
    share = sum(labels.values()) / len(labels)
    examples = sorted((i, r) for r, (i, _) in enumerate(corpus) if i in labels)
    y = np.array([labels[i] for i, _ in examples])
    ones, zeros = int(y.sum()), int((y == 0).sum())
    vocabulary = sorted({t for c in counts for t in c})  # of all documents
    table = np.array([[c[t] for t in vocabulary] for c in counts], float)
    has = table[[r for _, r in examples]] > 0
    p, p1, p0 = has.mean(0), has[y == 1].mean(0), has[y == 0].mean(0)
    phi = np.abs(p1 - p0) * math.sqrt(ones * zeros) / (ones + zeros) / np.sqrt(np.where((p > 0) & (p < 1), p * (1 - p), 1))
    idf = np.log((len(corpus) + 1) / ((table > 0).sum(0) + 1)) + 1
    dense = np.where(table > 0, 1 + np.log(np.maximum(table, 1)), 0) * idf * phi
    norm = np.sqrt((dense**2).sum(1))
    dense /= np.maximum(norm, 1e-12)[:, None]
    known, text = dense[[r for _, r in examples]], [corpus[r][1] for _, r in examples]
    scale = np.array([(1 - share) / zeros, share / ones]) * len(examples)
    bare = norm[[r for _, r in examples]] == 0
    rate = ((scale[y] * y)[bare].sum() + share) / (scale[y][bare].sum() + 1)

    def logit(r: int, fitting: bool) -> float | None:
        cosine = known @ dense[r]
        mine = lambda i: text[i] == corpus[r][1] if fitting else examples[i][0] == corpus[r][0]
        near = sorted((-round(c, 9), examples[i][0], i) for i, c in enumerate(cosine) if c > 0 and not mine(i))[:k]
        if not near:
            return None
        w = np.array([cosine[i] ** 2 * scale[y[i]] for _, _, i in near])
        p = ((w * y[[i for _, _, i in near]]).sum() + 0.05 * share) / (w.sum() + 0.05)
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    nothing = math.log(0.05 * share / 0.05 / (1 - share))  # the vote of no neighbour
    x = np.array([nothing if (z := logit(r, True)) is None else z for (_, r), b in zip(examples, bare, strict=True) if not b])
    w, c = scale[y[~bare]], y[~bare]

    def loss(slope: float, shift: float) -> float:
        z = slope * x + shift
        return float((w * (np.logaddexp(0, z) - c * z)).sum() + ((slope - 1) ** 2 + shift**2) / 2)

    def least(f, low: float, high: float) -> float:  # of a convex function
        for _ in range(70):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if f(a) < f(b) else (a, high)
        return (low + high) / 2

    slope, shift = 1.0, 0.0
    if 0 < c.sum() < len(c):
        slope = least(lambda s: loss(s, least(lambda h: loss(s, h), -40, 40)), 0, 20)
        shift = least(lambda h: loss(slope, h), -40, 40)
    return [rate if (z := logit(r, False)) is None else 1 / (1 + math.exp(-(slope * z + shift))) for r in range(len(corpus))]


def taken(text: str | None, spans: list) -> str | None:
    """A text reduced to ranges of words, a round for each time they are taken."""
    places = [m.span() for m in WORD.finditer(text or "")]
    parts: list[list[int]] = []
    for time in range(max((s.times for s in spans), default=0)):
        fresh = True
        for k in range(len(places)):
            if any(s.first <= k < s.end and s.times > time for s in spans):
                if fresh:
                    parts.append(list(places[k]))
                parts[-1][1] = places[k][1]
                fresh = False
            else:
                fresh = True
    return "\n".join(text[a:b] for a, b in parts) if spans else text
