"""Repair of the structure of conversations at least cost, by a rank-compressed DP.

Turns are kept, given another role, deleted, or put in, so that the initials of
the roles read ``(s?(ua)+)?``; among the cheapest ways the one whose edits, written
as D, I, K and R in order, come first in ASCII.

* *Macro edits.* A run of inserts and the edit of the row after it are one step.
  Their codes (D, ID, IID, ... R) all end with the letter of a row, so of two audit
  strings over the same rows neither begins the other: they compare by their parts.
* *Ranks.* A layer holds, for each of the four states of the pattern, the least cost
  and the rank of its audit string among the layer's, not the string. The next
  layer's ranks come from (rank of the parent, code). Costs relative to the least
  and ranks take few values, so steps are remembered.
* *Parent pointers.* The audit string is read back from them in the end.

Rows are range partitioned by conversation and turn, and cut into pages of 4096 rows
or 8 MB of text. For the rows that a conversation has in a page (a segment), a step of
the DP is a 4 x 4 table of costs and ranks, from each state to each. Segments of a
conversation are put together in order from these tables alone; then each page
reads back its own edits between the states it was given. So a conversation of any
length is spread over tasks; only 12 bytes a segment are held in one.
SHA-256 has to see a conversation's text in order, which ``digests`` streams.

Defined results: a null role or text is one space, an empty role fits nowhere; rows
stand in the order of turn (null first), then of a digest of role and text; rows
without a conv_id are a conversation of their own; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import cached_property, lru_cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotspark.llm import shared
from glotspark.llm.ordered import in_order

PAGE_ROWS, PAGE_BYTES = 4096, 8 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
CODES = sorted("I" * run + edit for run in range(3) for edit in "DKR")
#: The state after a turn of each initial; None where the pattern has no such turn.
AFTER = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
INSERTED = (USER, USER, ASSISTANT, USER)
ENDING = {EMPTY: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}  # inserts that make the pattern whole
ROLES = {USER: "user", ASSISTANT: "assistant"}
FINE, GONE, CUT = range(3)
LEGAL = {"su", "ua", "au"}


@lru_cache(None)
def macros(initial: str, fault: int) -> tuple[tuple[int, int, int, int], ...]:
    """(from, to, number of the code, cost) of all macro edits of such a row."""
    out = []
    for start in range(4):
        state = start
        for run in range(3):
            ways = [("D", state, DELETE)]
            if fault != GONE:
                more = TRUNCATED if fault == CUT else 0
                ways.append(("R", INSERTED[state], REROLE + more))
                kept = AFTER[initial][state] if initial in AFTER else None
                if kept is not None:
                    ways.append(("K", kept, KEEP + more))
            out += [(start, to, CODES.index("I" * run + edit), INSERT * run + cost) for edit, to, cost in ways]
            state = INSERTED[state]
    return tuple(out)


def _ranked(found: dict[int, tuple]) -> tuple[tuple, int]:
    """found: state: (cost, key that orders its audit string, ...). A layer, costs
    less the least one, and that."""
    least = min(x[0] for x in found.values())
    rank = {state: i for i, state in enumerate(sorted(found, key=lambda s: found[s][1]))}
    return tuple((found[s][0] - least, rank[s]) if s in found else None for s in range(4)), least


@lru_cache(1 << 16)
def step(layer: tuple, initial: str, fault: int) -> tuple[tuple, int, tuple]:
    """The next layer, what all its costs grew by, and for each state its parent and
    the number of the code."""
    found: dict[int, tuple] = {}
    for start, to, code, cost in macros(initial, fault):
        if layer[start] is not None:
            way = (layer[start][0] + cost, (layer[start][1], code), start)
            if to not in found or way < found[to]:
                found[to] = way
    after, grown = _ranked(found)
    return after, grown, tuple((found[s][2], found[s][1][1]) if s in found else None for s in range(4))


def alone(state: int) -> tuple:
    return tuple((0, 0) if s == state else None for s in range(4))


def table(rows: list[tuple[str, int]], start: int) -> list[tuple[int, int] | None]:
    """From a state over rows (initial, fault): cost and rank for each state."""
    layer, cost = alone(start), 0
    for initial, fault in rows:
        layer, grown, _ = step(layer, initial, fault)
        cost += grown
    return [x and (x[0] + cost, x[1]) for x in layer]


def read_back(rows: list[tuple[str, int]], start: int, end: int) -> list[tuple[str, int]]:
    """The best codes from one state to another, each with the state it starts in."""
    layer, parents = alone(start), []
    for initial, fault in rows:
        layer, _, parent = step(layer, initial, fault)
        parents.append(parent)
    out, state = [], end
    for parent in reversed(parents):
        state, code = parent[state]
        out.append((CODES[code], state))
    return out[::-1]


def joined(layer: tuple, steps: list) -> tuple[tuple, int, tuple]:
    """A layer put through a segment's tables: the next one, what costs grew by, and
    for each state the state before the segment."""
    found: dict[int, tuple] = {}
    for start in range(4):
        for to in range(4):
            if layer[start] is not None and steps[start] is not None and (x := steps[start][to]) is not None:
                way = (layer[start][0] + x[0], (layer[start][1], x[1]), start)
                if to not in found or way < found[to]:
                    found[to] = way
    after, grown = _ranked(found)
    return after, grown, tuple(found[s][2] if s in found else 0 for s in range(4))


def finished(layer: tuple) -> int:
    """The state to end in; inserts may follow it."""
    return min((x[0] + INSERT * ENDING[s], x[1], s) for s, x in enumerate(layer) if x is not None)[2]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conv_id, turn, role, text with faults put in, by a hash of conv_id
    and turn: dropped, emptied, without stops, repeated, or by the user."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("n")).drop("n")


NARROW = "conv_id long, part int, page long, at int, uid long, initial string, fault int"
SEGMENT = "conv_id long, part int, page long, costs array<array<int>>, ranks array<array<int>>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
ASSIGNED = "conv_id long, part int, page long, start int, stop int, ending int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
REBUILT = "conv_id long, part int, page long, audit string, turns array<struct<role:string,text:string>>"
WANTED = ("conv_id", "turn", "uid", "initial", "blank", "again", "truncated", "n_bytes", "part")


def _record(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


I64, I32, STR = pa.int64(), pa.int32(), pa.string()
GRID = pa.list_(pa.list_(I32))


def _kinds(ddl: str) -> list[tuple[str, pa.DataType]]:
    types = {"long": I64, "int": I32, "string": STR, "array<array<int>>": GRID, "array<struct<role:string,text:string>>": pa.list_(pa.struct([("role", STR), ("text", STR)]))}
    return [(part.split(" ")[0], types[part.split(" ")[1]]) for part in ddl.split(", ")]


def _pages(batches, most: int):
    """(part, page, rows) of consecutive rows, of bounded size; at most one partition."""
    held, size, page = [], 0, 0
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in WANTED), strict=True):
            if held and (len(held) >= most or size + row[7] > PAGE_BYTES):
                yield held[0][8], page, held
                held, size, page = [], 0, page + 1
            held.append(row)
            size += row[7]
    if held:
        yield held[0][8], page, held


def _fault(row: tuple) -> int:
    return GONE if row[4] or row[5] else CUT if row[6] else FINE


def _segments(rows: list[tuple]):
    """(conv_id, rows, whether the conversation began before) of a page."""
    a = 0
    for b in range(1, len(rows) + 1):
        if b == len(rows) or rows[b][0] != rows[a][0]:
            yield rows[a][0], rows[a:b], a == 0
            a = b


def _summed(batches, most: int):
    for part, page, rows in _pages(batches, most):
        out = []
        for conv, some, maybe_more in _segments(rows):
            kinds = [(r[3], _fault(r)) for r in some]
            tables = [table(kinds, s) if s == EMPTY or maybe_more else None for s in range(4)]
            grids = [[None if t is None else [None if x is None else x[i] for x in t] for t in tables] for i in (0, 1)]
            turns = [r[1] for r in some if r[1] is not None]
            changes = sum(a != b for a, b in zip(turns, turns[1:], strict=False)) + bool(turns)
            faults = [(bool(r[4]), bool(r[5]) and not r[4], bool(r[6]) and not r[4] and not r[5]) for r in some]
            illegal = sum(a[3] + b[3] not in LEGAL for a, b in zip(some, some[1:], strict=False))
            out.append((conv, part, page, *grids, *(sum(f[i] for f in faults) for i in range(3)), illegal, some[0][3], some[-1][3], turns[0] if turns else None, turns[-1] if turns else None, changes))
        yield _record(out, _kinds(SEGMENT))


def _tagged(batches, most: int):
    for part, page, rows in _pages(batches, most):
        yield _record([(r[0], part, page, i, r[2], r[3], _fault(r)) for i, r in enumerate(rows)], _kinds(NARROW))


class _Conversation:
    """The segments of one conversation, as they come."""

    def __init__(self, conv):
        self.conv, self.layer, self.cost = conv, alone(EMPTY), 0
        self.where, self.before = array("q"), bytearray()
        self.counts, self.last, self.low, self.high, self.turns = [0, 0, 0, 0], None, None, None, 0

    def add(self, row: dict) -> None:
        steps = [None if c is None else [None if x is None else (x, y) for x, y in zip(c, r, strict=True)] for c, r in zip(row["costs"], row["ranks"], strict=True)]
        self.layer, grown, before = joined(self.layer, steps)
        self.cost += grown
        self.where.extend((row["part"], row["page"]))
        self.before.append(sum(s << 2 * i for i, s in enumerate(before)))
        for i, c in enumerate(("blank", "duplicate", "truncated", "illegal")):
            self.counts[i] += row[c]
        self.counts[3] += self.last is not None and self.last + row["first"] not in LEGAL
        self.last = row["last"]
        if row["low"] is not None:
            self.turns += row["turns"] - (self.high == row["low"])
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]

    def rows(self, most: int = 10_000):
        """Rows of ASSIGNED, the last segment first, with what holds for the whole."""
        state = finished(self.layer)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        whole = (ENDING[state], gaps, *self.counts, self.cost + self.layer[state][0] + INSERT * ENDING[state])
        out = []
        for i in range(len(self.before) - 1, -1, -1):
            start = self.before[i] >> 2 * state & 3
            out.append((self.conv, self.where[2 * i], self.where[2 * i + 1], start, state, *(whole if i == len(self.before) - 1 else (0, *[None] * 6))))
            state = start
            if len(out) == most:
                yield out
                out = []
        yield out


def _assigned(batches):
    now, out = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["conv_id"] != now.conv:
                for some in now.rows() if now else ():
                    out += some
                    if len(out) > 5000:
                        yield _record(out, _kinds(ASSIGNED))
                        out = []
                now = _Conversation(row["conv_id"])
            now.add(row)
    for some in now.rows() if now else ():
        out += some
        yield _record(out, _kinds(ASSIGNED))
        out = []


def _rebuilt(left: pa.Table, right: pa.Table) -> pa.Table:
    """The edits of a page. left: its rows with role and text; right: ASSIGNED."""
    rows = sorted(zip(*(left[c].to_pylist() for c in ("at", "conv_id", "initial", "fault", "role", "text", "part", "page")), strict=True), key=lambda r: r[0])
    given = {r["conv_id"]: r for r in right.select(["conv_id", "start", "stop", "ending"]).to_pylist()}
    out, a = [], 0
    for b in range(1, len(rows) + 1):
        if b < len(rows) and rows[b][1] == rows[a][1]:
            continue
        some, to = rows[a:b], given[rows[a][1]]
        turns, audit = [], []
        for row, (code, state) in zip(some, read_back([r[2:4] for r in some], to["start"], to["stop"]), strict=True):
            audit.append(code)
            for letter in code:
                if letter == "I":
                    state = INSERTED[state]
                    turns.append({"role": ROLES[state], "text": ""})
                elif letter == "K":
                    turns.append({"role": row[4], "text": row[5]})
                elif letter == "R":
                    turns.append({"role": ROLES[INSERTED[state]], "text": row[5]})
        state = to["stop"]
        for _ in range(to["ending"]):
            state = INSERTED[state]
            turns.append({"role": ROLES[state], "text": ""})
        out.append((rows[a][1], rows[a][6], rows[a][7], "".join(audit) + "I" * to["ending"], turns))
        a = b
    return pa.Table.from_batches([_record(out, _kinds(REBUILT))])


class Repair:
    """The repair of a table of turns (see the module)."""

    def __init__(self, conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", page_rows: int = PAGE_ROWS):
        self._most = page_rows
        shared.prepare(conversations.sparkSession)
        text_of = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
        rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
        self._rows = shared.written(rows.withColumn("uid", F.monotonically_increasing_id()))
        self._laid = in_order(self._faults(), "conv_id", F.asc_nulls_first("turn"), "key", "uid")

    def _faults(self) -> DataFrame:
        """conv_id, turn, uid, initial, blank, again, truncated, n_bytes and key (of
        role and text) of each row; rows alike are told apart by uid."""
        white = F.lit(" \t\n\x0b\x0c\r")
        bare = F.rtrim("text", white)
        key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
        narrow = self._rows.select("conv_id", "turn", "uid", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"), F.octet_length("text").cast("long").alias("n_bytes"), key.alias("key"))
        place: Column = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"), F.col("uid").alias("uid"))
        first = narrow.groupBy("conv_id", "key").agg(F.min(place).alias("first")).select(F.col("conv_id").alias("c"), F.col("key").alias("k"), F.col("first.uid").alias("first"))
        found = narrow.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")))
        return found.select("conv_id", "turn", "uid", "initial", "blank", (F.col("uid") != F.col("first")).alias("again"), "truncated", "n_bytes", "key")

    @cached_property
    def _assigned(self) -> DataFrame:
        n = int(self._laid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        segments = self._laid.select(*WANTED).mapInArrow(partial(_summed, most=self._most), SEGMENT)
        return shared.checkpointed(segments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "page").mapInArrow(_assigned, ASSIGNED))

    @cached_property
    def summary(self) -> DataFrame:
        """Of each conversation with rows: conv_id, gaps, blank, duplicate, truncated,
        illegal, cost."""
        return self._assigned.filter("cost is not null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    @cached_property
    def rebuilt(self) -> DataFrame:
        """Of each conversation one row a page, in the order of part and page: audit
        (edits) and turns (role and text of what stays or is put in)."""
        rows = self._laid.select(*WANTED).mapInArrow(partial(_tagged, most=self._most), NARROW).join(self._rows.select("uid", "role", "text"), "uid")
        return rows.groupBy("part", "page").cogroup(self._assigned.groupBy("part", "page")).applyInArrow(_rebuilt, REBUILT)

    @cached_property
    def digests(self) -> DataFrame:
        """conv_id, audit and repaired_sha256 (of ``role:text``, newline-joined)."""
        lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
        pieces = self.rebuilt.select("conv_id", "part", "page", "audit", F.when(F.size("turns") > 0, lines).alias("lines"))

        def hashed(batches):
            now, audit, sha, some = None, [], None, False
            out = []
            for batch in batches:
                for conv, more, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "audit", "lines")), strict=True):
                    if now is None or conv != now[0]:
                        if now is not None:
                            out.append((now[0], "".join(audit), sha.hexdigest()))
                        now, audit, sha, some = (conv,), [], hashlib.sha256(), False
                    audit.append(more)
                    if text is not None:
                        sha.update(("\n" if some else "").encode() + text.encode())
                        some = True
                yield _record(out, kinds)
                out = []
            if now is not None:
                yield _record([(now[0], "".join(audit), sha.hexdigest())], kinds)

        kinds = _kinds("conv_id long, audit string, repaired_sha256 string")
        n = int(self._laid.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return pieces.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part", "page").mapInArrow(hashed, "conv_id long, audit string, repaired_sha256 string")
