"""The prefix trie of conversations, by preorder intervals.

A node is a distinct sequence of first turns. Turns become 128-bit digests at
once, so texts aren't shuffled.

* *Identity.* A node is its depth and a hash of its digests in order, by prefix
  sums that may break off anywhere inside a conversation (``ordered.chained``).
* *Lexicographic rank.* Conversations are cut into blocks of 64 digests; distinct
  blocks are sorted and numbered; 64 numbers make a block of the next level, until
  each conversation is one block: a round for each power of 64 of the longest.
  Equal sequences share a rank, a prefix comes before what continues it.
* *Preorder.* Nodes sorted by the least rank of their members, then by depth, are
  in preorder. The subtree of a node ends with the last node that the greatest
  rank of its members brings in.
* *Subtree values* are differences of running sums (``ordered.numbered``) at both
  ends of that interval: no walk over the trie, no level by level rounds.

What is joined or grouped by a node that very many conversations share is
aggregated before it is shuffled; joins have one row a key on one side, so
adaptive planning can split the other.

Defined results: a null role or text is empty; turns stand in the order of turn
(null first), role and text by digest; rows without a conv_id name no conversation
and take no part; repeated rows are turns of their own; an empty table gives no
nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotspark.llm import shared
from glotspark.llm.ordered import chained, in_order, numbered

BLOCK = 64
ENDS_BITS = 12


def digest(*parts: Column) -> Column:
    """16 bytes of SHA-256 of strings, each with its length."""
    whole = F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)))
    return F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, nth (from 1), code and words of each turn, in order."""
    spark = conversations.sparkSession
    shared.prepare(spark)
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    coded = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), digest(role, text).alias("code"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    laid = in_order(coded.filter("conv_id is not null"), F.col("conv_id"), F.asc_nulls_first("turn"), F.col("code"))
    return chained(laid, "conv_id", "code").select("conv_id", "nth", "code", "words")


def with_openings(own: DataFrame, head_of: Column, n_turns: Column) -> tuple[DataFrame, DataFrame]:
    """Each conversation with its first n_turns replaced by those of the conversation
    head_of (both are expressions of conv_id; fewer where that one has fewer, none
    where there is no such conversation). own: of ``turns``. most turns replaced: a
    few, since they are repeated for each conversation.

    Returns the turns and the ids of all conversations, turnless ones included."""
    convs = own.select("conv_id").distinct()
    opened = convs.select("conv_id", head_of.alias("head"), n_turns.alias("n")).filter("n > 0")
    heads = own.select(F.col("conv_id").alias("head"), "nth", "code", "words").join(opened.select("head", "n").distinct().groupBy("head").agg(F.max("n").alias("most")), "head").filter("nth <= most").drop("most")
    taken = opened.join(heads, "head").filter("nth <= n").select("conv_id", F.lit(0).alias("source"), "nth", "code", "words")
    rest = own.filter(F.col("nth") > n_turns).select("conv_id", F.lit(1).alias("source"), "nth", "code", "words")
    return taken.unionByName(rest), convs


class Trie:
    """The trie of conversations given as turns (conv_id, source, nth, code, words;
    a conversation's turns in the order of source and nth) and the ids of all."""

    def __init__(self, rows: DataFrame, convs: DataFrame):
        start = convs.select("conv_id", F.lit(-1).alias("source"), F.lit(0).cast("long").alias("nth"), F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("words"))
        laid = in_order(rows.unionByName(start).withColumnsRenamed({"nth": "at"}), "conv_id", "source", "at")
        #: A row for each conversation and depth, 0 (the root) included.
        self.rows = shared.checkpointed(chained(laid, "conv_id", "code").select("conv_id", F.col("nth").alias("depth"), "chain", "previous", "code", "words"))

    def _ranks(self) -> DataFrame:
        """conv_id and the rank of its sequence among distinct ones; turnless: 0."""
        def parts(item: str):
            return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", item))), lambda x: x[item]), "")

        units = self.rows.filter("depth > 0").select("conv_id", (F.col("depth") - 1).alias("at"), F.hex("code").alias("unit"))
        while True:
            blocks = shared.checkpointed(units.groupBy("conv_id", F.expr(f"at div {BLOCK}").alias("block")).agg(parts("unit").alias("key")))
            names = numbered(in_order(blocks.select("key").distinct(), "key"), "name").select("key", "name")
            named = blocks.join(names, "key").select("conv_id", "block", "name")
            if not (blocks.agg(F.max("block")).first()[0] or 0):
                break
            units = shared.checkpointed(named.select("conv_id", F.col("block").alias("at"), F.lpad(F.hex("name"), 16, "0").alias("unit")))
        convs = self.rows.filter("depth = 0").select("conv_id").distinct()
        return convs.join(named.select("conv_id", "name"), "conv_id", "left").select("conv_id", F.coalesce("name", F.lit(0).cast("long")).alias("rank"))

    @cached_property
    def nodes(self) -> DataFrame:
        """A row for each node: depth and chain (its key), previous (the parent's
        chain), conv_id (its smallest member), parent_conv_id, n_convs, n_children,
        n_leaves, saved_tokens, and its preorder interval, position to subtree_end."""
        members = self.rows.join(self._ranks(), "conv_id")
        made = members.groupBy("depth", "chain").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.max("previous").alias("previous"), F.max("words").alias("words"))
        made = shared.checkpointed(made)
        kids = made.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("previous").alias("chain")).agg(F.count("*").alias("n_children"))
        whole = made.join(kids, ["depth", "chain"], "left").na.fill(0, ["n_children"])
        whole = whole.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
        placed = numbered(in_order(whole, "low", "depth"), "position", {"leaf": "leaves", "saved": "savings"})
        ends = placed.groupBy("low").agg(F.max(F.struct("position", "leaves", "savings")).alias("end")).withColumnRenamed("low", "high")
        found = placed.join(ends, "high")
        parents = made.select((F.col("depth") + 1).alias("depth"), F.col("chain").alias("previous"), F.col("conv_id").alias("parent_conv_id"))
        root = made.filter("depth = 0").select(F.lit(1).cast("long").alias("depth"), F.col("conv_id").alias("root_conv_id"))  # one row
        found = found.join(parents.filter("depth > 1"), ["depth", "previous"], "left").join(F.broadcast(root), "depth", "left")
        return found.select(
            "conv_id", "depth", F.coalesce("parent_conv_id", "root_conv_id").alias("parent_conv_id"), "n_convs", "n_children",
            (F.col("end.leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"), (F.col("end.savings") - F.col("savings") + F.col("saved")).alias("saved_tokens"),
            "position", F.col("end.position").alias("subtree_end"), "chain", "previous",
        )

    @cached_property
    def ends(self) -> DataFrame:
        """depth, chain, n_ends and ends_sha256 of the nodes where conversations end:
        SHA-256 of their ids, ascending, comma-joined. Ids are joined in ranges of
        4096 numbers; a node's ranges pass a task one after the other, so a node
        where very many end never is in memory."""
        last = self.rows.groupBy("conv_id").agg(F.max(F.struct("depth", "chain")).alias("end")).select("end.depth", "end.chain", "conv_id")
        ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
        ranges = last.groupBy("depth", "chain", F.shiftright("conv_id", ENDS_BITS).alias("range")).agg(ids.alias("ids"), F.count("*").alias("n"))

        def hashed(batches):
            key, n, sha = None, 0, None
            for batch in batches:
                out = []
                for depth, chain, some, count in zip(*(batch[c].to_pylist() for c in ("depth", "chain", "ids", "n")), strict=True):
                    if (depth, chain) != key:
                        if key:
                            out.append((*key, n, sha.hexdigest()))
                        key, n, sha = (depth, chain), 0, hashlib.sha256()
                    elif n:
                        sha.update(b",")
                    sha.update(some.encode())
                    n += count
                yield _ends(out)
            if key:
                yield _ends([(*key, n, sha.hexdigest())])

        n = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return ranges.repartition(n, "depth", "chain").sortWithinPartitions("depth", "chain", "range").mapInArrow(hashed, "depth long, chain binary, n_ends long, ends_sha256 string")


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["depth", "chain", "n_ends", "ends_sha256"])


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Trie:
    """The trie of a table of turns as it is."""
    own = turns(conversations, conv_col, turn_col, role_col, text_col)
    return Trie(own.select("conv_id", F.lit(0).alias("source"), "nth", "code", "words"), own.select("conv_id").distinct())
