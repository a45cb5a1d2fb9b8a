"""Connected components of a graph of links, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotspark.llm.shared import checkpointed, planned_at_once, release

#: A key counts as hot if it has more than this many rows and more than one in
#: HOT_SHARE of all; so there are fewer than HOT_SHARE hot keys.
HOT_ROWS, HOT_SHARE, SPREAD = 100, 1000, 1009
#: Members that one task compares with each other; larger components have at
#: least so many tiles (or so many members a tile) that a hot one runs in parallel.
LONE, TILES, LEAST_TILE = 128, 24, 32


def hot_floor(rows: int) -> int:
    return max(HOT_ROWS, rows // HOT_SHARE)


def looked_up(rows: DataFrame, key: str, spread: str, table: DataFrame, floor: int) -> DataFrame:
    """rows with m from table (k, m and d, the number of rows with that key) where
    key equals k; null where there is none. Keys with more than ``floor`` rows are
    looked up in a broadcast of fewer than HOT_SHARE rows, and their rows are
    spread in the join, so that no key makes a task grow."""
    hot = F.broadcast(table.filter(F.col("d") > floor).select(F.col("k").alias("hot_k"), F.col("m").alias("hot_m")))
    at = F.when(F.col("hot_k").isNull(), F.col(key)).otherwise(-1 - F.pmod(F.xxhash64(spread), F.lit(SPREAD)))
    marked = rows.join(hot, F.col(key) == F.col("hot_k"), "left").withColumn("at_k", at)
    met = marked.join(table.select("k", "m"), F.col("at_k") == F.col("k"), "left")
    found: Column = F.when(F.col("hot_k").isNotNull(), F.col("hot_m")).otherwise(F.col("m"))
    return met.select(*rows.columns, found.alias("m"))


def _handed(edges: DataFrame, least: DataFrame, floor: int) -> DataFrame:
    """Each edge (a, b) as (b, least of a)."""
    met = looked_up(edges, "a", "b", least, floor)
    return met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _tangled(edges: DataFrame) -> tuple[int, int]:
    """The number of edges, and of nodes that keep them from being stars: those
    with two smaller neighbours, or with a smaller and a larger one."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("low"), F.lit(0).alias("high")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("low"), F.lit(1).alias("high")))
    nodes = ends.groupBy("v").agg(F.sum("low").alias("low"), F.max("high").alias("high"))
    return tuple(nodes.agg(F.coalesce(F.sum("low"), F.lit(0)), F.count_if(F.expr("low > 1 or (low > 0 and high > 0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: a long, b long. Returns node and root, the least node that links
    reach, for every node of an edge.

    Alternates large-star and small-star steps: each node hands its larger, then
    its smaller neighbours to the least node that it knows. Rounds grow with the
    logarithm of the graph; each is one job over a checkpoint. A node may have a
    large share of all edges (see looked_up).
    """
    spark = edges.sparkSession
    with planned_at_once(spark, edges.count()):
        now = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        n, tangled = _tangled(now)
        while tangled:
            floor = hot_floor(2 * n)
            both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"), "d")
            large = _handed(now.select(F.col("b").alias("a"), F.col("a").alias("b")), least, floor)
            low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("d")).withColumnRenamed("a", "k")
            small = _handed(large, low, floor)
            now = checkpointed(small.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct())
            n, tangled = _tangled(now)
            del both, least, large, low, small
            release(spark)  # shuffle files of the round
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def tiles(members: Column, tile: int) -> Column:
    """Into how many tiles a group of so many members is cut."""
    many = F.greatest(F.ceil(members / tile), F.least(F.lit(TILES), F.ceil(members / LEAST_TILE)))
    return F.when(members <= min(LONE, tile), 1).otherwise(many).cast("long")


def candidates(keyed: DataFrame, tile: int) -> DataFrame:
    """keyed: cid and key, some keys (of a fixed number) for each cid. Ties each bucket
    of equal keys to its least member, and these leasts to each other where a cid ties
    them: an edge a cid, and one for each two leasts that some cid ties, however many of
    its keys a large group shares. Returns, for every cid that shares a bucket: node,
    root (its component), tiles (of ``tile`` members at most or so) and t (its own)."""
    rows = keyed.count()
    floor = hot_floor(rows)
    tied = keyed.groupBy("key").agg(F.min("cid").alias("m"), F.max("cid").alias("c"), F.count("*").alias("d")).filter("m < c").select(F.col("key").alias("k"), "m", "d")
    with planned_at_once(keyed.sparkSession, rows):
        met = looked_up(keyed, "key", "cid", tied, floor).filter("m is not null").groupBy("cid").agg(F.min("m").alias("b"), F.collect_set("m").alias("ms"))
        ends = F.explode(F.array_union(F.array("cid"), "ms"))
        ties = checkpointed(met.select(ends.alias("a"), "b").filter("a <> b").distinct())
    release(keyed.sparkSession)
    found = components(ties)
    sizes = found.groupBy("root").agg(F.count("*").alias("m")).select(F.col("root").alias("k"), "m", F.col("m").alias("d"))
    met = looked_up(found, "root", "node", sizes, hot_floor(2 * ties.count())).withColumn("tiles", tiles(F.col("m"), tile))
    return met.select("node", "root", "tiles", F.pmod(F.xxhash64("node"), "tiles").alias("t"))


def in_tiles(members: DataFrame) -> DataFrame:
    """Members (with root, tiles and t) for each pair of tiles (i, j), i <= j, that
    they belong to. side: 0 in a tile with itself, else 1 for rows, 2 for columns."""
    other = members.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    side = F.when(F.col("t") == F.col("o"), 0).when(F.col("t") < F.col("o"), 1).otherwise(2)
    return other.withColumns({"i": F.least("t", "o"), "j": F.greatest("t", "o"), "side": side}).drop("t", "o")
