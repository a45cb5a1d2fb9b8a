"""Queries of grouped, counted and keyed operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark.functions.tables import table_functions
from glotspark.functions.text import lines
from glotspark.operators.groups import distinct_counts, moving, top_per_group
from glotspark.operators.sets import except_counted, intersect_counted, members_of
from glotspark.sources.tables import table

DAY = 86_400_000_000


def ref_distinct_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their users by type and day, by each, and in all."""
    events = table(spark, sf_dir, "events", "event_type", "ts", "user_id").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    return distinct_counts(events, [["event_type", "day"], ["event_type"], ["day"], []], {"users": "user_id"}).withColumn("grouping_id", F.col("grouping_id").cast("long"))


def ref_moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with what its user did in the day before it."""
    events = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    found = moving(events, ["user_id"], "ts", DAY, lambda w: [F.count("*").over(w).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).over(w).cast("double").alias("total"), F.max("value").over(w).alias("most")])
    return found.select("event_id", "user_id", "n", "total", "most")


def ref_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's three largest orders."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice")], 3)


def ref_top_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's lines of the two largest quantities, and those that tie."""
    sold = table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return top_per_group(sold, ["l_partkey"], [F.desc("l_quantity")], 2, ties=True)


def _pairs(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_returnflag").filter(F.col("l_returnflag") == flag).select("l_partkey", F.pmod("l_suppkey", F.lit(10)).alias("group"))


def ref_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intersect_counted(_pairs(spark, sf_dir, "R"), _pairs(spark, sf_dir, "A"))


def ref_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return except_counted(_pairs(spark, sf_dir, "R"), _pairs(spark, sf_dir, "A"))


def ref_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one source's documents that other sources have too."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    mine, others = (lines(docs.filter(c).select("doc_id", "text")) for c in ("source = 'src0'", "source <> 'src0'"))
    return members_of(mine, others, ["line"])


def ref_unseen_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations that no document has."""
    turns = lines(table(spark, sf_dir, "conversations", "conv_id", "turn", "text"))
    return members_of(turns, lines(table(spark, sf_dir, "documents", "text")), ["line"], absent=True)


def ref_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items by the table function."""
    table_functions(spark)
    table(spark, sf_dir, "benchmark", "item_id", "text").createOrReplaceTempView("glotspark_items")
    return spark.sql("SELECT item_id, pos, start, word FROM glotspark_items, LATERAL cut_text(text, 'word')")


def ref_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each turn stands in its conversation's transcript."""
    table_functions(spark)
    table(spark, sf_dir, "conversations", "conv_id", "turn", "text").createOrReplaceTempView("glotspark_turns")
    return spark.sql("SELECT conv_id, turn, start, length FROM transcript(TABLE(glotspark_turns) PARTITION BY conv_id ORDER BY turn, text => 'text')")


QUERIES = {name: f for name, f in globals().items() if name.startswith("ref_")}

_PAIRS = "SELECT l_partkey, l_suppkey % 10 AS \"group\" FROM lineitem WHERE l_returnflag = '{}'"
_COUNTED = "SELECT l_partkey, \"group\", count(*) AS n FROM ({} {} {}) GROUP BY l_partkey, \"group\""
_CUT = "SELECT {0}, unnest(string_split(text, chr(10))) AS line, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM {1}"
ORACLES = {
    "ref_distinct_sets": """
SELECT event_type, day, CAST(grouping(event_type, day) AS BIGINT) AS grouping_id, count(*) AS n_rows, count(DISTINCT user_id) AS users
FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, user_id FROM events) GROUP BY GROUPING SETS ((event_type, day), (event_type), (day), ())
""",
    "ref_moving": """
SELECT event_id, user_id, count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) OVER w AS DOUBLE) AS total, max(value) OVER w AS most
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)
""",
    "ref_top_orders": "SELECT o_custkey, o_orderkey, o_totalprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3",
    "ref_top_with_ties": "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, CAST(r AS INTEGER) AS rank FROM (SELECT *, rank() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 2",
    "ref_intersect_all": _COUNTED.format(_PAIRS.format("R"), "INTERSECT ALL", _PAIRS.format("A")),
    "ref_except_all": _COUNTED.format(_PAIRS.format("R"), "EXCEPT ALL", _PAIRS.format("A")),
    "ref_shared_lines": f"SELECT doc_id, pos, line FROM ({_CUT.format('doc_id', 'documents')} WHERE source = 'src0') WHERE line IN (SELECT line FROM ({_CUT.format('doc_id', 'documents')} WHERE source <> 'src0'))",
    "ref_unseen_lines": f"SELECT conv_id, turn, pos, line FROM ({_CUT.format('conv_id, turn', 'conversations')}) AS c WHERE NOT EXISTS (SELECT 1 FROM ({_CUT.format('doc_id', 'documents')}) AS d WHERE d.line = c.line)",
    "ref_cut_text": """
WITH w AS (SELECT item_id, unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), 1) AS p,
                  unnest(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+')) AS whole FROM benchmark)
SELECT item_id, CAST(p - 1 AS INTEGER) AS pos, CAST(sum(length(whole)) OVER (PARTITION BY item_id ORDER BY p) - length(word) AS INTEGER) AS start, word FROM w
""",
    "ref_transcript": "SELECT conv_id, turn, CAST(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS BIGINT) AS start, CAST(length(text) AS BIGINT) AS length FROM conversations",
}
