"""The queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark.llm import decontaminate, langid, lines, mixing, near, packing, repair, simhash, substring, topk, toxicity, trie
from glotspark.llm.shared import checkpointed, release


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(_table(spark, sf_dir, "documents", "doc_id", "text"), gram=5, threshold=0.8)


OP2_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g0 AS (SELECT doc_id, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END AS g FROM d WHERE len(w) > 0),
s AS (SELECT doc_id, md5(array_to_string(list_sort(list_distinct(g)), chr(10))) AS h, list_distinct(g) AS g FROM g0),
c AS (SELECT h, min(doc_id) AS class_id, any_value(len(g)) AS n, any_value(g) AS g FROM s GROUP BY h),
e AS (SELECT class_id, n, unnest(g) AS gram FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b FROM e AS a JOIN e AS b ON a.gram = b.gram AND a.class_id <> b.class_id
      GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
t AS (SELECT class_id AS a, class_id AS b FROM c UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a),
m AS (SELECT a, min(b) AS group_id FROM t GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(group_id, d.doc_id) AS group_id
FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN c ON s.h = c.h LEFT JOIN m ON c.class_id = m.a LEFT JOIN l ON c.class_id = l.a
"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(text, '')), 1, 16) AS mark
  FROM documents
), s0 AS (
  SELECT source, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS nth
  FROM d GROUP BY source
), s1 AS (  -- sources by when they fill up; what is left for each and those after it
  SELECT *, row_number() OVER o AS fill,
         1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight
  FROM s0 WINDOW o AS (ORDER BY CAST(source_size AS DOUBLE) / w, nth)
), s2 AS (
  SELECT *, min(CASE WHEN rest * w / weight < 2 * source_size THEN fill END) OVER () AS open_at FROM s1
), s3 AS (
  SELECT a.source, a.source_size, a.n_rows, a.nth,
         CASE WHEN a.open_at IS NULL OR a.fill < a.open_at THEN CAST(2 * a.source_size AS DOUBLE) ELSE b.rest * a.w / b.weight END AS target
  FROM s2 AS a LEFT JOIN s2 AS b ON b.fill = a.open_at
), q1 AS (  -- blocks of 16 words by the highest quotients
  SELECT nth, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, nth) AS place
  FROM (SELECT nth, target, unnest(range(2 * CAST(ceil(source_size / 16.0) AS BIGINT))) AS k FROM s3)
), plan AS (
  SELECT s3.*, (SELECT count(*) FROM q1 WHERE q1.nth = s3.nth AND place <= (SELECT floor(1.5::DOUBLE * sum(source_size) / 16 + 0.5) FROM s3)) AS quota,
         greatest(1, CAST(ceil(greatest(source_size, 16 * n_rows) / 262144.0) AS BIGINT)) AS shards
  FROM s3
), c0 AS (  -- equal rows, in chunks of few words
  SELECT *, greatest(1, least(1000, 4096 // (size + 1))) AS most FROM (SELECT doc_id, source, size, mark, count(*) AS n FROM d GROUP BY ALL)
), c AS (
  SELECT doc_id, source, size, mark, chunk, least(most, n - chunk * most) AS copies FROM (SELECT *, unnest(range((n - 1) // most + 1)) AS chunk FROM c0)
), e AS (
  SELECT c.*, p.source_size, p.target, p.nth, p.quota,
         CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || mark || ':' || chunk), 1, 8) AS BIGINT) % p.shards AS shard,
         CAST('0x' || substr(md5('2:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || mark || ':' || chunk), 1, 8) AS BIGINT) AS draw
  FROM c JOIN plan AS p ON c.source IS NOT DISTINCT FROM p.source
), h0 AS (
  SELECT nth, shard, any_value(quota) AS quota, CAST(sum(size * copies) AS BIGINT) AS words, greatest(1, CAST(ceil(sum(size * copies) / 16.0) AS BIGINT)) AS blocks FROM e GROUP BY nth, shard
), h1 AS (
  SELECT nth, shard, quota, row_number() OVER (PARTITION BY nth ORDER BY CAST(words AS DOUBLE) / (2 * k + 1) DESC, shard) AS place
  FROM (SELECT nth, shard, quota, words, unnest(range(2 * CAST(ceil(words / 16.0) AS BIGINT))) AS k FROM h0)
), h2 AS (
  SELECT h0.*, (SELECT count(*) FROM h1 WHERE h1.nth = h0.nth AND h1.shard = h0.shard AND h1.place <= h0.quota) AS got FROM h0
), h AS (
  SELECT *, got // blocks AS times, got % blocks AS extra, (1000003 + 97 * shard) % blocks AS shift,
         (SELECT min(a) FROM (SELECT unnest(range(greatest(1, CAST(floor(blocks * 0.6180339887::DOUBLE) AS BIGINT)), 2 * blocks + 2)) AS a) WHERE gcd(a, blocks) = 1) AS step
  FROM h2
), f0 AS (
  SELECT e.*, h.times, h.extra, h.shift, h.step, h.blocks,
         CAST(sum(size * copies) OVER (PARTITION BY e.nth, e.shard ORDER BY draw, doc_id NULLS FIRST, mark, chunk, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS last
  FROM e JOIN h ON e.nth = h.nth AND e.shard = h.shard
), f1 AS (
  SELECT *, unnest(range(copies)) AS before FROM f0
), f AS (
  SELECT *, last - before * size AS stop, row_number() OVER () AS r FROM f1
), g AS (
  SELECT *, unnest(CASE WHEN size > 0 THEN range((stop - size) // 16, (stop - 1) // 16 + 1) ELSE [NULL] END) AS j FROM f
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, any_value(source) AS source,
       CAST(coalesce(sum((least(stop, (j + 1) * 16) - greatest(stop - size, j * 16)) * (times + CASE WHEN (step * j + shift) % blocks < extra THEN 1 ELSE 0 END)), 0) AS BIGINT) AS taken
FROM g GROUP BY r
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.substring_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Rows of the held-out fold, and those to learn from.
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)"
LEARNED = "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"


OP4_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT doc_id, p, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k FROM u),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM k WHERE p <= n - 19) WHERE r > 1),
g AS (SELECT DISTINCT doc_id, p + o AS p FROM f, range(20) AS t(o)),
r AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY u.p) AS kept, count(*) AS n FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.p = g.p GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    probed = checkpointed(simhash.probe(_table(spark, sf_dir, "documents", "doc_id", "text")))
    release(spark)  # the texts that were dealt
    found = simhash.search(probed.select("doc_id", "fingerprint")).withColumnRenamed("fingerprint", "f")
    return probed.join(found, probed["fingerprint"] == found["f"], "left").select(*probed.columns, "class_id", "n_near")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels", "doc_id", "toxic").filter(LEARNED))
    found = toxicity.score(docs, model)
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.learn(docs.filter(LEARNED))
    found = langid.identify(docs, model)
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "spans")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.line_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = """
WITH l AS (
  SELECT doc_id, p, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents)
), e AS (SELECT doc_id, p, min((doc_id, p)) OVER (PARTITION BY w) < (doc_id, p) AS gone FROM l WHERE len(w) > 0),
v AS (  -- each line of ten words or more without its i-th word
  SELECT doc_id, p, len(w) AS n, i, list_concat(w[:i - 1], w[i + 1:]) AS k FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM l WHERE len(w) >= 10)
), r AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, p, min((doc_id, p)) OVER (PARTITION BY n, i, k) < (doc_id, p) AS gone FROM v) WHERE gone),
whole AS (SELECT w AS k, min((doc_id, p)) AS m FROM l WHERE len(w) >= 10 GROUP BY w),
short AS (SELECT k, min((doc_id, p)) AS m FROM v WHERE n > 10 GROUP BY k),
i AS (SELECT DISTINCT doc_id, p FROM v JOIN whole USING (k) WHERE n > 10 AND m < (doc_id, p)
      UNION SELECT doc_id, p FROM l JOIN short ON l.w = short.k WHERE len(w) >= 10 AND m < (doc_id, p)),
g AS (SELECT doc_id, p FROM e WHERE gone UNION SELECT * FROM r UNION SELECT * FROM i)
SELECT l.doc_id, count(*) AS n_lines, count(g.p) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY l.p) FILTER (WHERE g.p IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.p = g.p GROUP BY l.doc_id
"""


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), k=10, every=100)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v AS q, v WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 10
"""


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.suffix_dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("content", 256).alias("kept_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
k AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS k FROM (SELECT doc_id, x, unnest(range(n - 49)) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS m FROM k) WHERE m < doc_id),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM f)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
c AS (SELECT d.doc_id, any_value(n) AS n, coalesce(sum(b - a), 0) AS gone, count(a) AS spans, any_value(x) AS x, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b
      FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, CAST(spans AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN spans = 0 THEN x ELSE array_to_string(list_transform(range(1, spans + 2), lambda j:
         substr(x, 2 * CASE WHEN j = 1 THEN 0 ELSE b[j - 1] END + 1, 2 * (CASE WHEN j = spans + 1 THEN n ELSE a[j] END - CASE WHEN j = 1 THEN 0 ELSE b[j - 1] END))), '') END)) AS kept_sha256
FROM c
"""


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP11_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS k
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT n FROM x),
y AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, s WHERE len(w) >= n)),
h AS (SELECT y.r, y.n, y.p, x.item_id FROM y JOIN x USING (n, k)),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN i USING (r)
"""


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = trie.turns(_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    tree = trie.Trie(*trie.with_openings(own, F.expr("conv_id - conv_id % 20"), F.expr("crc32(cast(cast(conv_id as string) as binary)) % 4")))
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    found = tree.nodes.join(tree.ends, ["depth", "chain"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


#: DuckDB has no crc32: bit by bit over the bytes of a short ASCII string.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length({0})), lambda i: ((ascii(substr({0}, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1)::BIGINT)),
  lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295::BIGINT)"""

OP12_SQL = f"""
WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p, k, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS words
           FROM (SELECT *, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || length(coalesce(text, '')) || ':' || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT c, c - c % 20 AS head, {CRC32_SQL.format("CAST(c AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT c FROM o)),
u AS (SELECT c.c, 0 AS s, o.p, k, words FROM c JOIN o ON o.c = head AND p <= h UNION ALL SELECT c.c, 1, o.p, k, words FROM c JOIN o ON o.c = c.c AND p > h),
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY s, p) AS d, k, words FROM u),
l AS (SELECT c.c, list(k ORDER BY d) FILTER (WHERE d IS NOT NULL) AS ks FROM c LEFT JOIN t ON t.c = c.c GROUP BY c.c),
r AS (SELECT c, CAST(len(coalesce(ks, [])) AS BIGINT) AS n, list_transform(range(len(coalesce(ks, [])) + 1), lambda i: md5(array_to_string(ks[:i], ','))) AS ids FROM l),
m AS (SELECT c, n, ids, unnest(range(n + 1)) AS depth FROM r),
q AS (SELECT m.*, ids[depth + 1] AS id, coalesce(words, 0) AS words FROM m LEFT JOIN t ON t.c = m.c AND t.d = depth),
n AS (SELECT depth, id, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words, any_value(ids[:depth + 1]) AS path,
             sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM q GROUP BY depth, id),
k AS (SELECT n.depth, n.id, count(x.id) AS n_children FROM n LEFT JOIN n AS x ON x.depth = n.depth + 1 AND x.path[x.depth] = n.id GROUP BY n.depth, n.id),
s AS (SELECT a.depth, a.id, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
      FROM (SELECT n.*, k.n_children, unnest(range(n.depth + 1)) AS up FROM n JOIN k USING (depth, id)) AS x JOIN n AS a ON a.depth = up AND a.id = x.path[up + 1] GROUP BY a.depth, a.id)
SELECT n.conv_id, n.depth, y.conv_id AS parent_conv_id, n.n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN k USING (depth, id) JOIN s USING (depth, id) LEFT JOIN n AS y ON y.depth = n.depth - 1 AND y.id = n.path[n.depth]
"""


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    repaired = repair.Repair(repair.damaged(table))
    convs = table.select("conv_id").distinct()
    summary, digests = repaired.summary.withColumnRenamed("conv_id", "s"), repaired.digests.withColumnRenamed("conv_id", "d")
    found = convs.join(summary, convs["conv_id"].eqNullSafe(F.col("s")), "left").join(digests, convs["conv_id"].eqNullSafe(F.col("d")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


OP13_SQL = f"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32_SQL.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS hit FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN hit = 3 THEN [1, 2] ELSE [1] END) AS copy
      FROM h WHERE hit <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS i, substr(role, 1, 1) AS ini,
             regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS tip FROM d),
f AS (SELECT *, CASE WHEN tip = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tip NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS fault,
             ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM n),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
             count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
run(st, mid, ins, put) AS (VALUES ('E', 'E', '', ''), ('S', 'S', '', ''), ('U', 'U', '', ''), ('A', 'A', '', ''), ('E', 'U', 'I', 'user:'), ('S', 'U', 'I', 'user:'), ('U', 'A', 'I', 'assistant:'), ('A', 'U', 'I', 'user:'),
  ('E', 'A', 'II', 'user:,assistant:'), ('S', 'A', 'II', 'user:,assistant:'), ('U', 'U', 'II', 'assistant:,user:'), ('A', 'A', 'II', 'user:,assistant:')),
edit(mid, letter, needs, nxt, price, role) AS (VALUES ('E', 'D', NULL, 'E', 2, NULL), ('S', 'D', NULL, 'S', 2, NULL), ('U', 'D', NULL, 'U', 2, NULL), ('A', 'D', NULL, 'A', 2, NULL),
  ('E', 'R', NULL, 'U', 1, 'user'), ('S', 'R', NULL, 'U', 1, 'user'), ('U', 'R', NULL, 'A', 1, 'assistant'), ('A', 'R', NULL, 'U', 1, 'user'),
  ('E', 'K', 's', 'S', 0, NULL), ('E', 'K', 'u', 'U', 0, NULL), ('S', 'K', 'u', 'U', 0, NULL), ('A', 'K', 'u', 'U', 0, NULL), ('U', 'K', 'a', 'A', 0, NULL)),
way AS (SELECT st, ins, put, letter, needs, nxt, price + 5 * length(ins) AS price, role FROM run JOIN edit USING (mid)),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 'E' AS st, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS made FROM s
  UNION ALL
  SELECT conv_id, i, st, cost, audit, made FROM (
    SELECT conv_id, i, st, cost, audit, made, row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) AS best FROM (
      SELECT f.conv_id, f.i, nxt AS st, cost + price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost, audit || ins || letter AS audit,
             list_concat(made, CASE WHEN ins = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(put, ',') END, CASE WHEN letter = 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(way.role, f.role) || ':' || f.text] END) AS made
      FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN way ON way.st = dp.st
      WHERE (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (needs IS NULL OR needs = ini)))
  WHERE best = 1
),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY total, whole) AS best FROM (
        SELECT dp.conv_id, cost + 5 * length(ins) AS total, audit || ins AS whole, list_concat(made, CASE WHEN ins = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(put, ',') END) AS made
        FROM dp JOIN s ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.n = dp.i JOIN run ON run.st = dp.st AND mid IN ('E', 'A')))
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(total, 0) AS BIGINT) AS cost, coalesce(whole, '') AS audit, sha256(coalesce(array_to_string(made, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND best = 1
"""


QUERIES = {f.__name__: f for f in (op1_packing, op2_ngram_join, op3_mixing, op4_substring_dedup, op5_simhash, op6_toxicity, op7_language_id, op8_line_dedup, op9_top_k, op10_suffix_dedup, op11_decontamination, op12_prefix_trie, op13_structure_repair)}
ORACLES = {"op2_ngram_join": OP2_SQL, "op3_mixing": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op8_line_dedup": OP8_SQL, "op9_top_k": OP9_SQL, "op10_suffix_dedup": OP10_SQL, "op11_decontamination": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_structure_repair": OP13_SQL}
