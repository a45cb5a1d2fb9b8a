"""Queries over the driver's tables, with DuckDB SQL for the same rows.

The word list below is a test double: what it gives is not a translation. The
recogniser and translator backends used here are stand-ins (see ``backends``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark.functions.text import html_text, lines, pieces, rejoined
from glotspark.operators.backends import Marked, PlainText
from glotspark.operators.pairs import training_pairs
from glotspark.operators.recognize import recognize, recognize_spans
from glotspark.operators.translate import glossary_column, pivot, translate_distinct, translate_documents
from glotspark.plans.routes import language_pairs, read_and_translate, routed
from glotspark.sources.packed import members, packed_images, write_packed
from glotspark.sources.tables import image_stream, shared_folder, table
from glotspark.streaming.sink import committed, exactly_once

EN_KO = {"the": "그", "The": "그", "and": "그리고", "of": "의", "to": "에게", "in": "안에", "a": "하나의", "is": "이다", "for": "위해", "with": "함께", "that": "저것", "on": "위에", "are": "이다", "be": "있다", "was": "이었다", "at": "에서", "or": "또는", "re": "다시"}
FR_EN = {"le": "the", "la": "the", "les": "the", "et": "and", "de": "of", "un": "a", "une": "a", "dans": "in", "pour": "for", "avec": "with", "est": "is", "sur": "on", "que": "that", "au": "at"}


def _glossary_sql(text: str, glossary: dict[str, str]) -> str:
    known = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in glossary.items()) + "}"
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: coalesce({known}[w], w)), ' ')"


def _english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text", "lang").filter("lang = 'en'").select("doc_id", "text")


def ref_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "n_chars")
    return routed(docs, language_pairs(spark), "ko")


def ref_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_english(spark, sf_dir))


def ref_unique_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_english(spark, sf_dir)).groupBy("line").agg(F.count("*").alias("n"))


def ref_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _english(spark, sf_dir).select("doc_id", F.posexplode(pieces(F.col("text"))).alias("pos", "piece"))
    return cut.select("doc_id", "pos", "piece")


def ref_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejoined(lines(_english(spark, sf_dir)), ["doc_id"], "line")


def ref_translate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct line of the English documents once, put together in order."""
    cut = lines(_english(spark, sf_dir))
    once = cut.select("line").distinct().select(F.col("line").alias("l"), glossary_column(F.col("line"), EN_KO).alias("made"))
    return rejoined(cut.join(once, F.col("line") == F.col("l"), "left"), ["doc_id"], "made", "translated")


def ref_translate_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", "role", glossary_column(F.col("text"), EN_KO).alias("translated"))


def ref_translate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "html")
    return pages.select("page_id", glossary_column(html_text(F.col("html")), EN_KO).alias("translated"))


def ref_pivot_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").filter("lang = 'fr'")
    english = docs.select("doc_id", glossary_column(F.col("text"), FR_EN).alias("en"))
    return english.withColumn("translated", glossary_column(F.col("en"), EN_KO))


def ref_pivot_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = routed(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), language_pairs(spark), "ko").filter("via is not null")
    return pivot(docs, Marked(), F.col("lang"), F.col("tgt")).select("doc_id", "en", "translated")


def ref_translate_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate_documents(_english(spark, sf_dir), Marked(), ["doc_id"])


def ref_translate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate_distinct(table(spark, sf_dir, "conversations"), Marked()).select("conv_id", "turn", "translated")


def _as_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "benchmark", "item_id", "text")
    return docs.select("item_id", F.col("text").cast("binary").alias("content"))


def ref_recognize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize(_as_images(spark, sf_dir), PlainText()).select("item_id", "text")


def ref_recognize_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize_spans(_as_images(spark, sf_dir), PlainText(), "item_id")


def _packed_images(spark: SparkSession, sf_dir: str) -> str:
    """Each text of benchmark, with a line feed after it, as an image of its own in an
    archive; its name is the item's id."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "benchmark", "item_id", "text")
    write_packed(docs.select(F.col("item_id").cast("string").alias("name"), F.concat("text", F.lit("\n")).cast("binary").alias("content")), folder, archive_bytes=16 << 20)
    return folder


def _item(name: str):
    return F.col(name).cast("long").alias("item_id")


def ref_image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images out of archives; the stand-in reads them as text. An image without
    content has no text."""
    found = recognize(packed_images(spark, _packed_images(spark, sf_dir)), PlainText())
    return found.select(_item("name"), F.length("content").cast("long").alias("n_bytes"), F.regexp_replace("text", r"\n$", "").alias("text"))


def ref_image_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same archives as a stream, recognised and translated; each batch reaches
    its table once, and the stream ends."""
    found = read_and_translate(members(image_stream(spark, _packed_images(spark, sf_dir), "*.zip")), PlainText(), Marked())
    result = found.select(_item("name"), F.regexp_replace("translated", r"\n$", "").alias("translated"))
    out = shared_folder(spark)
    exactly_once(result, out, shared_folder(spark), once=True).awaitTermination()
    return committed(spark, out, result.schema)


def ref_recognize_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_and_translate(_as_images(spark, sf_dir), PlainText(), Marked()).select("item_id", "text", "translated")


def ref_training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines(_english(spark, sf_dir))
    pairs = cut.select(F.col("line").alias("src_text"), glossary_column(F.col("line"), EN_KO).alias("tgt_text"))
    return training_pairs(pairs)


QUERIES = {name: f for name, f in globals().items() if name.startswith("ref_")}

_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents WHERE lang = 'en'"
_CLEAN = [
    ("<(script|style|nav|footer)\\b.*?</(script|style|nav|footer)>|<!--.*?-->", " ", "gis"),
    ("<br\\s*/?>|</(p|div|li|h1|h2|h3|tr|title)>", "\n", "gi"),
    ("<[^>]*>", " ", "gs"), ("&lt;", "<", "g"), ("&gt;", ">", "g"), ("&quot;", '"', "g"), ("&#39;", "''", "g"), ("&amp;", "&", "g"),
    ("[ \\t\\r]+", " ", "g"), (" ?\n ?", "\n", "g"), ("\n+", "\n", "g"), ("^[\n ]+|[\n ]+$", "", "g"),
]
_HTML = "html"
for _pattern, _by, _flags in _CLEAN:
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', '{_by}', '{_flags}')"

ORACLES = {
    "ref_route": "SELECT doc_id, lang, n_chars, 'ko' AS tgt, CASE WHEN lang <> 'en' THEN 'en' END AS via FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')",
    "ref_segments": f"SELECT doc_id, CAST(p AS INTEGER) AS pos, line FROM ({_LINES})",
    "ref_unique_segments": f"SELECT line, count(*) AS n FROM ({_LINES}) GROUP BY line",
    "ref_pieces": """
WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+', 0, 's') AS s FROM documents WHERE lang = 'en'),
p AS (SELECT doc_id, flatten(list_transform(s, lambda x: regexp_extract_all(x, '.{1,512}', 0, 's'))) AS p FROM s)
SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS pos, unnest(p) AS piece FROM p
""",
    "ref_reassemble": f"SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM ({_LINES}) GROUP BY doc_id",
    "ref_translate_documents": f"SELECT doc_id, string_agg({_glossary_sql('line', EN_KO)}, chr(10) ORDER BY p) AS translated FROM ({_LINES}) GROUP BY doc_id",
    "ref_translate_conversations": f"SELECT conv_id, turn, role, {_glossary_sql('text', EN_KO)} AS translated FROM conversations",
    "ref_translate_pages": f"SELECT page_id, {_glossary_sql(f'trim({_HTML})', EN_KO)} AS translated FROM pages",
    "ref_pivot_glossary": f"SELECT doc_id, en, {_glossary_sql('en', EN_KO)} AS translated FROM (SELECT doc_id, {_glossary_sql('text', FR_EN)} AS en FROM documents WHERE lang = 'fr')",
    "ref_pivot_backend": "SELECT doc_id, en, '[en>ko] ' || en AS translated FROM (SELECT doc_id, '[' || lang || '>en] ' || text AS en FROM documents WHERE lang IN ('fr', 'de', 'es'))",
    "ref_translate_backend": f"""
WITH s AS (SELECT doc_id, p, line, CASE WHEN length(line) > 1000 THEN flatten(list_transform(regexp_extract_all(line, '[^.!?]*[.!?]+|[^.!?]+', 0, 's'), lambda x: regexp_extract_all(x, '.{{1,1000}}', 0, 's'))) END AS parts FROM ({_LINES})),
t AS (SELECT doc_id, p, CASE WHEN parts IS NULL THEN '[en>ko] ' || line ELSE array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_full_match(x, '\\s*', 's') THEN x
  ELSE regexp_extract(x, '^\\s*') || '[en>ko] ' || regexp_replace(x, '^\\s+|\\s+$', '', 'g') || regexp_extract(x, '\\s*$') END), '') END AS v FROM s)
SELECT doc_id, string_agg(v, chr(10) ORDER BY p) AS translated FROM t GROUP BY doc_id
""",
    "ref_translate_distinct": "SELECT conv_id, turn, '[en>ko] ' || text AS translated FROM conversations",
    "ref_image_files": "SELECT item_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n_bytes, text FROM benchmark",
    "ref_image_stream": "SELECT item_id, '[en>ko] ' || text AS translated FROM benchmark",
    "ref_recognize": "SELECT item_id, text FROM benchmark",
    "ref_recognize_spans": "SELECT item_id, CAST(p AS INTEGER) AS pos, text, CAST(100 AS DOUBLE) AS conf, CAST(p AS INTEGER) AS line, 0 AS \"left\", CAST(16 * p AS INTEGER) AS top, CAST(8 * length(text) AS INTEGER) AS width, 16 AS height FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM benchmark)",
    "ref_recognize_translate": "SELECT item_id, text, '[en>ko] ' || text AS translated FROM benchmark",
    "ref_training_pairs": f"""
WITH p AS (SELECT line AS a, {_glossary_sql('line', EN_KO)} AS b FROM ({_LINES})),
c AS (SELECT DISTINCT trim(a, ' ') AS src_text, trim(b, ' ') AS tgt_text FROM p),
d AS (SELECT *, CAST(('0x' || substr(md5(src_text), 1, 8)) AS BIGINT) % 100 AS s FROM c
      WHERE length(src_text) BETWEEN 1 AND 1000 AND length(tgt_text) BETWEEN 1 AND 1000 AND length(src_text) <= 3 * length(tgt_text) AND length(tgt_text) <= 3 * length(src_text))
SELECT src_text, tgt_text, CASE WHEN s < 5 THEN 'test' WHEN s < 10 THEN 'valid' ELSE 'train' END AS split FROM d
""",
}
