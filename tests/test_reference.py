"""The reference's operators: results against DuckDB, properties, plans."""

from __future__ import annotations

import contextlib
import sys
from types import SimpleNamespace

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glotspark.functions.text import bounded, html_text, lines, pieces, rejoined
from glotspark.operators.backends import M2M100, Marked, PlainText, Tesseract
from glotspark.operators.pairs import training_pairs
from glotspark.operators.recognize import line_text, recognize, recognize_spans
from glotspark.operators.translate import glossary_column, pivot, translate, translate_distinct, translate_documents, translate_words
from glotspark.plans import relational, timely
from glotspark.plans.queries import EN_KO, ORACLES, QUERIES
from glotspark.plans.routes import language_pairs, read_and_translate, routed
from glotspark.sources.tables import images
from glotspark.streaming.realtime import translated_stream
from tests.compare import same_rows
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ours, theirs = same_rows(QUERIES[name](spark, SF), ORACLES[name], SF)
    assert ours == theirs and ours


@pytest.mark.parametrize("name", sorted(timely.QUERIES | relational.QUERIES))
def test_other_query(spark, name):
    ours, theirs = same_rows((timely.QUERIES | relational.QUERIES)[name](spark, SF), (timely.ORACLES | relational.ORACLES)[name], SF)
    assert ours == theirs and ours


def test_spans_under_a_key_of_the_same_name(spark):
    some = spark.createDataFrame([("k", b"a\nb"), ("n", None)], "text string, content binary")
    got = recognize_spans(some, PlainText(), "text")
    assert got.columns[:3] == ["text_", "pos", "text"] and [tuple(r)[:3] for r in got.collect()] == [("k", 0, "a"), ("k", 1, "b")]


def test_images_with_nulls_and_shared_ids(spark, tmp_path):
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, "c"), (2, None), (3, ""), (None, None)]
    spark.createDataFrame(rows, "item_id long, text string").repartition(2).write.parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("ref_image_files", "ref_image_stream"):
        ours, theirs = same_rows(QUERIES[name](spark, str(tmp_path)), ORACLES[name], str(tmp_path))
        assert ours == theirs and len(ours) == len(rows)


def test_entry_registers_all(spark):
    import __spark_entry__ as e

    assert {*QUERIES, *timely.QUERIES, *relational.QUERIES} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab .!?\n", max_size=40)), min_size=1, max_size=6))
def test_cutting_is_reversible(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    back = rejoined(lines(df), ["id"], "line").join(df.select("id", F.concat_ws("", pieces(F.col("text"), 7)).alias("p"), F.exists(pieces(F.col("text"), 7), lambda x: F.length(x) > 7).alias("long")), "id")
    for r in back.collect():
        assert r.text == texts[r.id] and r.p == (texts[r.id] or "") and not r.long


def test_distinct_equals_direct_and_ignores_partitions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["x", "y", None, "x", ""] * 5)], "id int, text string")
    direct = {r.id: r.translated for r in translate(df, Marked()).collect()}
    assert direct == {r.id: r.translated for r in translate_distinct(df.repartition(7), Marked()).collect()}
    assert direct[2] is None and direct[0] == "[en>ko] x"


def test_pivot_runs_each_step_once(spark):
    df = spark.createDataFrame([(1, "a", "fr"), (2, None, "de")], "id int, text string, lang string")
    out = pivot(df, Marked(), F.col("lang"), "ko")
    assert [(r.en, r.translated) for r in out.orderBy("id").collect()] == [("[fr>en] a", "[en>ko] [fr>en] a"), (None, None)]
    assert plan(out).count("ArrowEvalPython") == 2 and plan(out).count("translated(") == 2


def test_filters_before_the_model_reach_the_scan(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'")
    text = plan(translate(docs.select("doc_id", "text"), Marked()).filter(F.col("translated").isNotNull()))
    assert text.count("ArrowEvalPython") == 1 and "EqualTo(lang,en)" in text


def test_documents_line_by_line(spark):
    df = spark.createDataFrame([(1, "b\na\n\nb"), (2, None)], "id int, text string")
    out = {r.id: r.translated for r in translate_documents(df, Marked(), ["id"]).collect()}
    assert out == {1: "[en>ko] b\n[en>ko] a\n[en>ko] \n[en>ko] b", 2: None}


def test_rows_that_share_a_key_stay_apart_and_names_may_clash(spark):
    df = spark.createDataFrame([(1, "a\nb", 0, "t", "x", "y"), (1, "c\nd", 0, "t", "x", "y"), (1, "c\nd", 0, "t", "x", "y")], "id int, text string, pos int, t string, once string, made string")
    got = sorted(r.translated for r in translate_documents(df, Marked(), ["id"]).collect())
    assert got == ["[en>ko] a\n[en>ko] b", "[en>ko] c\n[en>ko] d", "[en>ko] c\n[en>ko] d"]
    assert sorted((r.translated, r.t, r.once, r.made) for r in translate_distinct(df, Marked()).collect())[0] == ("[en>ko] a\nb", "t", "x", "y")
    words = translate_words(df, spark.createDataFrame([("a\nb", "z")], "src string, tgt string"))
    assert sorted(r.translated for r in words.collect()) == ["c\nd", "c\nd", "z"] and words.columns == [*df.columns, "translated"]
    assert [c for c in lines(df).columns if c == "pos"] == ["pos"]
    routed_ = routed(spark.createDataFrame([("en", "mine")], "lang string, src string"), language_pairs(spark), "ko")
    assert routed_.first().src == "mine"


def test_rows_are_told_apart_by_content_alone(spark):
    at = ["2024-01-01 00:00:00.000001", "2024-01-01 00:00:00.000002"]
    rows = [(at[0], None, "a", "x y"), (at[1], None, "a", "x y"), (at[0], "a", None, "x y"), (at[0], None, "a", ""), (at[0], None, "a", None)]
    df = spark.createDataFrame(rows + [rows[0]] * 2500, "at string, l string, r string, text string").withColumn("at", F.col("at").cast("timestamp")).repartition(5)
    glossary = spark.createDataFrame([("x", "z")], "src string, tgt string")
    for out, x in ((translate_words(df, glossary), "z y"), (translate_documents(df, Marked(), ["at", "l", "r"]), "[en>ko] x y")):
        got = {(r.at.microsecond, r.l, r.r, r.translated): r.n for r in out.groupBy("at", "l", "r", "translated").agg(F.count("*").alias("n")).collect()}
        empty = "" if x == "z y" else "[en>ko] "
        assert got == {(1, None, "a", x): 2501, (2, None, "a", x): 1, (1, "a", None, x): 1, (1, None, "a", empty): 1, (1, None, "a", None): 1}
        assert "monotonically" not in plan(out)
    assert translate_documents(df.limit(0), Marked(), ["at"]).count() == 0 and translate_words(df.limit(0), glossary).count() == 0


def test_long_lines_go_to_the_model_in_pieces(spark):
    class Short(Marked):
        def load(self):
            def run(texts, source, target):
                assert all(len(t) <= 20 and t == t.strip() for t in texts)
                return [f"<{t}>" for t in texts]

            return run

    df = spark.createDataFrame([(1, "One two.  Three four five six. " + "y" * 45 + "\nshort"), (2, " " * 30)], "id int, text string")
    out = {r.id: r.translated for r in translate_documents(df, Short(), ["id"], longest=20).collect()}
    assert out == {1: "<One two.>  <Three four five>  <six.> <" + "y" * 19 + "><" + "y" * 20 + "><" + "y" * 6 + ">\n<short>", 2: " " * 30} or out[1].replace("<", "").replace(">", "") == df.first().text


def test_words_of_tesseract_become_lines(monkeypatch):
    found = {"text": ["", "Hello", "world", "", "next", " ", "line"], "conf": ["-1", 96.5, "90", "-1", 91, -1, 95], "page_num": [1] * 7, "block_num": [1, 1, 1, 1, 1, 1, 1], "par_num": [0, 1, 1, 1, 1, 1, 1], "line_num": [0, 1, 1, 2, 2, 2, 2]}
    found |= {c: [0, 1, 2, 3, 4, 5, 6] for c in ("left", "top", "width", "height")}
    tesseract = SimpleNamespace(image_to_data=lambda image, lang, config, output_type: found, Output=SimpleNamespace(DICT="dict"))
    monkeypatch.setitem(sys.modules, "pytesseract", tesseract)
    monkeypatch.setitem(sys.modules, "PIL", SimpleNamespace())
    monkeypatch.setitem(sys.modules, "PIL.Image", SimpleNamespace(open=lambda x: x))
    spans = Tesseract().load()([b"x"])[0]
    assert line_text(spans) == "Hello world\nnext line" and [s["line"] for s in spans] == [0, 0, 1, 1]


def test_glossary_by_join_and_by_map_agree(spark):
    df = spark.createDataFrame([(1, "the cat and  the dog"), (2, ""), (3, None)], "id int, text string")
    glossary = spark.createDataFrame(list(EN_KO.items()), "src string, tgt string")
    joined = {r.id: r.translated for r in translate_words(df, glossary).collect()}
    mapped = {r.id: r.t for r in df.select("id", glossary_column(F.col("text"), EN_KO).alias("t")).collect()}
    assert joined == mapped and joined[3] is None


def test_recognition(spark, tmp_path):
    for i, text in enumerate(("one\ntwo", "zwei", "drei")):
        (tmp_path / f"{i}.img").write_text(text)
    found = images(spark, str(tmp_path), "*.img")
    got = sorted((r.path[-5:], r.text, r.translated) for r in read_and_translate(found, PlainText(), Marked()).collect())
    assert got == [("0.img", "one\ntwo", "[en>ko] one\ntwo"), ("1.img", "zwei", "[en>ko] zwei"), ("2.img", "drei", "[en>ko] drei")]
    spans = recognize_spans(found, PlainText()).orderBy("path", "pos").collect()
    assert [(s.pos, s.text, s.top) for s in spans if s.path.endswith("0.img")] == [(0, "one", 0), (1, "two", 16)]
    none = spark.createDataFrame([(1, None)], "id int, content binary")
    assert recognize(none, PlainText()).first().text is None


def test_stream_gives_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    run = lambda: translated_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), PlainText(), Marked(), once=True).awaitTermination()
    (folder / "a").write_text("first")
    run()
    (folder / "b").write_text("second")
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r.translated for r in rows) == ["[en>ko] first", "[en>ko] second"]


def test_missing_libraries_are_an_error():
    for backend in (Tesseract(), M2M100()):
        with pytest.raises(RuntimeError, match="needs"):
            backend.load()


@given(st.text(alphabet="ab .!?\n。", max_size=200), st.integers(1, 9))
def test_bounded_pieces(text, longest):
    got = bounded(text, len, longest)
    assert "".join(got) == text and all(len(p) <= longest for p in got)


def test_a_piece_that_cannot_be_cut_is_an_error():
    with pytest.raises(ValueError, match="more than 2"):
        bounded("ab", lambda t: 3, 2)


@pytest.fixture
def characters(monkeypatch):
    """Libraries whose model gives upper case, each # eight times; a token a
    character, two special ones more; lengths cut as the real ones cut them."""

    class Tokenizer:
        eos_token_id = 2

        def __call__(self, texts, return_tensors=None, padding=False, truncation=False, max_length=None):
            ids = [[9, *(ord(c) + 10 for c in t), 2] for t in ([texts] if isinstance(texts, str) else texts)]
            ids = [[*x[: max_length - 1], 2] if truncation and len(x) > max_length else x for x in ids]
            return {"input_ids": ids[0] if isinstance(texts, str) else ids}

        def get_lang_id(self, lang):
            return 8

        def batch_decode(self, rows, skip_special_tokens):
            return ["".join(chr(x - 10) for x in row if x >= 10).strip() for row in rows.tolist()]

    class Model:
        calls = []

        def eval(self):
            return self

        def generate(self, input_ids, forced_bos_token_id, max_new_tokens=199):
            self.calls.append(max(map(len, input_ids)))
            said = [[forced_bos_token_id, *(ord(d) + 10 for x in ids[1:-1] for d in chr(x - 10).upper() * (8 if chr(x - 10) == "#" else 1)), 2][:max_new_tokens] for ids in input_ids]
            return np.array([[2, *x, *[1] * (max(map(len, said)) - len(x))] for x in said])

    model = Model()
    model.calls = []
    load = lambda made: SimpleNamespace(from_pretrained=lambda name, revision: made)
    monkeypatch.setitem(sys.modules, "transformers", SimpleNamespace(M2M100Tokenizer=load(Tokenizer()), M2M100ForConditionalGeneration=load(model)))
    monkeypatch.setitem(sys.modules, "torch", SimpleNamespace(no_grad=contextlib.nullcontext))
    return model


def test_long_texts_are_translated_whole(characters):
    run = M2M100().load()
    texts = ["short", "", "A line. " * 400 + "The end", "x" * 3000, "one two\n\n three " * 90, "b" * 400, " "]
    assert [" ".join(t.split()) for t in run(texts, "en", "ko")] == [" ".join(t.upper().split()) for t in texts]
    assert max(characters.calls) <= 512 and run([], "en", "ko") == []
    assert run(["one  two\n" * 100 + "z"], "en", "ko") == ["ONE  TWO\n" * 100 + "Z"]


def test_a_translation_that_does_not_end_is_cut_or_an_error(characters):
    assert M2M100(longest_output=50).load()(["a #### #### b"], "en", "ko") == ["A " + "#" * 32 + " " + "#" * 32 + " B"]
    with pytest.raises(ValueError, match="doesn't end"):
        M2M100(longest_output=8).load()(["#"], "en", "ko")


def test_routes_and_pairs(spark):
    docs = spark.createDataFrame([(1, "en"), (2, "fr"), (3, "xx"), (4, None)], "id int, lang string")
    assert sorted((r.id, r.via) for r in routed(docs, language_pairs(spark), "ko").collect()) == [(1, None), (2, "en")]
    pairs = spark.createDataFrame([("a b", "c d"), ("a b", "c d"), ("a", "x" * 10), (None, "y"), (" ", "z")], "src_text string, tgt_text string")
    assert [(r.src_text, r.tgt_text) for r in training_pairs(pairs).collect()] == [("a b", "c d")]


def test_html(spark):
    df = spark.createDataFrame([("<p>a &lt;b&gt;</p><script>x</script><!-- c --><div>d<br>e</div>",)], "h string")
    assert df.select(html_text(F.col("h")).alias("t")).first().t == "a <b>\nd\ne"


def test_translators_get_texts_by_a_few_megabytes(spark):
    class Sizes:
        def load(self):
            return lambda texts, source, target: [f"{len(texts)} {sum(map(len, texts))}" for _ in texts]

    for name in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.unset(name)
    long = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("word "), 4000).alias("text"))
    got = [tuple(map(int, r[0].split())) for r in translate(long, Sizes()).select("translated").distinct().collect()]
    assert max(n for n, _ in got) <= 1000 and max(size for _, size in got) <= 20 << 20
