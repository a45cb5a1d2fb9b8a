"""The registered queries on a small table."""

from __future__ import annotations

import pytest

import __spark_entry__
from glotspark.llm.queries import ORACLES, QUERIES
from tests.compare import same_rows
from tests.conftest import SF

COLUMNS = {
    "op1_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op4_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op5_simhash": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_top_k": ["query_id", "rank", "vec_id", "score"],
    "op10_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op11_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op12_prefix_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op13_structure_repair": ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"],
}


def test_all_are_registered():
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_first_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    ours, theirs = same_rows(QUERIES[name](spark, SF), ORACLES[name], SF)
    assert ours == theirs and ours
