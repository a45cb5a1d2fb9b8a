"""A training corpus from raw documents: five stages, each an operator of
``glotspark.llm`` that works on all that the stage before it kept.

1. toxicity: documents scored 0.5 or more go.
2. line dedup: repeated lines go, the earliest stays.
3. n-gram Jaccard join: one document of each near-duplicate group stays.
4. mixing: each source gives its share of words.
5. packing: the mix as sequences of 4096 tokens.

Each stage's result is written as Parquet and read again, so a lost executor or
driver costs one stage. SQL can't express these stages (ORACLE_SQL is None);
tests hold each stage's result against a plain version or what it must contain.
``glotspark.llm.stages`` states what becomes of nulls, empty texts, repeated rows
and columns of any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glotspark.llm import shared, stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("line dedup", stages.dedup_lines),
    ("n-gram Jaccard join", stages.dedup_documents),
    ("mixing sources to target weights", stages.mix_sources),
    ("packing", stages.pack_sequences),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; the result of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = shared.written(docs)
    return docs
