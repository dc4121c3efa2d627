"""The corpus pipeline over `documents`: five stages, each written as Parquet and read again as the next one's input.

Language ID drops texts without a recognizable language, SimHash keeps one document of each group of near copies, substring deduplication cuts repeated
passages, mixing takes each source's share (rows twice where the target asks for it), packing cuts what is left into token sequences. All
but the last return the columns of documents.

Tables that a stage stages for itself are deleted when the next stage starts, or by the end of `run`: by then its result is written. Two pipelines in one session must not be interleaved.
Null, empty and very long texts, ties, repeated rows, empty tables and extra columns: as each stage's module states; an empty table passes every stage and gives an empty result.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import langid, mixing, packing, simhash, substring
from glyphmill.llm.common import delete, drop_staged, scope, written
from glyphmill.llm.queries import tokenizer_file


def alone(stage):
    """The stage with what it stages in the pipeline's scope; what the stage before staged goes first."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_staged(spark, "pipeline")
        with scope("pipeline"):
            return stage(spark, docs, sf_dir)

    return run


@alone
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


@alone
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


@alone
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.trim(docs)


@alone
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_taken(docs)


@alone
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: String kernels, SimHash, chunking and packing have no SQL form; tests/llm holds the brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; the result is that of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last:
            delete(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
