"""The registered corpus queries, with production parameters over whole tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import langid, mixing, neighbours, packing, simhash, substring, telephony, tokencount, urls, warc

QUERIES: dict = {}
ORACLE: dict[str, str] = {"op5_mixing": mixing.ORACLE_SQL}


def registered(f):
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registered
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@registered
def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeats(read(spark, sf_dir, "documents")).drop("tag")


@registered
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), limit=4096)


@registered
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@registered
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


@registered
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.seed_labels(spark))


@registered
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=1)


@registered
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


@registered
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.describe(warc.derive(warc.responses(read(spark, sf_dir, "pages"))))


@registered
def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.media_features(telephony.text_media(read(spark, sf_dir, "documents")))
