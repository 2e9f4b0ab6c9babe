"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adloom.llm import (
    bpe, fim, linededup, minhash, mixing, multi_index, shards, simhash, substrings, token_counts, toxicity, urls,
    whitening,
)

SHARDS = 8


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_read(spark, sf_dir, "documents"), SHARDS)


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = mixing.mix_copies(_read(spark, sf_dir, "documents"))
    return copies.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_read(spark, sf_dir, "embeddings"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_fingerprints(_read(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(documents, removed="removed_lines")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(_read(spark, sf_dir, "documents"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_read(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_shards, op2_mix, op3_neighbours, op4_urls, op5_token_counts,
        op6_simhash, op7_minhash, op8_lines, op9_toxicity, op10_bpe,
        op11_fim, op12_substrings, op13_whitening,
    )
}
