"""A cleaning pipeline over ``documents``: five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. Stages accept what their operators accept: nulls in any
column, empty texts, repeated rows, empty tables and extra columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from adloom.llm import bpe, linededup, minhash, mixing, toxicity
from adloom.workspace import materialize, release

#: Most rows in one Arrow batch. Spark's 10,000 whole texts would fill workers and off-heap buffers.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``stage`` with Arrow batches of at most ``BATCH_ROWS``; a smaller setting stays.

    The setting is read when the stage's result is written, so it is left to ``run``, or
    whoever calls a stage, to put the old one back.
    """

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        now = int(spark.conf.get(_BATCH))
        spark.conf.set(_BATCH, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@small_batches
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more go; documents stay, if only as empty texts."""
    return linededup.dedup_lines(docs)


@small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, of all empty ones too.

    Near-duplicates have 0.8 or more of their five-word runs in common. SimHash fingerprints
    within 2 bits (``op6``) search; they lose most pairs near 0.8, so signature bands search
    beside them. Exact Jaccard decides on what either finds.
    """
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return mixing.mix(docs)


@small_batches
def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document in the mix the number of tokens and digests of ids and decoded text; the ids are not kept."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-dedup by SimHash balls, MinHash bands and exact Jaccard", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_texts),
]

#: A trained classifier and hashed fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table. The session's batch size is as before afterwards."""
    before = spark.conf.get(_BATCH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for n, (_, stage) in enumerate(STAGES):
            done = materialize(stage(spark, docs, sf_dir), f"stage-{n}")
            if n:
                release(docs)
            docs = done
    finally:
        spark.conf.set(_BATCH, before)
    return docs
