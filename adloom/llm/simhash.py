"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if some value lies within r bits of
both. Every distinct fingerprint therefore emits all values within half the radius, and
fingerprints meet on equal values. Each meeting links its members to the smallest of them:
all of them lie within the radius of each other, so no further pair is needed, and a value
meets at most as many fingerprints as its ball holds (65 for radius 2). Links are
deduplicated and their distance is checked before components are built.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import rows_of
from adloom.llm.components import components
from adloom.workspace import materialize

SHINGLE = 3
RADIUS = 2
SEED = 42
_BLOCK = 1 << 16  # shingles whose bits are counted at once


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text's word shingles, as a signed integer."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII space parts words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))
    starts = [e + 1 for e in ends]
    k = min(shingle, len(words))
    hash_, bits, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, _BLOCK):
        to = min(at + _BLOCK, n)
        pairs = zip(starts[at:to], ends[at + k : to + k])
        hashes = np.array([hash_(joined[a:b], SEED) for a, b in pairs], ">u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n).view(">i8")[0])


def with_fingerprint(documents: DataFrame, name: str, shingle: int = SHINGLE) -> DataFrame:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return documents.withColumn(name, run(F.coalesce(F.col("text"), F.lit(""))))


def ball(value: Column, radius: int) -> Column:
    """All 64-bit values within ``radius`` bits, as an array."""
    masks = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(64), r)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: value.bitwiseXOR(m))


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (fp, other) that connect all distinct ``fp`` at most ``radius`` bits apart.

    Not every such pair is spelled out: members of a meeting are linked to its smallest.
    Only an even radius can be met in the middle.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    variants = fingerprints.select("fp").distinct().withColumn("variant", F.explode(ball(F.col("fp"), radius // 2)))
    met = variants.withColumn("other", F.min("fp").over(Window.partitionBy("variant")))
    found = met.where("fp <> other").select("fp", "other").distinct()
    return found.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` of every document.

    The component is the smallest doc_id reachable over links. A null or empty text has
    fingerprint zero and links like any other. Repeated rows stay; a null doc_id never
    names a component unless all of it are null. Extra columns are ignored.
    """
    prints = with_fingerprint(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "fp", shingle)
    prints = materialize(prints.select("doc_id", "fp"), "fingerprints")
    roots = components(links(prints, radius)).withColumnRenamed("node", "fp")
    # One row per distinct fingerprint from here to the join back.
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left")
    classes = materialize(classes.withColumn("root", F.coalesce("root", "fp")), "classes")
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(names, "root").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(documents: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``documents`` with one row left of each component, all columns kept.

    The row with the smallest doc_id stays (null last), among equal ids the one with the
    smallest hash of its text, and one of several equal rows.
    """
    prints = with_fingerprint(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "fp", shingle)
    prints = materialize(
        prints.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h")).alias("row"), "fp"), "fingerprints"
    )
    roots = components(links(prints, radius)).withColumnRenamed("node", "fp")
    classes = prints.groupBy("fp").agg(F.min("row").alias("row")).join(roots, "fp", "left")
    kept = classes.groupBy(F.coalesce("root", "fp")).agg(F.min("row").alias("row"))
    return rows_of(documents, kept)
