"""Line dedup with a suffix array over line ids.

All documents' lines are one sequence, ordered by document and line. Prefix doubling ranks
suffixes by their first 1, 2, 4, ... lines: a rank at twice the length is the rank of a
pair of ranks, one per half. Ranks follow the order of a suffix array and each round sorts
only distinct pairs, in ranges over the cluster; a suffix leaves as soon as its prefix
occurs once, since nothing longer can repeat.

Suffixes whose common prefix holds enough words lie in one interval of that array. The
shortest such prefix of a suffix is its window; equal windows (the same ranks of their
first and last 2^k lines and the same length) are one interval of the longest common
prefix. Windows are taken forwards from each line and backwards from each line, so their
union is exactly the union of all maximal repeated runs of at least ``MIN_WORDS`` words: a
run's line either starts a window that ends in the run, or lies in the window that ends
with the run. The first suffix of an interval stays, the windows of all others are deleted, also where
they overlap the first.
Ranks are needed up to the length of the longest window only, so doubling stops there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adloom.llm.common import ROW_BITS, ordered_rows, unused
from adloom.workspace import materialize

#: Runs of fewer words are left alone: short lines recur by chance.
MIN_WORDS = 50

#: A document is named by its id and a hash of its text.
KEY = ["id", "h"]
_LINES = "id long, h long, line int, x long, y long, ahead int, back int"


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the last line of the shortest run of ``least`` words that starts
    there, and the first line of the shortest that ends there; -1 where there is none."""
    n, total = len(words), np.concatenate([[0], np.cumsum(words)])
    ahead = np.searchsorted(total, total[:-1] + least, "left") - 1
    back = np.searchsorted(total, total[1:] - least, "right") - 1
    return np.where(ahead < n, ahead, -1), np.maximum(back, -1)


def _lines(documents: DataFrame, least: int) -> DataFrame:
    """One row per line: two hashes, which name its text, and the ends of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, h, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                lines = text.encode().split(b"\n")
                n = len(lines)
                ahead, back = windows(np.fromiter((len(x.split()) for x in lines), np.int64, n), least)
                columns = [
                    np.full(n, id_),
                    np.full(n, h),
                    np.arange(n, dtype=np.int32),
                    np.fromiter(map(xxhash.xxh64_intdigest, lines), np.uint64, n).view(np.int64),
                    np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in lines), np.uint64, n).view(np.int64),
                    ahead.astype(np.int32),
                    back.astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in _LINES.split(", ")])

    return documents.select(*KEY, "text").mapInArrow(run, _LINES)


def _rank(pairs: DataFrame, name: str) -> DataFrame:
    """Numbers ``r`` in the order of the distinct pairs (x, y) that occur more than once."""
    often = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x", "y")
    order = ordered_rows(often, [F.col("x"), F.col("y")], name)
    return order.select("x", "y", (F.col("part") * F.lit(1 << ROW_BITS) + F.col("row")).alias("r"))


def _ranked(pairs: DataFrame, name: str) -> DataFrame:
    """``pairs`` (x, y and more) that occur more than once, with their rank instead."""
    return materialize(pairs.join(_rank(pairs, f"{name}-order"), ["x", "y"]).drop("x", "y"), name)


def deletions(documents: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``id``, ``h``, ``runs`` (first and last line of what goes) of documents that lose lines.

    ``documents`` has ``id``, ``h`` and ``text``, none of them null; of rows equal in id and
    h one is looked at.
    """
    lines = materialize(_lines(documents, least).dropDuplicates([*KEY, "line"]), "lines")
    level = _ranked(lines, "ranks-0")
    ahead = level.where("ahead >= 0").select(*KEY, F.col("line").alias("first"), F.col("ahead").alias("last"))
    back = level.where("back >= 0").select(*KEY, F.col("back").alias("first"), F.col("line").alias("last"))
    n = F.col("last") - F.col("first") + 1
    depth = F.length(F.bin(n)) - 1  # the largest power of two that is no longer than the window
    whole = materialize(ahead.unionByName(back).distinct().withColumn("k", depth), "windows")
    level = level.select(*KEY, "line", "r")
    found = whole.withColumns({"r1": F.lit(0).cast("long"), "r2": F.lit(0).cast("long")}).where("false")
    deepest = whole.agg(F.max("k")).first()[0]
    for k in range(0 if deepest is None else deepest + 1):
        # A window of this size lies under two prefixes of 2^k lines, its first and its last.
        start = level.select(*KEY, F.col("line").alias("first"), F.col("r").alias("r1"))
        end = level.select(*KEY, (F.col("line") + (1 << k) - 1).alias("last"), F.col("r").alias("r2"))
        own = whole.where(F.col("k") == k)
        found = found.unionByName(own.join(start, [*KEY, "first"]).join(end, [*KEY, "last"]))
        if k < deepest:
            half = level.select(*KEY, (F.col("line") - (1 << k)).alias("line"), F.col("r").alias("y"))
            pairs = level.withColumnRenamed("r", "x").join(half, [*KEY, "line"])
            level = _ranked(materialize(pairs, f"pairs-{k}"), f"ranks-{k + 1}")
    found = materialize(found.withColumn("n", n), "intervals")
    interval, place = ["n", "r1", "r2"], F.struct(*KEY, "first")
    kept = found.groupBy(*interval).agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("c"))
    later = found.join(kept.where("c > 1"), interval).where(place > F.col("kept"))
    return later.groupBy(*KEY).agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def _cut(texts: pd.Series, twins: pd.Series, firsts: pd.Series, lasts: pd.Series) -> pd.DataFrame:
    """``twins``: whether an equal row came before, so that the whole text is a later copy."""
    out = []
    for text, twin, first, last in zip(texts, twins, firsts, lasts):
        if first is None and not twin:
            out.append((text, 0))
            continue
        lines = text.split("\n")
        ends = np.zeros(len(lines) + 1, np.int64)
        if twin:
            first, last = [0], [len(lines) - 1]
        np.add.at(ends, np.asarray(first), 1)
        np.add.at(ends, np.asarray(last) + 1, -1)
        gone = np.cumsum(ends[:-1]) > 0
        out.append(("\n".join(x for x, g in zip(lines, gone) if not g), int(gone.sum())))
    return pd.DataFrame(out, columns=["text", "gone"])


def dedup_lines(documents: DataFrame, least: int = MIN_WORDS, removed: str | None = None) -> DataFrame:
    """``documents`` without the later copies of repeated line runs.

    A run is one or more whole lines, equal to the last character, with at least ``least``
    words together. Of all its copies the first stays, by doc_id (null last), then by a
    hash of the text, then by line; copies inside one document count too, and of rows equal
    in doc_id and text one stays whole. Copies that overlap the first inside one document
    take the lines they share with it along, so a periodic run shrinks to one period, which
    may have fewer than ``least`` words. Every row is kept: a document that consisted of
    copies has an empty text. Null and empty texts are left as they are. Other columns are
    passed on, but one named n_chars gets the new length where a text has changed.
    ``removed`` names a column to add, the number of deleted lines.
    """
    id_, h, key, key_h, runs, nth, cut = (unused(documents, f"_{c}") for c in ("id", "h", "k", "kh", "runs", "nth", "cut"))
    named = documents.withColumns({
        id_: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), h: F.xxhash64("text"),
    })
    texts = named.where(F.col("text").isNotNull()).select(F.col(id_).alias("id"), F.col(h).alias("h"), "text")
    gone = deletions(texts, least).select(F.col("id").alias(key), F.col("h").alias(key_h), F.col("runs").alias(runs))
    order = Window.partitionBy(id_, h).orderBy(F.lit(0))
    joined = named.join(gone, (F.col(id_) == F.col(key)) & (F.col(h) == F.col(key_h)), "left")
    joined = joined.withColumn(nth, F.row_number().over(order))
    long_enough = F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")) >= least
    twin = F.when((F.col(nth) > 1) & F.col("text").isNotNull(), long_enough).otherwise(F.lit(False))
    cut_lines = F.pandas_udf(_cut, "text string, gone int")
    result = joined.withColumn(cut, cut_lines("text", twin, F.col(runs)["first"], F.col(runs)["last"]))
    out = []
    for c in documents.columns:
        if c.lower() == "text":
            out.append(F.col(f"{cut}.text").alias(c))
        elif c.lower() == "n_chars":
            new = F.length(f"{cut}.text").cast(documents.schema[c].dataType)
            out.append(F.when(F.col(f"{cut}.gone") > 0, new).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return result.select(*out, *([F.col(f"{cut}.gone").alias(removed)] if removed else []))
