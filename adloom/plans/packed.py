"""Training tokens packed by instance into arrays, and numpy passes over them.

A fit to convergence reads the same tokens a hundred times, so they are numbered and packed
once: a block holds some thousand instances as labels, numbers of tokens and feature places.
A pass sends each task dense vectors of trial weights, one number per feature, under the limit
of every broadcast. A task sums its log losses and, for one of the trials, the gradient by
place; sums of tasks meet in a shuffle. Tokens whose features are too many for that, or that
have an instance above a task's fair share, are not packed; see ``vector_free``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.operators.lookup import broadcast_limit, enough_parts, lookup_join
from adloom.operators.ranking import dense_index
from adloom.plans.training import Part, has_hot_instance, instance_sizes
from adloom.workspace import materialize, release, scratch

# Tokens of a block at most, but for an instance that has more, and of a task of a pass.
BLOCK_TOKENS, TASK_TOKENS = 1 << 19, 1 << 22

BLOCK = "n int, labels binary, sizes binary, places binary"


@dataclass
class Packed:
    places: DataFrame  # (sign, place), each known feature numbered from 0
    n_features: int
    blocks: DataFrame  # instances as little-endian arrays: int8 labels, int32 sizes and places
    n_tokens: int

    def release(self) -> None:
        release(self.blocks)
        release(self.places)

    def vectors(self, table: DataFrame, *values: Column) -> tuple[np.ndarray, np.ndarray]:
        """The values of ``table`` by place, 0 elsewhere, a row for each; and the places that it has."""
        found = table.select("place", *[v.alias(f"v{i}") for i, v in enumerate(values)]).toArrow()
        at = found["place"].to_numpy()
        dense = np.zeros((len(values), self.n_features))
        for i in range(len(values)):
            dense[i, at] = found[f"v{i}"].to_numpy()
        return dense, at

    def table(self, at: np.ndarray, **values: np.ndarray) -> DataFrame:
        """``(sign, place)`` of the places ``at`` with named values, by way of the driver."""
        spark = self.places.sparkSession
        named = spark.createDataFrame(pa.table({"place": pa.array(at, pa.int32()), **values}))
        return self.places.join(named, "place").select("sign", "place", *values)

    @contextmanager
    def scanned(self, trials: np.ndarray, gradient: bool = True, among: np.ndarray | None = None) -> Iterator[DataFrame]:
        """``(place, g, touched)``: the loss's gradient at the first trial, ``among`` some places, and how
        many tokens have the place. The summed log loss of trial ``i`` is the ``g`` of place ``-1 - i``.

        The frame can be read until the block ends.
        """
        spark = self.blocks.sparkSession
        context, n = spark.sparkContext, self.n_features
        sent = context.broadcast((trials, among))

        def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return pass_blocks(batches, *sent.value, gradient)

        tasks = max(2 * context.defaultParallelism, -(-self.n_tokens // TASK_TOKENS))
        parts = self.blocks.drop("n").coalesce(tasks).mapInArrow(scan, "place int, g double, touched bigint")
        try:
            yield parts.groupBy("place").agg(F.sum("g").alias("g"), F.sum("touched").alias("touched"))
        finally:
            sent.destroy()

    def evaluated(self, trials: np.ndarray, gradient: bool = True, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The summed loss of each trial, and the gradient at the first one, on the driver."""
        with self.scanned(trials, gradient, among) as found:
            rows = found.select("place", "g").toArrow()
        at, value = rows["place"].to_numpy(), rows["g"].to_numpy()
        loss, slope = np.zeros(len(trials)), np.zeros(self.n_features)
        loss[-1 - at[at < 0]] = value[at < 0]
        slope[at[at >= 0]] = value[at >= 0]
        return loss, slope


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ``(instance_id, label, place)``, which come sorted by instance; null is an id as well."""
    held, rows = [], 0

    def blocks(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
        ids = table["instance_id"].combine_chunks()
        other = pc.fill_null(pc.not_equal(ids[1:], ids[:-1]), True).to_numpy(zero_copy_only=False)
        missing = pc.is_null(ids).to_numpy(zero_copy_only=False)
        other &= ~(missing[1:] & missing[:-1])
        starts = np.r_[0, np.flatnonzero(other) + 1]
        end = len(ids) if last else int(starts[-1])  # the last instance may go on
        starts = starts if last else starts[:-1]
        if not end:
            return None, table
        label = np.maximum.reduceat(table["label"].to_numpy()[:end].astype("<i1"), starts)
        sizes = np.diff(np.r_[starts, end]).astype("<i4")
        places = table["place"].to_numpy()[:end].astype("<i4")
        row = {"n": len(sizes), "labels": label.tobytes(), "sizes": sizes.tobytes(), "places": places.tobytes()}
        return pa.RecordBatch.from_pylist([row], SCHEMA), table.slice(end)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_TOKENS:
            block, rest = blocks(pa.Table.from_batches(held), False)
            if block:
                yield block
            held, rows = rest.to_batches(), rest.num_rows if block else 0  # a long instance: look again after as many rows
    held = [b for b in held if b.num_rows]
    if held:
        yield blocks(pa.Table.from_batches(held), True)[0]


SCHEMA = pa.schema([("n", pa.int32()), ("labels", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary())])


def pass_blocks(batches: Iterable[pa.RecordBatch], trials: np.ndarray, among: np.ndarray | None, gradient: bool) -> Iterator[pa.RecordBatch]:
    """What one task adds to the losses, gradient and counts of ``Packed.scanned``."""
    n = trials.shape[1]
    loss, slope, touched = np.zeros(len(trials)), np.zeros(n), np.zeros(n, np.int64)
    for batch in batches:
        for i in range(batch.num_rows):
            label, sizes, places = (
                np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("labels", "<i1"), ("sizes", "<i4"), ("places", "<i4"))
            )
            starts = np.cumsum(sizes) - sizes
            for k in reversed(range(len(trials))):  # the first one comes last: its margins give the gradient
                z = np.add.reduceat(trials[k][places], starts)
                shrunk = np.exp(-np.abs(z))
                loss[k] += np.sum(np.maximum(z, 0.0) - label * z + np.log1p(shrunk))
            if gradient:
                p = np.where(z >= 0, 1.0, shrunk) / (1.0 + shrunk)
                slope += np.bincount(places, np.repeat(p - label, sizes), n)
                touched += np.bincount(places, minlength=n)
    found = np.flatnonzero(touched if among is None else touched * among)
    at = np.r_[-1 - np.arange(len(trials)), found].astype(np.int32)
    counts = np.r_[np.zeros(len(trials), np.int64), touched[found]]
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.r_[loss, slope[found]]), pa.array(counts)], ["place", "g", "touched"])


def packed_part(instances_tokens: DataFrame, features: DataFrame) -> Part | None:
    """Tokens of known features with binary labels, packed; None where they are not to be packed."""
    spark = instances_tokens.sparkSession
    known = features.select("sign").where(F.col("sign").isNotNull()).distinct()
    n = known.count()
    if not n or 2 * 8 * n > broadcast_limit(spark):  # a vector goes through the driver, two at most at once
        return None
    label = F.when(F.col("label") > 0, 1).otherwise(0).alias("label")  # counts above one are clicks too
    with scratch(spark):
        places = dense_index(known, "sign", "place").select("sign", F.col("place").cast("int").alias("place"))
        places = materialize(places, "places", lasting=True)
        tokens = instances_tokens.select("instance_id", label, "sign")
        kept = lookup_join(tokens, places, "sign", "inner", right_rows=n).select("instance_id", "label", "place")
        most, total = instance_sizes(kept)
        if has_hot_instance(kept, most, total):
            release(places)
            return None
        together = kept.repartition(enough_parts(spark, total), "instance_id").sortWithinPartitions("instance_id")
        blocks = materialize(together.mapInArrow(pack, BLOCK), "blocks", lasting=True)
    n_instances = blocks.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    hot = lambda key: kept.select(key).where("false")
    return Part(kept, n_instances, hot, packed=Packed(places, n, blocks, total))
