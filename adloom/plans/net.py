"""Slot-embedding and multi-hot neural nets, trained by parameter averaging.

Every epoch one Spark job trains a copy of the net on each partition and averages what
the copies changed. The net is bounded by the vocabulary size and is the only thing
that reaches the driver; instances never do. Input rows come from
``operators.vocab.index_rows``: ``(instance_id, label, idx)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adloom.functions import layers
from adloom.operators.metrics import evaluate
from adloom.operators.tokens import shuffle_instances
from adloom.plans.training import Fit, OnIteration, history_frame
from adloom.workspace import materialize

cloudpickle.register_pickle_by_value(layers)  # workers need no copy of the package

# The replaced job's settings.
HIDDEN = (1024, 512, 256, 128, 64)
EMBEDDING = 1
LEARNING_RATE = 1e-3
BATCH = 256
START_SPREAD = 0.1
START_BIAS = 0.1

_CHANGES = "layer string, row int, delta array<double>, weight double"


@dataclass
class Net:
    """Arrays by name: ``emb`` (embedding mode only), ``w1``, ``b1``, ``w2``, ...

    Only the first layer has a ReLU; the others are linear up to the final sigmoid.
    """

    slot_of: np.ndarray  # slot of every multi-hot position
    params: dict[str, np.ndarray]


def new_net(
    slots: DataFrame, mode: str = "embedding", hidden=HIDDEN, embedding=EMBEDDING, seed: int = 0
) -> Net:
    """``slots`` is the bounded slot table ``(slot, slot_idx, n_feats)``."""
    sizes = [r["n_feats"] + 1 for r in slots.orderBy("slot_idx").select("n_feats").collect()]
    slot_of = np.repeat(np.arange(len(sizes)), sizes)
    rng = np.random.default_rng(seed)

    # Single precision, as the replaced net was.
    def spread(*shape: int) -> np.ndarray:
        x = rng.normal(size=shape)
        while (far := np.abs(x) > 2).any():
            x[far] = rng.normal(size=int(far.sum()))
        return (x * START_SPREAD).astype(np.float32)

    params: dict[str, np.ndarray] = {}
    width = len(slot_of)
    if mode == "embedding":
        params["emb"] = spread(width, embedding)
        width = len(sizes) * embedding
    for i, size in enumerate([*hidden, 1], start=1):
        params[f"w{i}"] = spread(width, size)
        params[f"b{i}"] = np.full((1, size), START_BIAS, np.float32)
        width = size
    return Net(slot_of, params)


def _epoch_changes(shared, rate: float, size: int):
    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot_of, start = shared.value
        active, adam = layers.ActiveRows(slot_of, start), layers.Adam(rate)
        params = active.params
        seen, loss = 0, 0.0
        for batch in layers.minibatches(frames, size):
            rows, flat = layers.flatten(batch["idx"])
            flat = active.take_in(flat, adam.m, adam.s)
            label = batch["label"].to_numpy(params["b1"].dtype)
            batch_loss, grads = layers.gradients(active.slot_of, params, rows, flat, label, active.n_slots)
            adam.step(params, grads)
            seen, loss = seen + len(batch), loss + batch_loss
        if not seen:
            return
        for name, new in params.items():
            at = active.all_rows(name, len(new))
            delta = new - start[name][at]
            moved = np.flatnonzero(delta.any(axis=1))
            if not len(moved):
                continue
            yield pd.DataFrame(
                {"layer": name, "row": at[moved].astype(np.int32), "delta": list(delta[moved].astype(float)),
                 "weight": float(seen)}
            )
        yield pd.DataFrame(
            {"layer": ["loss"], "row": [0], "delta": [[loss / seen]], "weight": [float(seen)]}
        )

    return train


def train_epoch(
    rows: DataFrame, net: Net, learning_rate: float = LEARNING_RATE, batch: int = BATCH
) -> tuple[Net, float]:
    """The averaged net after one pass over ``rows`` as partitioned, and its mean loss.

    Copies weigh by their rows. A copy that never saw a parameter row sends nothing and
    counts as no change.
    """
    shared = rows.sparkSession.sparkContext.broadcast((net.slot_of, net.params))
    changes = rows.select("label", "idx").mapInPandas(
        _epoch_changes(shared, learning_rate, batch), _CHANGES
    )
    vector = array_to_vector(F.col("delta"))
    averaged = (
        changes.groupBy("layer", "row")
        .agg(
            Summarizer.mean(vector, F.col("weight")).alias("mean"),
            F.sum("weight").alias("weight"),
        )
        .select("layer", "row", vector_to_array("mean").alias("mean"), "weight")
        .collect()
    )
    loss = next((r for r in averaged if r["layer"] == "loss"), None)
    if loss is None:
        raise ValueError("a net cannot be trained without rows")
    params = {name: value.copy() for name, value in net.params.items()}
    for r in averaged:
        if r["layer"] != "loss":
            share = r["weight"] / loss["weight"]
            params[r["layer"]][r["row"]] += np.asarray(r["mean"]) * share  # keeps the dtype
    shared.unpersist()
    return Net(net.slot_of, params), loss["mean"][0]


def _gradient_sums(shared, size: int):
    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot_of, params = shared.value
        active, sums, loss, seen = layers.ActiveRows(slot_of, params), {}, 0.0, 0
        for batch in layers.minibatches(frames, size):
            rows, flat = layers.flatten(batch["idx"])
            flat = active.take_in(flat, sums)
            label = batch["label"].to_numpy(params["b1"].dtype)
            batch_loss, grads = layers.gradients(active.slot_of, active.params, rows, flat, label, active.n_slots)
            for name, g in grads.items():  # of means, so each counts for its rows
                sums[name] = sums.get(name, 0.0) + g.astype(float) * len(batch)
            seen, loss = seen + len(batch), loss + batch_loss
        for name, g in sums.items():
            yield pd.DataFrame({"layer": name, "row": active.all_rows(name, len(g)).astype(np.int32), "g": list(g)})
        if seen:
            yield pd.DataFrame({"layer": ["loss"], "row": [0], "g": [[loss, float(seen)]]})

    return add_up


def train_step(
    rows: DataFrame, net: Net, adam: layers.Adam | None = None, learning_rate: float = LEARNING_RATE, batch: int = BATCH
) -> tuple[Net, layers.Adam, float]:
    """One step with the gradient of all ``rows``, the moments to go on with, and the mean loss.

    The result is that of one process over one batch of all rows, however they are dealt
    out: tasks add up gradients of the parameter rows that they saw, Spark adds up the
    tasks, and what reaches the driver is one row per parameter row of the bounded net.
    """
    shared = rows.sparkSession.sparkContext.broadcast((net.slot_of, net.params))
    parts = rows.select("label", "idx").mapInPandas(_gradient_sums(shared, batch), "layer string, row int, g array<double>")
    summed = parts.groupBy("layer", "row").agg(Summarizer.sum(array_to_vector(F.col("g"))).alias("g"))
    summed = summed.select("layer", "row", vector_to_array("g").alias("g")).collect()
    shared.destroy()
    total = next((r["g"] for r in summed if r["layer"] == "loss"), None)
    if total is None:
        raise ValueError("a net cannot be trained without rows")
    grads = {name: np.zeros_like(value) for name, value in net.params.items()}
    for r in summed:
        if r["layer"] != "loss":
            grads[r["layer"]][r["row"]] = np.asarray(r["g"]) / total[1]
    params, adam = {name: v.copy() for name, v in net.params.items()}, adam or layers.Adam(learning_rate)
    adam.step(params, grads)
    return Net(net.slot_of, params), adam, total[0] / total[1]


def fold(net: Net) -> tuple[np.ndarray, float]:
    """The linear layers after the first as one vector and one offset."""
    u, c = net.params["w2"], net.params["b2"]
    for i in range(3, layers.depth(net.params) + 1):
        u, c = u @ net.params[f"w{i}"], c @ net.params[f"w{i}"] + net.params[f"b{i}"]
    return u[:, 0], float(c[0, 0])


def score_dnn(rows: DataFrame, net: Net) -> DataFrame:
    """``(instance_id, label, p)``."""
    u, c = fold(net)
    first = {n: v for n, v in net.params.items() if n in ("emb", "w1", "b1")}
    shared = rows.sparkSession.sparkContext.broadcast((net.slot_of, first, u, c))

    @F.pandas_udf("double")
    def predict(idx: pd.Series) -> pd.Series:
        slot_of, params, u, c = shared.value
        rows, flat = layers.flatten(idx)
        a, _ = layers.first_layer(slot_of, params, rows, flat, len(idx))
        z = np.maximum(a, 0.0) @ u + c
        return pd.Series(1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))))

    return rows.select("instance_id", "label", predict("idx").alias("p"))


def net_frame(spark: SparkSession, net: Net) -> DataFrame:
    """``(layer, row, v)`` with one row per parameter row."""
    parts = [
        pd.DataFrame({"layer": name, "row": np.arange(len(v), dtype=np.int32), "v": v.astype(float).tolist()})
        for name, v in net.params.items()
    ]
    return spark.createDataFrame(pd.concat(parts), "layer string, row int, v array<double>")


@dataclass
class NetFit(Fit):
    net: Net | None = None


def train_dnn(
    train: DataFrame,
    evaluation: DataFrame,
    slots: DataFrame,
    mode: str = "embedding",
    hidden=HIDDEN,
    embedding: int = EMBEDDING,
    epochs: int = 1,
    learning_rate: float = LEARNING_RATE,
    batch: int = BATCH,
    partitions: int | None = None,
    seed: int = 0,
    resolution: int | None = None,
    on_iteration: OnIteration | None = None,
) -> NetFit:
    """``mode`` is ``embedding`` (summed embedding rows per slot) or ``discrete`` (raw
    multi-hot). Rows are reshuffled every epoch; history holds the true mean train loss
    and the held-out AUC and MAE."""
    spark = train.sparkSession
    rows, held_out = materialize(train, "net-train"), materialize(evaluation, "net-eval")
    n = rows.count()
    net = new_net(slots, mode, hidden, embedding, seed)
    history: list[tuple] = []
    for epoch in range(epochs):
        shuffled = shuffle_instances(rows, seed + epoch, partitions)
        net, loss = train_epoch(shuffled, net, learning_rate, batch)
        scores = score_dnn(held_out, net)
        result = evaluate(scores, resolution).first()
        history.append((epoch, n, result["auc"], result["mae"], float(loss)))
        if on_iteration:
            on_iteration(epoch, net_frame(spark, net))
    return NetFit(net_frame(spark, net), history_frame(spark, history), net=net)
