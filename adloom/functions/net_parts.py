"""What a task does with its part of a net that is a table: train, add up gradients, score.

A part is a stream of frames: parameter rows ``(kind 0, layer, row, v)`` first, then
instances ``(kind 1, instance_id, label, idx)``. Sent to the workers by value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd

from adloom.functions import layers


class Part:
    """The net as one task has it: the wide rows that its instances name, and all narrow layers."""

    def __init__(self, given: pd.DataFrame, starts: np.ndarray, wide: str, single: bool):
        self.wide, self.n_slots = wide, len(starts)
        self.params, self.rows = {}, np.zeros(0, np.int64)
        dtype = np.float32 if single else np.float64
        for name, part in given.groupby("layer"):
            part = part.sort_values("row")
            self.params[name] = np.stack(part["v"].to_list()).astype(dtype)
            if name == wide:
                self.rows = part["row"].to_numpy(np.int64)
        if wide not in self.params:  # no instance has a feature
            width = self.params["w1"].shape[0] // self.n_slots if wide == "emb" else self.params["b1"].shape[1]
            self.params[wide] = np.zeros((0, width), dtype)
        self.slot_of = np.searchsorted(starts, self.rows, side="right") - 1

    def places(self, idx: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        rows, flat = layers.flatten(idx)
        at = np.searchsorted(self.rows, flat)
        if len(flat) and (at.max() >= len(self.rows) or (self.rows[at] != flat).any()):
            raise ValueError("an instance names a position that the net has no row for")
        return rows, at

    def gradients(self, batch: pd.DataFrame) -> tuple[float, dict[str, np.ndarray]]:
        rows, at = self.places(batch["idx"])
        label = batch["label"].to_numpy(self.params["b1"].dtype)
        return layers.gradients(self.slot_of, self.params, rows, at, label, self.n_slots)

    def all_rows(self, name: str) -> np.ndarray:
        return (self.rows if name == self.wide else np.arange(len(self.params[name]))).astype(np.int32)


def open_part(frames: Iterator[pd.DataFrame], net: tuple) -> tuple[Part | None, Iterator[pd.DataFrame]]:
    """The part's net and the instances after it; no net where the part has no instances."""
    given = []
    for frame in frames:
        n = int((frame["kind"] == 0).sum())
        given.append(frame.iloc[:n])
        if n < len(frame):
            return Part(pd.concat(given), *net), chain([frame.iloc[n:]], frames)
    return None, iter(())


def train(net: tuple, rate: float, size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, instances = open_part(frames, net)
        if part is None:
            return
        start, adam, seen, loss = dict(part.params), layers.Adam(rate), 0, 0.0
        for batch in layers.minibatches(instances, size):
            batch_loss, grads = part.gradients(batch)
            adam.step(part.params, grads)
            seen, loss = seen + len(batch), loss + batch_loss
        for name, new in part.params.items():
            delta = new.astype(float) - start[name]
            moved = np.flatnonzero(delta.any(axis=1))
            if len(moved):
                yield pd.DataFrame(
                    {"layer": name, "row": part.all_rows(name)[moved], "delta": list(delta[moved]), "weight": float(seen)}
                )
        yield pd.DataFrame({"layer": ["loss"], "row": [0], "delta": [[loss / seen]], "weight": [float(seen)]})

    return run


def add_up(net: tuple, size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, instances = open_part(frames, net)
        if part is None:
            return
        sums, seen, loss = {}, 0, 0.0
        for batch in layers.minibatches(instances, size):
            batch_loss, grads = part.gradients(batch)
            for name, g in grads.items():  # of means, so each counts for its rows
                sums[name] = sums.get(name, 0.0) + g.astype(float) * len(batch)
            seen, loss = seen + len(batch), loss + batch_loss
        for name, g in sums.items():
            if len(g):
                yield pd.DataFrame({"layer": name, "row": part.all_rows(name), "g": list(g)})
        yield pd.DataFrame({"layer": ["loss"], "row": [0], "g": [[loss, float(seen)]]})

    return run


def predict(net: tuple):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, instances = open_part(frames, net)
        if part is None:
            return
        for batch in instances:
            rows, at = part.places(batch["idx"])
            a, _ = layers.first_layer(part.slot_of, part.params, rows, at, len(batch), part.n_slots)
            a = np.maximum(a, 0.0)
            for i in range(2, layers.depth(part.params) + 1):
                a = a @ part.params[f"w{i}"] + part.params[f"b{i}"]
            z = a[:, 0]
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
            yield pd.DataFrame({"instance_id": batch["instance_id"], "label": batch["label"], "p": p.astype(float)})

    return run
