"""Forward and backward passes over one batch of sparse rows, as run inside tasks.

A net is ``slot_of`` (the slot of every multi-hot position) and ``params`` (arrays by
name). This module is sent to the workers by value, so it imports nothing of its own
package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_BLOCK = 1 << 15  # numbers of a table that are stepped at once


def depth(params: dict[str, np.ndarray]) -> int:
    return sum(name.startswith("w") for name in params)


def first_layer(slot_of: np.ndarray, p: dict[str, np.ndarray], rows, flat, n: int, n_slots: int | None = None):
    """Pre-activation of layer 1, and its dense input in embedding mode."""
    if "emb" in p:
        n_slots = n_slots or slot_of[-1] + 1
        pooled = np.zeros((n * n_slots, p["emb"].shape[1]), p["emb"].dtype)
        np.add.at(pooled, rows * n_slots + slot_of[flat], p["emb"][flat])
        dense = pooled.reshape(n, -1)
        return dense @ p["w1"] + p["b1"], dense
    return p["b1"] + _sums(p["w1"], flat, rows, n), None  # gathers rows, never a dense multi-hot


def gradients(
    slot_of: np.ndarray, p: dict[str, np.ndarray], rows, flat, y, n_slots: int | None = None
) -> tuple[float, dict[str, np.ndarray]]:
    """Summed log loss of a minibatch and the gradient of its mean."""
    n, last = len(y), depth(p)
    a, dense = first_layer(slot_of, p, rows, flat, n, n_slots)
    hidden = np.maximum(a, 0.0)
    # The layers after the first are linear with one output, so a batch passes them as one vector:
    # folds[i] is what a unit of layer i adds to the margin, and every gradient has rank one.
    folds, offset = {last: np.ones((1, 1), a.dtype)}, 0.0
    for i in range(last, 1, -1):
        offset = offset + float((p[f"b{i}"] @ folds[i])[0, 0])
        folds[i - 1] = p[f"w{i}"] @ folds[i]
    z = (hidden @ folds[1])[:, 0] + a.dtype.type(offset)
    loss = float(np.sum(np.logaddexp(0.0, z) - y * z))

    g: dict[str, np.ndarray] = {}
    d = ((1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y) / n)[:, None]
    total = d.sum(axis=0, keepdims=True)
    along = d.T @ hidden  # the layer's outputs, summed by the residuals
    for i in range(2, last + 1):
        g[f"w{i}"], g[f"b{i}"] = along.T @ folds[i].T, total @ folds[i].T
        along = along @ p[f"w{i}"] + total * p[f"b{i}"]
    d = (d @ folds[1].T) * (a > 0)
    g["b1"] = d.sum(axis=0, keepdims=True)
    if dense is None:
        g["w1"] = _sums(d, rows, flat, len(p["w1"]))
    else:
        g["w1"] = dense.T @ d
        n_slots = n_slots or slot_of[-1] + 1
        back = (d @ p["w1"].T).reshape(n * n_slots, -1)
        g["emb"] = np.zeros_like(p["emb"])
        np.add.at(g["emb"], flat, back[rows * n_slots + slot_of[flat]])
    return loss, g


def _sums(values: np.ndarray, take, into, n: int) -> np.ndarray:
    """``n`` rows of sums: row ``into[i]`` gathers ``values[take[i]]``."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(into):
        order = np.argsort(into, kind="stable")
        rows, starts = np.unique(into[order], return_index=True)
        out[rows] = np.add.reduceat(values[take[order]], starts, axis=0)
    return out


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.s, self.own = rate, 0, {}, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        # A plain float, unlike a numpy one, leaves the arrays in single precision.
        rate = float(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for name, g in grads.items():
            if name not in self.m:
                self.m[name], self.s[name] = np.zeros_like(g), np.zeros_like(g)
            if params[name] is not self.own.get(name):  # what the caller gave is not written to
                params[name] = self.own[name] = params[name].copy()
            whole = (params[name], g, self.m[name], self.s[name])
            height = max(1, _BLOCK // max(1, g.shape[1]))
            for at in range(0, len(g), height):  # blocks that stay in the cache
                x, dx, m, s = (table[at : at + height] for table in whole)
                m *= 0.9
                m += 0.1 * dx
                s *= 0.999
                s += 0.001 * dx * dx
                step = np.sqrt(s)
                step += 1e-8
                np.divide(m, step, out=step)
                step *= rate
                x -= step


class ActiveRows:
    """The rows of the wide first matrix that a task has seen, in order of appearance.

    The first matrix has a row for every multi-hot position, and a task meets few of them.
    Only those are copied, get gradients and have moments: a row that was never seen has
    moments of zero and would not move, so the result is that of the whole matrix.
    """

    def __init__(self, slot_of: np.ndarray, start: dict[str, np.ndarray]):
        self.name = "emb" if "emb" in start else "w1"
        self.base, self.all_slots = start[self.name], slot_of
        self.n_slots = int(slot_of[-1]) + 1 if len(slot_of) else 0
        self.place: dict[int, int] = {}
        self.rows = np.zeros(0, np.int64)
        self.params = {**start, self.name: self.base[:0]}

    @property
    def slot_of(self) -> np.ndarray:
        return self.all_slots[self.rows]

    def take_in(self, flat: np.ndarray, *moments: dict) -> np.ndarray:
        """``flat`` positions as places among the active rows, which grow by new ones."""
        seen, at = np.unique(flat, return_inverse=True)
        new = [r for r in seen.tolist() if r not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, new])
            self.params[self.name] = np.concatenate([self.params[self.name], self.base[new]])
            for m in moments:
                if self.name in m:
                    more = np.zeros((len(new), self.base.shape[1]), m[self.name].dtype)
                    m[self.name] = np.concatenate([m[self.name], more])
        return np.array([self.place[r] for r in seen.tolist()], np.int64)[at]

    def all_rows(self, name: str, n: int) -> np.ndarray:
        """The rows of the whole net that rows 0 to n-1 of a matrix stand for."""
        return self.rows if name == self.name else np.arange(n)


def minibatches(frames: Iterator[pd.DataFrame], size: int):
    """Cut the partition's stream into ``size`` rows each; the last one is short."""
    held: pd.DataFrame | None = None
    for frame in frames:
        held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        while len(held) >= size:
            yield held.iloc[:size]
            held = held.iloc[size:]
    if held is not None and len(held):
        yield held


def flatten(idx: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    lengths = idx.map(len).to_numpy()
    flat = np.concatenate(idx.to_list()).astype(np.int64)
    return np.repeat(np.arange(len(idx)), lengths), flat
