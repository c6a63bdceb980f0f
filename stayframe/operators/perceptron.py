"""Perceptrons with dropout and class weights, many networks at once.

Networks are fully connected with rectified hidden units and a softmax of the classes, trained by categorical
cross-entropy, each row weighted by its class (all classes weigh the same if ``balanced``). Rows are dealt to
``batches`` mini-batches by a hash, once, and written batch by batch, so a step reads nothing but its own batch. A
step is one Spark job for all networks (grid points x folds): every task runs its rows forward and
backward, the gradients are added over the tasks, and the driver, which holds nothing but parameters, takes each
network's step (adadelta). The order of the batches changes from epoch to epoch by the seed.

A hidden unit is dropped from a row for an epoch where a hash of (row, epoch, layer, unit, seed) falls below the
rate; units that stay are scaled up by 1 / (1 - rate). So masks, and with them the whole fit, repeat exactly, wherever
a row lies, and a repeated task gives what the lost one gave. Copies of a row share their masks.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.operators import blocks as B

CLASSES = (0, 1, 2)
#: Adadelta: decay of its averages, and the constant that sets its first steps.
DECAY, EPSILON = 0.95, 1e-4
#: Rows that a task runs through the networks at once (fewer cost more calls than they save).
SOME = 4096


@dataclasses.dataclass(frozen=True)
class Point:
    """Units and dropout rate of each hidden layer."""

    units: tuple[int, ...] = (10,)
    dropout: tuple[float, ...] = (0.0,)


def shapes(point: Point, dim: int, k: int) -> list[tuple[int, int]]:
    """Rows (inputs and a bias) and columns of every layer's weights."""
    widths = [dim, *point.units, k]
    return [(a + 1, b) for a, b in zip(widths[:-1], widths[1:])]


def layers(flat: np.ndarray, sizes: list[tuple[int, int]]) -> list[np.ndarray]:
    out, at = [], 0
    for r, c in sizes:
        out.append(flat[at:at + r * c].reshape(r, c))
        at += r * c
    return out


def first_weights(point: Point, dim: int, k: int, seed: int) -> np.ndarray:
    """Uniform by fan-in and fan-out, biases zero."""
    rng, out = np.random.default_rng(seed), []
    for r, c in shapes(point, dim, k):
        w = rng.uniform(-1, 1, (r, c)) * np.sqrt(6.0 / (r - 1 + c))
        w[-1] = 0
        out.append(w.ravel())
    return np.concatenate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def uniforms(key: np.ndarray, epoch: int, layer: int, units: int, seed: int) -> np.ndarray:
    """(rows x units) draws in [0, 1) by hash."""
    place = _mixed(np.array([(seed << 40) + (epoch << 24) + (layer << 16)], np.uint64) + np.arange(units, dtype=np.uint64))
    return (_mixed(key.astype(np.uint64)[:, None] ^ place[None, :]) >> np.uint64(11)) * 2.0 ** -53


def forward(x: np.ndarray, weights: list[np.ndarray], masks: list | None = None) -> list[np.ndarray]:
    """The hidden layers' outputs and the scores of the classes."""
    out = []
    for i, w in enumerate(weights):
        x = x @ w[:-1]
        x += w[-1]
        if i < len(weights) - 1:
            np.maximum(x, 0, out=x)
            if masks is not None and masks[i] is not None:
                x *= masks[i]
        out.append(x)
    return out


def gradient(x: np.ndarray, target: np.ndarray, weight: np.ndarray, weights: list[np.ndarray], masks: list) -> np.ndarray:
    """Sum over rows of the weighted cross-entropy's gradient, and the loss at its end."""
    outs = forward(x, weights, masks)
    score = outs[-1] - outs[-1].max(1, keepdims=True)
    p = np.exp(score)
    total = p.sum(1, keepdims=True)
    loss = float((weight * (np.log(total[:, 0]) - (score * target).sum(1))).sum())
    back, grads = (p / total - target) * weight[:, None], []
    for i in reversed(range(len(weights))):
        below = x if i == 0 else outs[i - 1]
        grads.append(np.concatenate([below.T @ back, back.sum(0)[None]]).ravel())
        if i:
            back = back @ weights[i][:-1].T
            back *= outs[i - 1] > 0
            if masks[i - 1] is not None:
                back *= masks[i - 1]
    return np.concatenate([*grads[::-1], [loss]])


@dataclasses.dataclass
class Adadelta:
    """Steps of one network's parameters."""

    value: np.ndarray
    squares: np.ndarray = None
    moves: np.ndarray = None

    def step(self, grad: np.ndarray) -> None:
        if self.squares is None:
            self.squares, self.moves = np.zeros_like(grad), np.zeros_like(grad)
        self.squares = DECAY * self.squares + (1 - DECAY) * grad * grad
        move = -grad * np.sqrt(self.moves + EPSILON) / np.sqrt(self.squares + EPSILON)
        self.moves = DECAY * self.moves + (1 - DECAY) * move * move
        self.value = self.value + move


def train(data: B.Blocks, networks: list[tuple[Point, int]], epochs: int = 10, batches: int = 8, seed: int = 42, balanced: bool = True,
          classes=CLASSES) -> list[np.ndarray]:
    """Flat parameters of every network (point, fold), trained side by side."""
    dim, k = data.dim, len(classes)
    sizes = [shapes(p, dim, k) for p, _ in networks]
    lengths = [sum(r * c for r, c in s) for s in sizes]
    edges = np.concatenate([[0], np.cumsum([n + 2 for n in lengths])])  # gradient, loss, weight of the rows
    state = [Adadelta(first_weights(p, dim, k, seed)) for p, _ in networks]
    by_class = B.class_weights(data.counts) if balanced else np.ones(data.counts.shape)
    order = np.random.default_rng(seed)
    target_of = np.array(classes, np.float64)
    dealt = [data] if batches == 1 else [data.only(F.col("batch") == b) for b in range(batches)]
    for epoch in range(epochs):
        for batch in order.permutation(batches):
            values = [s.value for s in state]

            def each(rows: B.Rows, epoch=epoch, values=values) -> np.ndarray:
                out, whole = np.zeros(edges[-1]), rows.count
                nets = [layers(v, s) for v, s in zip(values, sizes)]
                for at in range(0, len(rows.y), SOME):
                    part = slice(at, at + SOME)
                    hit, drawn = rows.y[part, None] == target_of, {}

                    def mask(layer: int, units: int, rate: float):
                        if rate and (layer, units) not in drawn:
                            drawn[layer, units] = uniforms(rows.key[part], epoch, layer, units, seed)
                        return (drawn[layer, units] >= rate) / (1 - rate) if rate else None

                    for fold in {f for _, f in networks}:
                        trains = (rows.part[part, fold] == 1) & hit.any(1)
                        x, target, kept = rows.x[part][trains], hit[trains].astype(np.float64), {}
                        weight = target @ by_class[fold] * whole[part][trains]
                        for n, (point, own) in enumerate(networks):
                            if own != fold:
                                continue
                            for unit in enumerate(zip(point.units, point.dropout)):
                                if unit not in kept:
                                    m = mask(unit[0], *unit[1])
                                    kept[unit] = None if m is None else m[trains]
                            masks = [kept[unit] for unit in enumerate(zip(point.units, point.dropout))]
                            out[edges[n]:edges[n + 1] - 1] += gradient(x, target, weight, nets[n], masks)
                            out[edges[n + 1] - 1] += weight.sum()
                return out

            total = B.summed(dealt[batch], each, int(edges[-1]))
            for n, s in enumerate(state):
                weight = total[edges[n + 1] - 1]
                if weight > 0:  # a batch may hold no row that trains in a fold
                    s.step(total[edges[n]:edges[n + 1] - 2] / weight)
    return [s.value for s in state]


def confusions(data: B.Blocks, networks: list[tuple[Point, int]], values: list[np.ndarray], classes=CLASSES) -> np.ndarray:
    """Counts (networks x truth x prediction) over the rows that each network's fold scores, in one pass."""
    dim, k = data.dim, len(classes)
    sizes = [shapes(p, dim, k) for p, _ in networks]

    def each(rows: B.Rows) -> np.ndarray:
        out = np.zeros((len(networks), k, k))
        truth, count = np.searchsorted(classes, rows.y), rows.count
        for n, (_, fold) in enumerate(networks):
            scored = (rows.part[:, fold] == 2) & np.isin(rows.y, classes)
            best = forward(rows.x[scored], layers(values[n], sizes[n]))[-1].argmax(1)
            out[n] = np.bincount(truth[scored] * k + best, count[scored], k * k).reshape(k, k)
        return out.ravel()

    return B.summed(data, each, len(networks) * k * k).reshape(len(networks), k, k).astype(np.int64)


def search(df: DataFrame, parts: list, points: list[Point], epochs: int = 10, batches: int = 8, seed: int = 42, balanced: bool = True,
           features: str = "features", label: str = "label", classes=CLASSES) -> np.ndarray:
    """Confusion counts (points x folds x truth x prediction) of every point, fitted and scored in every fold."""
    data = B.pack(df, parts, features, label, classes, batches, seed, merged=True)
    networks = [(p, f) for p in points for f in range(len(parts))]
    values = train(data, networks, epochs, batches, seed, balanced, classes)
    return confusions(data, networks, values, classes).reshape(len(points), len(parts), len(classes), len(classes))


class Perceptron:
    """One network as an estimator (M05: one hidden layer, M06: two)."""

    def __init__(self, point: Point, epochs: int = 10, batches: int = 8, seed: int = 42, balanced: bool = False, features: str = "features",
                 label: str = "label", classes=CLASSES):
        self.point, self.epochs, self.batches, self.seed, self.balanced = point, epochs, batches, seed, balanced
        self.features, self.label, self.classes = features, label, classes

    def fit(self, df: DataFrame) -> "PerceptronModel":
        data = B.pack(df, None, self.features, self.label, self.classes, self.batches, self.seed, merged=True)
        value, = train(data, [(self.point, 0)], self.epochs, self.batches, self.seed, self.balanced, self.classes)
        return PerceptronModel(layers(value, shapes(self.point, data.dim, len(self.classes))), self.features, self.classes)


class PerceptronModel:
    def __init__(self, weights: list[np.ndarray], features: str, classes):
        self.weights, self.features, self.classes = weights, features, classes

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: the class with the largest score (ties: the smallest class)."""
        weights, names = self.weights, np.array(self.classes, np.float64)

        @F.pandas_udf("double")
        def best(*x: pd.Series) -> pd.Series:
            return pd.Series(names[forward(np.column_stack([v.to_numpy(np.float64) for v in x]), weights)[-1].argmax(1)])

        out = df.withColumn("_x", vector_to_array(F.col(self.features)))
        return out.withColumn("prediction", best(*[F.col("_x")[i] for i in range(len(weights[0]) - 1)])).drop("_x")
