"""Linear one-vs-rest classifiers, many problems at once.

A problem is one binary fit: a loss, penalties, a fold (whose training rows count) and the class against the
rest, both sides weighing the same. All problems are columns of one coefficient matrix. One pass over the packed
rows evaluates loss and gradient of every column by matrix products; a pass costs one Spark job, whatever the number of
grid points, folds and classes, and only the sums reach the driver. There every column takes its own step: a column whose
trial point is refused tries a shorter one in the next pass while the others go on, and converged columns leave the
matrix. While the second derivatives of all columns (pairs of features x columns) fit in ``SECOND`` bytes, a pass sums them
too and the steps are Newton's, damped where one was refused (with an L1 penalty the quadratic model is minimised by
coordinates): some ten passes instead of a hundred. Wider data take a limited-memory quasi-Newton method (orthant-wise where a
column has an L1 penalty) with a line search. The objective of a column is

    mean of weight * loss  +  reg * ((1 - l1) / 2 * |w|^2 + l1 * |w|_1)        (the intercept is not penalised)

with the logistic loss, or the smooth hinge loss: zero from margin 1 on, linear below 1 - ``CORNER``, quadratic between (so
it has a gradient, and a class that cannot be told from the rest keeps margins near 0 instead of any of many equal optima).
All of it is convex: where a fit converges does not depend on the columns beside it.
"""

from __future__ import annotations

import dataclasses
import functools
import operator

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.operators import blocks as B

CLASSES = (0, 1, 2)
CORNER, MEMORY, ARMIJO, STEPS = 1.0, 10, 1e-4, 30
#: Bytes of second derivatives that one pass may sum, and margins of a block that are worked on at once (what a core's cache holds).
SECOND, CELLS = 8 << 20, 1 << 15


@dataclasses.dataclass(frozen=True)
class Point:
    """Hyper-parameters of a one-vs-rest classifier."""

    loss: str = "log"
    reg: float = 1e-4
    l1: float = 0.0


@dataclasses.dataclass
class Columns:
    """The problems of points x folds x classes, in this order."""

    hinge: np.ndarray
    l2: np.ndarray
    l1: np.ndarray
    fold: np.ndarray
    cls: np.ndarray

    @staticmethod
    def of(points: list[Point], folds: list[int], classes) -> "Columns":
        rows = [(p.loss == "hinge", p.reg * (1 - p.l1), p.reg * p.l1, f, c) for p in points for f in folds for c in range(len(classes))]
        return Columns(*(np.array(c) for c in zip(*rows)))

    def __getitem__(self, at) -> "Columns":
        return Columns(*(getattr(self, f.name)[at] for f in dataclasses.fields(self)))


def losses(margin: np.ndarray, hinge: np.ndarray, second: bool = False) -> tuple[np.ndarray, ...]:
    """Loss of each margin (rows x columns), its derivative and, if asked for, the second one."""
    if hinge.any() and not hinge.all():
        out = [np.empty_like(margin) for _ in range(2 + second)]
        for own in (hinge, ~hinge):
            for a, v in zip(out, losses(margin[:, own], hinge[own], second)):
                a[:, own] = v
        return tuple(out)
    if hinge.any():
        gap = np.maximum(1 - margin, 0)
        loss, slope = np.where(gap < CORNER, gap * gap / (2 * CORNER), gap - CORNER / 2), -np.minimum(gap / CORNER, 1)
        return (loss, slope, ((gap > 0) & (gap <= CORNER)) / CORNER) if second else (loss, slope)
    e = np.exp(-np.abs(margin))
    loss, share = np.maximum(-margin, 0) + np.log1p(e), 1 / (1 + e)
    slope = -np.where(margin > 0, e, 1) * share
    return (loss, slope, e * share * share) if second else (loss, slope)


def _evaluated(data: B.Blocks, columns: Columns, classes, w: np.ndarray, second: bool = False) -> tuple[np.ndarray, ...]:
    """Smooth part of the objective (P) and its gradient (dim + 1 x P) at ``w``, in one pass; with ``second`` also the
    matrices of second derivatives (P x dim + 1 x dim + 1)."""
    dim, size = data.dim, len(columns.cls)
    total = data.counts.sum(1)[columns.fold]
    kinds, which = np.unique(np.stack([columns.fold, columns.cls]), axis=1, return_inverse=True)
    which = which.ravel()
    own, all_ = data.counts[kinds[0], kinds[1]], data.counts.sum(1)[kinds[0]]
    heavy, light = all_ / (2.0 * own), all_ / (2.0 * (all_ - own))
    target = np.array(classes, np.float64)[kinds[1]]
    left, right = np.triu_indices(dim + 1)
    some = max(64, CELLS // size)

    def each(rows: B.Rows) -> np.ndarray:
        out, count = np.zeros((dim + 2 + (len(left) if second else 0), size)), rows.count
        for i in range(0, len(rows.y), some):
            x = np.concatenate([rows.x[i:i + some], np.ones((len(rows.y[i:i + some]), 1))], 1)
            hit = rows.y[i:i + some, None] == target
            sign = np.where(hit, 1.0, -1.0)[:, which]
            weight = (np.where(hit, heavy, light) * (rows.part[i:i + some, kinds[0]] == 1) * count[i:i + some, None])[:, which]
            found = losses(sign * (x @ w), columns.hinge, second)
            out[0] += (found[0] * weight).sum(0)
            out[1:dim + 2] += x.T @ (found[1] * sign * weight)
            if second:
                out[dim + 2:] += (x[:, left] * x[:, right]).T @ (found[2] * weight)
        return out.ravel()

    out = B.summed(data, each, (dim + 2 + (len(left) if second else 0)) * size).reshape(-1, size) / total
    value, grad = out[0] + columns.l2 / 2 * (w[:dim] ** 2).sum(0), out[1:dim + 2]
    grad[:dim] += columns.l2 * w[:dim]
    if not second:
        return value, grad
    curve = np.zeros((size, dim + 1, dim + 1))
    curve[:, left, right] = curve[:, right, left] = out[dim + 2:].T
    curve[:, np.arange(dim), np.arange(dim)] += columns.l2[:, None]
    return value, grad, curve


def _pseudo(w: np.ndarray, grad: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """Steepest direction's gradient of the whole objective; ``l1`` (dim + 1 x P) is 0 for intercepts."""
    right, left = grad + l1, grad - l1
    at_zero = np.where(right < 0, right, np.where(left > 0, left, 0.0))
    return np.where(l1 == 0, grad, np.where(w > 0, right, np.where(w < 0, left, at_zero)))


def _direction(slope: np.ndarray, s: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two-loop recursion of every column; entries without curvature count nothing."""
    q, sy = slope.copy(), (s * y).sum(1)
    rho = np.where(sy > 1e-14, 1 / np.where(sy > 1e-14, sy, 1), 0.0)
    alpha = np.zeros((len(s), slope.shape[1]))
    for k in range(len(s)):  # newest first
        alpha[k] = rho[k] * (s[k] * q).sum(0)
        q -= alpha[k] * y[k]
    yy = (y[0] * y[0]).sum(0)
    q *= np.where((rho[0] > 0) & (yy > 0), sy[0] / np.where(yy > 0, yy, 1), 1.0)
    for k in reversed(range(len(s))):
        q += s[k] * (alpha[k] - rho[k] * (y[k] * q).sum(0))
    return -q


def _least(w: np.ndarray, grad: np.ndarray, curve: np.ndarray, l1: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Steps (dim + 1 x P) to the least of every column's quadratic model plus its L1 penalty."""
    plain, out = (l1 == 0).all(0), np.zeros_like(w)
    if plain.any():
        out[:, plain] = -np.linalg.solve(curve[plain], grad[:, plain].T[..., None])[..., 0].T
    if not plain.all():
        w, g, l1, curve = w[:, ~plain], grad[:, ~plain].copy(), l1[:, ~plain], curve[~plain]
        move = np.zeros_like(w)
        for _ in range(sweeps):
            most = 0.0
            for j in range(len(w)):
                a, old = curve[:, j, j], w[j] + move[j]
                free = old - g[j] / a
                step = np.sign(free) * np.maximum(np.abs(free) - l1[j] / a, 0) - old
                move[j] += step
                g += curve[:, :, j].T * step
                most = max(most, np.abs(step).max())
            if most <= 1e-12 * max(1.0, np.abs(w + move).max()):
                break
        out[:, ~plain] = move
    return out


def _newton(data: B.Blocks, cols: Columns, classes, max_iter: int, tol: float) -> np.ndarray:
    """Coefficients by damped Newton steps. A refused trial raises its column's damping, a good one lowers it."""
    size, dim = len(cols.cls), data.dim
    out, at = np.zeros((dim + 1, size)), np.arange(size)
    w, diagonal = np.zeros((dim + 1, size)), np.arange(dim + 1)
    f, g, h = _evaluated(data, cols, classes, w, True)
    iters, tries, damp = (np.zeros(size, k) for k in (int, int, float))
    penalty = np.concatenate([np.tile(cols.l1, (dim, 1)), np.zeros((1, size))])
    value = f + (penalty * np.abs(w)).sum(0)
    while True:
        slope = _pseudo(w, g, penalty)
        done = (np.abs(slope).max(0) <= tol * np.maximum(1, np.abs(w).max(0))) | (iters >= max_iter) | (tries >= STEPS)
        if done.any():
            out[:, at[done]] = w[:, done]
            live = ~done
            at, cols, iters, tries, damp, value, h = at[live], cols[live], iters[live], tries[live], damp[live], value[live], h[live]
            w, g, penalty = (a[..., live] for a in (w, g, penalty))
        if not len(at):
            return out
        model, scale = h.copy(), h[:, diagonal, diagonal]
        most = np.maximum(scale.max(1, keepdims=True), 1e-12)
        model[:, diagonal, diagonal] += damp[:, None] * np.maximum(scale, 1e-3 * most) + 1e-12 * most
        move = _least(w, g, model, penalty)
        trial = w + move
        hoped = (g * move).sum(0) + np.einsum("ip,pij,jp->p", move, model, move) / 2 + (penalty * (np.abs(trial) - np.abs(w))).sum(0)
        f1, g1, h1 = _evaluated(data, cols, classes, trial, True)
        value1 = f1 + (penalty * np.abs(trial)).sum(0)
        taken = value1 <= value + ARMIJO * np.minimum(hoped, 0) + 1e-15 * np.abs(value)
        small = taken & (value - value1 <= 1e-12 * np.maximum(1, np.abs(value)))  # no further gain in double precision
        good = taken & (value1 - value <= hoped / 2)
        w, g, value, h = np.where(taken, trial, w), np.where(taken, g1, g), np.where(taken, value1, value), np.where(taken[:, None, None], h1, h)
        iters, tries = np.where(taken, iters + 1, iters), np.where(taken, 0, tries + 1)
        iters[small] = max_iter
        damp = np.where(good, np.where(damp > 1e-4, damp / 10, 0.0), np.where(taken, damp, np.maximum(10 * damp, 1e-2)))


def solve(data: B.Blocks, columns: Columns, classes=CLASSES, max_iter: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Coefficients (dim + 1 x P) of all problems. A problem without rows on one side has an infinite intercept."""
    size, dim = len(columns.cls), data.dim
    own, total = data.counts[columns.fold, columns.cls], data.counts.sum(1)[columns.fold]
    out = np.zeros((dim + 1, size))
    out[dim] = np.where((own == total) & (total > 0), np.inf, np.where(own == 0, -np.inf, 0.0))
    at = np.flatnonzero(np.isfinite(out[dim]))
    if not len(at):
        return out
    cols = columns[at]
    if 4 * (dim + 1) * (dim + 2) * len(at) <= SECOND:
        out[:, at] = _newton(data, cols, classes, max_iter, tol)
        return out
    w = np.zeros((dim + 1, len(at)))
    f, g = _evaluated(data, cols, classes, w)
    s, y = (np.zeros((MEMORY, dim + 1, len(at))) for _ in range(2))
    iters, tries, step = (np.zeros(len(at), k) for k in (int, int, float))
    penalty = np.concatenate([np.tile(cols.l1, (dim, 1)), np.zeros((1, len(at)))])
    value = f + (penalty * np.abs(w)).sum(0)
    slope = _pseudo(w, g, penalty)
    move = -slope
    step[:] = 1 / np.maximum(np.sqrt((slope ** 2).sum(0)), 1.0)
    while True:
        done = (np.abs(slope).max(0) <= tol * np.maximum(1, np.abs(w).max(0))) | (iters >= max_iter) | (tries >= STEPS)
        if done.any():
            out[:, at[done]] = w[:, done]
            live = ~done
            at, cols, iters, tries, step, f, value = at[live], cols[live], iters[live], tries[live], step[live], f[live], value[live]
            w, g, slope, move, penalty, s, y = (a[..., live] for a in (w, g, slope, move, penalty, s, y))
        if not len(at):
            return out
        orthant = np.where(w != 0, np.sign(w), np.sign(-slope))
        trial = w + step * move
        trial = np.where((penalty > 0) & (np.sign(trial) != orthant), 0.0, trial)
        f1, g1 = _evaluated(data, cols, classes, trial)
        value1 = f1 + (penalty * np.abs(trial)).sum(0)
        taken = value1 <= value + ARMIJO * (slope * (trial - w)).sum(0) + 1e-15 * np.abs(value)
        ds, dy = np.where(taken, trial - w, 0.0), np.where(taken, g1 - g, 0.0)
        s = np.where(taken, np.concatenate([ds[None], s[:-1]]), s)
        y = np.where(taken, np.concatenate([dy[None], y[:-1]]), y)
        small = taken & (value - value1 <= 1e-12 * np.maximum(1, np.abs(value)))  # no further gain in double precision
        w, g, f, value = np.where(taken, trial, w), np.where(taken, g1, g), np.where(taken, f1, f), np.where(taken, value1, value)
        iters, tries = np.where(taken, iters + 1, iters), np.where(taken, 0, tries + 1)
        iters[small] = max_iter
        slope = _pseudo(w, g, penalty)
        ahead = _direction(slope, s, y)
        ahead = np.where((penalty > 0) & (ahead * slope >= 0), 0.0, ahead)  # never against the orthant's own descent
        uphill = (ahead * slope).sum(0) >= 0
        ahead = np.where(uphill, -slope, ahead)
        move = np.where(taken, ahead, move)
        step = np.where(taken, np.where(uphill, 1 / np.maximum(np.sqrt((slope ** 2).sum(0)), 1.0), 1.0), step / 2)


def confusions(data: B.Blocks, w: np.ndarray, points: int, folds: list[int], classes=CLASSES) -> np.ndarray:
    """Counts (points x folds x truth x prediction) over the rows that each fold scores, in one pass."""
    k, dim = len(classes), data.dim
    finite = np.where(np.isfinite(w), w, 0.0)
    fixed = np.where(np.isfinite(w[dim]), 0.0, w[dim])

    def each(rows: B.Rows) -> np.ndarray:
        margin = rows.x @ finite[:dim] + finite[dim] + fixed
        best = margin.reshape(len(rows.y), points, len(folds), k).argmax(3)  # ties: the first class
        scored = np.where(rows.part[:, folds] == 2, rows.count[:, None], 0.0)[:, None, :]
        out = np.zeros((points, len(folds), k, k))
        for i, c in enumerate(classes):
            true = scored * (rows.y == c)[:, None, None]
            for j in range(k):
                out[:, :, i, j] = (true * (best == j)).sum(0)
        return out.ravel()

    return B.summed(data, each, points * len(folds) * k * k).reshape(points, len(folds), k, k).astype(np.int64)


def search(data: B.Blocks, points: list[Point], classes=CLASSES, max_iter: int = 100) -> np.ndarray:
    """Confusion counts (points x folds x truth x prediction) of every point, fitted and scored in every fold."""
    folds = list(range(data.folds))
    w = solve(data, Columns.of(points, folds, classes), classes, max_iter)
    return confusions(data, w, len(points), folds, classes)


class LinearOvr:
    """One-vs-rest linear classifier with balanced binary problems; the prediction is the class with the largest margin
    (ties: the smallest class)."""

    def __init__(self, point: Point, max_iter: int = 100, classes=CLASSES, features: str = "features", label: str = "label"):
        self.point, self.max_iter, self.classes, self.features, self.label = point, max_iter, classes, features, label

    def fit(self, df: DataFrame) -> "LinearOvrModel":
        data = B.pack(df, features=self.features, label=self.label, classes=self.classes, merged=True)
        w = solve(data, Columns.of([self.point], [0], self.classes), self.classes, self.max_iter)
        return LinearOvrModel(w, self.classes, self.features)


class LinearOvrModel:
    """``coefficients`` has a column per class, the intercepts in its last row."""

    def __init__(self, coefficients: np.ndarray, classes, features: str):
        self.coefficients, self.classes, self.features = coefficients, classes, features

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: built-in expressions of the features, no model object and no Python in the tasks."""
        x = vector_to_array(F.col(self.features))
        margins = []
        for k, w in zip(self.classes, self.coefficients.T):
            terms = [x[i] * F.lit(float(v)) for i, v in enumerate(w[:-1]) if v != 0]
            margin = functools.reduce(operator.add, [F.lit(float(w[-1])), *terms])
            margins.append(F.struct(margin.alias("m"), F.lit(-k).alias("tie"), F.lit(float(k)).alias("k")))
        best = F.greatest(*margins) if len(margins) > 1 else margins[0]
        return df.withColumn("prediction", best["k"])
