"""Softmax gradient boosting with histograms and a learned direction for missing values.

Every round grows one tree for each class on the softmax's gradients ``p - y`` and hessians ``2 p (1 - p)``. Features
are cut into at most ``BINS`` bins at quantiles once. A tree grows level by level: a pass over the packed rows adds up,
for every open node, gradient and hessian by (feature, bin); the driver, which sees these sums only, chooses

    argmax  GL^2 / (HL + 1) + GR^2 / (HR + 1) - G^2 / (H + 1)     with HL, HR >= min_child_weight

over features, cuts and the side that the missing values go to (ties: the first feature, the lowest cut, missing values to
the left). Rows without a value have a bin of their own, so they are tried on both sides; no value is ever imputed.
Of two siblings only the one with less hessian is summed by the rows, the other one is its parent less it. A
leaf's value is ``-rate * G / (H + 1)``; any positive rate is allowed.

Many models (grid points x folds) grow side by side in the same passes. The histograms of one pass take at most
``PASS_BYTES``: more open nodes are summed in several passes; models whose levels could hold more than ``HELD_BYTES`` in the
driver are grown one group after the other. A tree sees bins only, so rows are binned once and rows of equal bins, label and
parts are added up to one (``blocks.distinct``): with few features the passes read a table whose size does not grow
with the data, with many they read one byte a value. Rows hold no state: their scores are recomputed from the trees
so far, so nothing is rewritten between rounds and a lost executor repeats its own tasks only.

Where the table of bins is small (``CELL_BYTES``, measured, not assumed), rows of equal bins become one *cell* with its
numbers by part, fold and class: a cell's gradient is ``N p - n`` and its hessian ``N * 2 p (1 - p)``, so labels and folds need no rows of
their own. Every task then holds all cells and grows whole models by itself, with the scores kept between rounds;
only confusion counts (or a single fit's trees) come back. The trees are the same, up to the order in which sums are added. Models that
differ in ``min_child_weight`` only share a task, and their trees as long as no chosen cut leaves a child lighter than the larger weights.
"""

from __future__ import annotations

import dataclasses
import functools
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayframe.operators import blocks as B

CLASSES = (0, 1, 2)
BINS, RIDGE, PASS_BYTES, HELD_BYTES = 32, 1.0, 48 << 20, 512 << 20
#: Bytes of binned rows that the driver may read for cells and send to every task, and of sums that are searched for splits at once.
CELL_BYTES, SEARCHED = 48 << 20, 1 << 20
#: Bits of a double that one pass over its values tells apart.
LEVELS = (12, 10, 10, 8, 8, 8, 8)


@dataclasses.dataclass(frozen=True)
class Point:
    """Learning rate, depth and least hessian of a child."""

    rate: float = 0.1
    depth: int = 3
    min_child_weight: float = 1.0


@dataclasses.dataclass
class Tree:
    """Nodes as lists: ``feature`` -1 is a leaf; bins below ``cut`` go to ``left``, others to ``left + 1``; missing ones left if ``missing_left``."""

    feature: list
    cut: list
    missing_left: list
    left: list
    value: list

    @staticmethod
    def new() -> "Tree":
        return Tree([-1], [0], [False], [-1], [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> int:
        self.__dict__.pop("steps", None)
        first = len(self.feature)
        self.feature[node], self.cut[node], self.missing_left[node], self.left[node] = feature, cut, missing_left, first
        for column, empty in ((self.feature, -1), (self.cut, 0), (self.missing_left, False), (self.left, -1), (self.value, 0.0)):
            column += [empty, empty]
        return first

    @functools.cached_property
    def steps(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Feature that each node asks (a leaf: any), the next node by (node, bin) (a leaf: itself) and the depth."""
        feature, cut, missing_left, left = (np.array(c) for c in (self.feature, self.cut, self.missing_left, self.left))
        goes_left = np.arange(BINS + 1) < cut[:, None]
        goes_left[:, BINS] = missing_left
        nodes = np.arange(len(feature))
        follow = np.where((feature < 0)[:, None], nodes[:, None], left[:, None] + ~goes_left)
        depth, open_ = 0, nodes[:1][feature[:1] >= 0]
        while len(open_):
            below = np.concatenate([left[open_], left[open_] + 1])
            depth, open_ = depth + 1, below[feature[below] >= 0]
        return np.maximum(feature, 0), follow.ravel(), depth

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """Node in which each row ends."""
        feature, follow, depth = self.steps
        node, flat, row = np.zeros(len(bins), np.int64), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        for _ in range(depth):
            node = follow[node * (BINS + 1) + flat[row + feature[node]]]
        return node


@dataclasses.dataclass
class Cuts:
    """Sorted inner edges of every feature's bins: bin b holds edge[b - 1] < x <= edge[b]."""

    edges: list[np.ndarray]

    def bins(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for f, e in enumerate(self.edges):
            out[:, f] = np.searchsorted(e, x[:, f], "left")
            out[np.isnan(x[:, f]), f] = BINS
        return out


def quantile_cuts(data: B.Blocks, bins: int = BINS) -> Cuts:
    """Edges at the values whose rank among all rows comes next above each share; few distinct values are all edges.

    The values are counted in one pass by their leading bits (in the order of doubles), those that share the leading bits of a
    wanted rank in another pass by the next bits, and so on: exact ranks, no sample and no sort."""
    dim = data.dim
    shares = np.arange(1, bins) / bins
    known = np.zeros((dim, bins - 1), np.uint64)  # leading bits of the wanted values found so far
    total = ranks = None
    for level, width in enumerate(LEVELS):
        shift = np.uint64(64 - sum(LEVELS[:level + 1]))
        cells = [np.unique(k) for k in known]
        starts = np.concatenate([[0], np.cumsum([len(c) for c in cells])]) << width

        def each(rows: B.Rows, shift=shift, cells=cells, starts=starts, level=level, width=width) -> np.ndarray:
            out = np.zeros(starts[-1])
            for f in range(dim):
                v = rows.x[:, f]
                some = ~np.isnan(v)
                order, count = _ordered(v[some]), rows.count[some]
                top = order >> (shift + np.uint64(width)) if level else np.zeros(len(order), np.uint64)
                cell = np.searchsorted(cells[f], top)
                cell[cell == len(cells[f])] = 0
                same = cells[f][cell] == top
                at = (cell[same].astype(np.int64) << width) + ((order[same] >> shift) & np.uint64((1 << width) - 1)).astype(np.int64)
                out[starts[f]:starts[f + 1]] += np.bincount(at, count[same], starts[f + 1] - starts[f])
            return out

        counts = B.summed(data, each, int(starts[-1]))
        if total is None:
            total = np.array([counts[starts[f]:starts[f + 1]].sum() for f in range(dim)])
            ranks = np.maximum(np.ceil(shares[None, :] * total[:, None]), 1)  # rank inside the cell, from 1
        for f in range(dim):
            for j in range(bins - 1):
                if not total[f]:
                    continue
                cell = int(np.searchsorted(cells[f], known[f, j]))
                inside = np.cumsum(counts[starts[f] + (cell << width):starts[f] + ((cell + 1) << width)])
                place = int(np.searchsorted(inside, ranks[f, j], "left"))
                ranks[f, j] -= inside[place - 1] if place else 0
                known[f, j] = known[f, j] << np.uint64(width) | np.uint64(place)
    # the highest value is no edge: nothing lies above it
    return Cuts([np.unique(_doubles(known[f])) if total[f] else np.zeros(0) for f in range(dim)])


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order."""
    bits = (x + 0.0).view(np.uint64)  # -0.0 becomes 0.0
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _doubles(order: np.ndarray) -> np.ndarray:
    return np.where(order >> np.uint64(63) == 1, order & np.uint64((1 << 63) - 1), ~order).view(np.float64)


def scores(trees: list[list[Tree]], bins: np.ndarray, k: int) -> np.ndarray:
    """Scores (rows x classes) of a model, a list of rounds."""
    out = np.zeros((len(bins), k))
    for grown in trees:
        for c, tree in enumerate(grown):
            out[:, c] += np.array(tree.value)[tree.leaves(bins)]
    return out


def softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def best_split(hist: np.ndarray, least: float) -> tuple[float, int, int, bool] | None:
    """(gain, feature, cut, missing values to the left) of a node's (feature x bin x 2) sums; the last bin holds the missing values."""
    total = hist[0].sum(0)
    below = np.cumsum(hist[:, :-1], 1)[:, :-1]  # bins below cut 1, 2, ...
    missing = hist[:, -1:]
    left = np.stack([below + missing, below], 2)  # feature x cut x (missing left, missing right) x 2
    right = total - left
    fits = (left[..., 1] >= least) & (right[..., 1] >= least)
    gain = left[..., 0] ** 2 / (left[..., 1] + RIDGE) + right[..., 0] ** 2 / (right[..., 1] + RIDGE) - total[0] ** 2 / (total[1] + RIDGE)
    gain = np.where(fits, gain, -np.inf)
    # equal gains may differ in their last bits: the first within a relative 1e-9 wins
    top = gain.max()
    if not top > 1e-9:
        return None
    f, cut, side = np.unravel_index(int(np.flatnonzero(gain.ravel() >= top * (1 - 1e-9))[0]), gain.shape)
    return float(gain[f, cut, side]), int(f), int(cut) + 1, side == 0


@dataclasses.dataclass
class _Node:
    model: int
    cls: int
    node: int
    depth: int
    hist: np.ndarray | None = None
    parent: "_Node | None" = None
    sibling: "_Node | None" = None


def _histograms(data: B.Blocks, models: list[tuple[Point, int]], done: list, growing: list, nodes: list[_Node], weights: np.ndarray, classes) -> None:
    """Sums gradient and hessian by (feature, bin) of these nodes over binned rows, in passes of bounded size."""
    dim, width, k = data.dim, BINS + 1, len(classes)
    cell = dim * width * 2
    some = max(1, PASS_BYTES // (8 * cell))
    for a in range(0, len(nodes), some):
        chunk = nodes[a:a + some]
        wanted: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for place, n in enumerate(chunk):
            wanted.setdefault(n.model, {}).setdefault(n.cls, []).append((place, n.node))
        trees = {m: (done[m], growing[m]) for m in wanted}
        target = np.array(classes, np.float64)

        def each(rows: B.Rows, wanted=wanted, trees=trees, size=len(chunk)) -> np.ndarray:
            out = np.zeros((size, dim, width, 2))
            hit = rows.y[:, None] == target
            for m, by_class in wanted.items():
                own = (rows.part[:, models[m][1]] == 1) & hit.any(1)
                b, y = rows.x[own], hit[own].astype(np.float64)
                weight = y @ weights[models[m][1]] * rows.key[own]
                p = softmax(scores(trees[m][0], b, k))
                for c, places in by_class.items():
                    g, h = weight * (p[:, c] - y[:, c]), weight * np.maximum(2 * p[:, c] * (1 - p[:, c]), 1e-16)
                    tree = trees[m][1][c]
                    slot = np.full(len(tree.feature), -1)
                    slot[[node for _, node in places]] = np.arange(len(places))
                    at = slot[tree.leaves(b)]
                    inside = np.flatnonzero(at >= 0)
                    at, gi, hi = at[inside] * width, g[inside], h[inside]
                    target_places = [place for place, _ in places]
                    for f in range(dim):
                        cells = at + b[inside, f]
                        for s, v in enumerate((gi, hi)):
                            out[target_places, f, :, s] = np.bincount(cells, v, len(places) * width).reshape(-1, width)
            return out.ravel()

        sums = B.summed(data, each, len(chunk) * cell).reshape(len(chunk), dim, width, 2)
        for n, hist in zip(chunk, sums):
            n.hist = hist


def binned(data: B.Blocks, cuts: Cuts) -> B.Blocks:
    """The rows by their bins, equal ones added up."""
    return B.distinct(data, cuts.bins) if data.dim else data


def train(data: B.Blocks, models: list[tuple[Point, int]], rounds: int = 20, balanced: bool = False, classes=CLASSES) -> list[list[list[Tree]]]:
    """The trees of every model (point, fold) on ``binned`` rows: rounds x classes, grown side by side."""
    k = len(classes)
    weights = B.class_weights(data.counts) if balanced else np.ones(data.counts.shape)
    done: list[list[list[Tree]]] = [[] for _ in models]
    for _ in range(rounds):
        growing = [[Tree.new() for _ in range(k)] for _ in models]
        # the largest models last: those of little depth need no further pass
        level = [_Node(m, c, 0, 0) for m in range(len(models)) for c in range(k)]
        while level:
            # of two siblings the lighter one is summed, the other one is the rest of their parent
            asked = [n for n in level if n.parent is None or n.hist is None and not _heavier(n)]
            _histograms(data, models, done, growing, asked, weights, classes)
            below = []
            for n in level:
                if n.hist is None:
                    n.hist = n.parent.hist - n.sibling.hist
            for n in level:
                point, tree = models[n.model][0], growing[n.model][n.cls]
                g, h = n.hist[0].sum(0)
                tree.value[n.node] = -point.rate * g / (h + RIDGE)
                found = best_split(n.hist, point.min_child_weight) if n.depth < point.depth else None
                if found is None:
                    continue
                _, feature, cut, missing_left = found
                first = tree.split(n.node, feature, cut, missing_left)
                if n.depth + 1 < point.depth:
                    left, right = (_Node(n.model, n.cls, first + s, n.depth + 1, parent=n) for s in (0, 1))
                    left.sibling, right.sibling = right, left
                    left.weight = _side(n.hist[feature], cut, missing_left)
                    right.weight = h - left.weight
                    below += [left, right]
                else:  # the last level's values are known from the split's own sums
                    gl, hl = _side(n.hist[feature], cut, missing_left, both=True)
                    for s, (gs, hs) in enumerate(((gl, hl), (g - gl, h - hl))):
                        tree.value[first + s] = -point.rate * gs / (hs + RIDGE)
            for n in level:
                n.parent = n.sibling = None
            level = below
        for m, grown in enumerate(growing):
            done[m].append(grown)
    return done


def _heavier(n: _Node) -> bool:
    return (n.weight, n.node) > (n.sibling.weight, n.sibling.node)


def _side(hist: np.ndarray, cut: int, missing_left: bool, both: bool = False):
    total = hist[:cut].sum(0) + (hist[-1] if missing_left else 0)
    return total if both else total[1]


def confusions(data: B.Blocks, models: list[tuple[Point, int]], trees: list, classes=CLASSES) -> np.ndarray:
    """Counts (models x truth x prediction) over the binned rows that each model's fold scores, in one pass."""
    k = len(classes)

    def each(rows: B.Rows) -> np.ndarray:
        out = np.zeros((len(models), k, k))
        truth = np.searchsorted(classes, rows.y)
        for m, (_, fold) in enumerate(models):
            scored = (rows.part[:, fold] == 2) & np.isin(rows.y, classes)
            best = scores(trees[m], rows.x[scored], k).argmax(1)
            out[m] = np.bincount(truth[scored] * k + best, rows.key[scored], k * k).reshape(k, k)
        return out.ravel()

    return B.summed(data, each, len(models) * k * k).reshape(len(models), k, k).astype(np.int64)


def search(data: B.Blocks, points: list[Point], rounds: int = 20, balanced: bool = False, classes=CLASSES) -> np.ndarray:
    """Confusion counts (points x folds x truth x prediction) of every point, fitted and scored in every fold."""
    models = [(p, f) for p in points for f in range(data.folds)]
    k, rows = len(classes), binned(data, quantile_cuts(data))
    out = np.zeros((len(models), k, k), np.int64)
    held = cells(rows, classes)
    if held is not None:
        weights = B.class_weights(data.counts) if balanced else np.ones(data.counts.shape)

        def counted(held: Cells, own: list[Point], fold: int) -> bytes:
            best = [score.argmax(1) for _, score in grown(held, own, fold, rounds, weights[fold])]
            return np.array([[held.scored[fold, b == c].sum(0) for c in range(k)] for b in best], np.int64).tobytes()

        alike: dict[tuple, list[int]] = {}
        for m, (p, f) in enumerate(models):
            alike.setdefault((p.rate, p.depth, f), []).append(m)
        found = _each_job(data.table.sparkSession, held, [([models[m][0] for m in own], f) for (_, _, f), own in alike.items()], counted)
        for own, counts in zip(alike.values(), found):  # by prediction, then truth
            out[own] = np.frombuffer(counts, np.int64).reshape(len(own), k, k).transpose(0, 2, 1)
        return out.reshape(len(points), data.folds, k, k)
    for group in _groups(models, data.dim, k):
        own = [models[m] for m in group]
        out[group] = confusions(rows, own, train(rows, own, rounds, balanced, classes), classes)
    return out.reshape(len(points), data.folds, k, k)


def _groups(models: list[tuple[Point, int]], dim: int, k: int) -> list[list[int]]:
    """Models of like depth together, so many that the histograms of two levels are bounded."""
    out, held = [], 0
    for m in sorted(range(len(models)), key=lambda m: models[m][0].depth):
        size = (2 ** models[m][0].depth) * k * dim * (BINS + 1) * 16
        if not out or held + size > HELD_BYTES:
            out.append([])
            held = 0
        out[-1].append(m)
        held += size
    return out

@dataclasses.dataclass
class Cells:
    """Distinct bins (cells x features) and how many rows of each class train (``trained``) and are scored (``scored``) there, by fold."""

    x: np.ndarray
    trained: np.ndarray  # folds x cells x classes
    scored: np.ndarray


def cells(data: B.Blocks, classes=CLASSES) -> Cells | None:
    """The cells of ``binned`` rows; None where the rows or the cells take more than ``CELL_BYTES``."""
    n = data.table.agg(F.sum("n")).first()[0] or 0
    if not data.dim or not n or n * (data.dim + 16 + data.folds) > CELL_BYTES:
        return None
    rows = [r for b in data.read[0].toArrow().to_batches() for r in B.rows_of(b, data.folds, data.kind)]
    x, y, part, count = (np.concatenate([getattr(r, c) for r in rows]) for c in ("x", "y", "part", "key"))
    found, at = np.unique(x.view(f"V{data.dim}").ravel(), return_inverse=True)
    if len(found) * (data.dim + 16 * data.folds * len(classes)) > CELL_BYTES:
        return None
    out = Cells(found.view(np.uint8).reshape(-1, data.dim), *(np.zeros((data.folds, len(found), len(classes))) for _ in range(2)))
    for f in range(data.folds):
        for c, name in enumerate(classes):
            for kind, to in ((1, out.trained), (2, out.scored)):
                own = (part[:, f] == kind) & (y == name)
                to[f, :, c] = np.bincount(at[own], count[own], len(found))
    return out


def best_splits(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """``best_split`` of many nodes at once: gradients and hessians (nodes x features x bins), missing values in the last bin. Of each node
    whether it is split, feature, cut, missing values to the left, the left side's gradient and hessian, and up to which ``least`` all this stays so."""
    n, dim, width = g.shape
    total_g, total_h = g[:, 0].sum(1)[:, None, None, None], h[:, 0].sum(1)[:, None, None, None]
    below_g, below_h = (np.cumsum(v[..., :-1], 2)[..., :-1, None] for v in (g, h))
    miss_g, miss_h = g[..., -1:, None], h[..., -1:, None]
    if miss_h.any():
        left_g, left_h = np.concatenate([below_g + miss_g, below_g], 3), np.concatenate([below_h + miss_h, below_h], 3)
    else:  # both sides are the same, the left one comes first
        left_g, left_h = below_g, below_h
    right_g, right_h = total_g - left_g, total_h - left_h
    gain = left_g ** 2 / (left_h + RIDGE) + right_g ** 2 / (right_h + RIDGE) - total_g ** 2 / (total_h + RIDGE)
    gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf).reshape(n, -1)
    top = gain.max(1)
    split = top > 1e-9
    at = (gain >= np.where(split, top * (1 - 1e-9), -np.inf)[:, None]).argmax(1)
    sides = left_g.shape[3]
    feature, cut, side = at // ((width - 2) * sides), at // sides % (width - 2) + 1, at % sides
    pick, left_h, right_h = np.arange(n), left_h.reshape(n, -1), right_h.reshape(n, -1)
    # a larger weight forbids cuts: the choice stays while it and the cut of the very best gain are allowed
    holds = np.min([v[pick, i] for v in (left_h, right_h) for i in (at, gain.argmax(1))], axis=0)
    return split, feature, cut, side == 0, left_g.reshape(n, -1)[pick, at], left_h[pick, at], np.where(split, holds, np.inf)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, point: Point) -> tuple[Tree, np.ndarray, float]:
    """One tree on the cells' gradients and hessians (``x``: features x cells), the node in which each cell ends, and the largest
    ``min_child_weight`` with which it would be the same."""
    dim, size = x.shape
    width = BINS + 1
    empty = (-1, 0, False, -1)  # feature, cut, missing_left, left: an array each for every level
    tree = [[np.array([v])] for v in empty]
    values, node, nodes, same = [], np.zeros(size, np.int64), 1, np.inf
    rows, slot = np.arange(size), np.zeros(size, np.int64)  # cells of open nodes and the node's place in the level
    parent, asked = None, np.ones(1, bool)
    for depth in range(point.depth):
        place = np.cumsum(asked) - 1
        some = asked[slot]
        own, at, gi, hi = rows[some], place[slot[some]] * width, g[rows[some]], h[rows[some]]
        sums = np.empty((2, len(asked), dim, width))
        for f in range(dim):
            bins = at + x[f][own]
            for k, v in enumerate((gi, hi)):
                sums[k, asked, f] = np.bincount(bins, v, int(asked.sum()) * width).reshape(-1, width)
        if parent is not None:  # of two siblings the lighter one is summed, the other one is the rest of their parent
            rest = np.flatnonzero(~asked)
            sums[:, rest] = parent[:, rest // 2] - sums[:, rest ^ 1]
        if not depth:
            total_g, total_h = sums[:, :, 0].sum(2)
            values.append(-point.rate * total_g / (total_h + RIDGE))
        step = max(1, SEARCHED // (8 * dim * width))
        found = [best_splits(*sums[:, i:i + step], point.min_child_weight) for i in range(0, len(asked), step)]
        split, feature, cut, missing_left, left_g, left_h, holds = (np.concatenate(c) for c in zip(*found))
        same = min(same, holds.min())
        if not split.any():
            break
        feature, cut, missing_left, left_g, left_h = (c[split] for c in (feature, cut, missing_left, left_g, left_h))
        first = nodes + 2 * np.arange(len(feature))
        for column, new, none in zip(tree, (feature, cut, missing_left, first), empty):
            column[-1][split] = new
            column.append(np.full(2 * len(first), none))
        side_g = np.stack([left_g, total_g[split] - left_g], 1).ravel()
        side_h = np.stack([left_h, total_h[split] - left_h], 1).ravel()
        values.append(-point.rate * side_g / (side_h + RIDGE))
        to = np.full(len(asked), -1)
        to[split] = np.arange(len(first))
        into = to[slot]
        rows, into = rows[into >= 0], into[into >= 0]
        bins = x[feature[into], rows]
        right = np.where(bins == BINS, ~missing_left[into], bins >= cut[into])
        slot = 2 * into + right
        node[rows] = nodes + slot
        parent, total_g, total_h = sums[:, split], side_g, side_h
        nodes += 2 * len(first)
        lighter = left_h <= side_h[1::2]
        asked = np.stack([lighter, ~lighter], 1).ravel()
    if not values:  # no depth: a single leaf
        values.append(np.array([-point.rate * g.sum() / (h.sum() + RIDGE)]))
    return Tree(*(np.concatenate(c).tolist() for c in tree), np.concatenate(values).tolist()), node, same


def grown(held: Cells, points: list[Point], fold: int, rounds: int, weights: np.ndarray) -> list[tuple[list[list[Tree]], np.ndarray]]:
    """Models of like rate and depth on one fold's training rows: of each point the trees, a list of rounds, and the scores
    (cells x classes) of all cells; ``weights`` by class."""
    count = held.trained[fold] * weights
    total, k = count.sum(1), count.shape[1]
    trains = np.flatnonzero(held.trained[fold].sum(1) > 0)
    x, count, total = np.ascontiguousarray(held.x[trains].T), count[trains], total[trains]
    # points (the least weights first) with the same trees so far, these trees and the scores
    states = [(sorted(range(len(points)), key=lambda i: points[i].min_child_weight), [], np.zeros((len(trains), k)))]
    for _ in range(rounds):
        after = []
        for left, done, own in states:
            p = softmax(own)
            while left:
                found = [_grow(x, total * p[:, c] - count[:, c], total * np.maximum(2 * p[:, c] * (1 - p[:, c]), 1e-16), points[left[0]]) for c in range(k)]
                most = max(points[left[0]].min_child_weight, min(same for _, _, same in found))
                alike, left = [i for i in left if points[i].min_child_weight <= most], [i for i in left if points[i].min_child_weight > most]
                after.append((alike, [*done, [tree for tree, _, _ in found]], own + np.stack([np.array(tree.value)[node] for tree, node, _ in found], 1)))
        states = after
    other = np.ones(len(held.x), bool)
    other[trains] = False
    out = [None] * len(points)
    for alike, done, own in states:
        score = np.zeros((len(held.x), k))
        score[trains] = own
        if other.any():
            score[other] = scores(done, held.x[other], k)
        for i in alike:
            out[i] = done, score
    return out


def _each_job(spark: SparkSession, held: Cells, jobs: list[tuple[list[Point], int]], run: Callable[[Cells, list[Point], int], bytes]) -> list[bytes]:
    """``run(cells, points, fold)`` of every job, one a task, the deepest first."""
    order = sorted(range(len(jobs)), key=lambda j: -jobs[j][0][0].depth)
    sent = spark.sparkContext.broadcast(held)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([order[i]], pa.int64()), pa.array([run(sent.value, *jobs[order[i]])], pa.binary())], names=["job", "found"])

    try:
        rows = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(task, "job bigint, found binary").collect()
    finally:
        sent.destroy()
    return [r["found"] for r in sorted(rows)]


class BoostedTrees:
    """Boosted trees as an estimator: of a vector column, or of numeric columns whose nulls are missing values."""

    def __init__(self, point: Point, rounds: int = 20, balanced: bool = False, features: str | list[str] = "features", label: str = "label", classes=CLASSES):
        self.point, self.rounds, self.balanced, self.features, self.label, self.classes = point, rounds, balanced, features, label, classes

    def fit(self, df: DataFrame) -> "BoostedTreesModel":
        data = B.pack(df, None, self.features, self.label, self.classes, merged=True)
        cuts = quantile_cuts(data)
        rows, rounds = binned(data, cuts), self.rounds
        held = cells(rows, self.classes)
        if held is None:
            trees, = train(rows, [(self.point, 0)], rounds, self.balanced, self.classes)
        else:
            weights = B.class_weights(data.counts)[0] if self.balanced else np.ones(len(self.classes))
            found, = _each_job(df.sparkSession, held, [([self.point], 0)], lambda held, points, fold: pickle.dumps(grown(held, points, fold, rounds, weights)[0][0]))
            trees = pickle.loads(found)
        return BoostedTreesModel(trees, cuts, self.features, self.classes)


class BoostedTreesModel:
    def __init__(self, trees: list[list[Tree]], cuts: Cuts, features: str | list[str], classes):
        self.trees, self.cuts, self.features, self.classes = trees, cuts, features, classes

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: the class with the largest score (ties: the smallest class)."""
        trees, cuts, names = self.trees, self.cuts, np.array(self.classes, np.float64)
        if not cuts.edges:  # nothing was learned from
            return df.withColumn("prediction", F.lit(float(names[0])))

        @F.pandas_udf("double")
        def best(*x: pd.Series) -> pd.Series:
            bins = cuts.bins(np.column_stack([v.to_numpy(np.float64) for v in x]))
            found, at = np.unique(bins.view(f"V{bins.shape[1]}").ravel(), return_inverse=True)
            return pd.Series(names[scores(trees, found.view(np.uint8).reshape(len(found), -1), len(names)).argmax(1)][at])

        if not isinstance(self.features, str):
            return df.withColumn("prediction", best(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in self.features]))
        out = df.withColumn("_x", vector_to_array(F.col(self.features)))
        return out.withColumn("prediction", best(*[F.col("_x")[i] for i in range(len(cuts.edges))])).drop("_x")
