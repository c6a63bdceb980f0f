"""Random forests on binned rows, to boost over.

Features are cut into bins at quantiles once, and rows of equal bins and label are added up to one (``boosting.binned``). Trees split by
the least Gini impurity, every node among its own draw of features (the root of their number), and grow level by level, all
trees of a forest in the same passes: a pass adds up, for every open node, the classes' weights by (feature, bin), and the
driver, which sees these sums only, chooses the cuts. A row without a value goes right.

Every tree draws the rows with replacement: each counts Poisson(1) times, so the ``n`` rows that were added up count Poisson(n)
times together. The draw is a hash of (bins, label, tree, seed): a fit repeats exactly, wherever a row lies. As in MLlib, a pair of
leaves that predict the same class is merged, and a forest's probabilities are the mean of its leaves' shares of the classes.

Boosting changes the weights of rows by the probabilities (or the prediction) of their bins, so rows of equal bins and label keep
equal weights, and a round rewrites one weight for each of these.
"""

from __future__ import annotations

import dataclasses
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.operators import blocks as B
from stayframe.operators import boosting as BT
from stayframe.session import stage_path

WIDTH = BT.BINS + 1
#: Up to this mean a Poisson draw follows its distribution term by term, above it a normal one with its skewness.
TERMS = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def names_of(bins: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bins and class."""
    out = _mixed(cls.astype(np.uint64) + np.uint64(1))
    for f in range(bins.shape[1]):
        out = _mixed(out + bins[:, f].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


def _uniform(names: np.ndarray, seed: int, tree: int, which: int) -> np.ndarray:
    place = _mixed(np.array([(seed << 24) + (tree << 1) + which], np.uint64))
    return (_mixed(names ^ place) >> np.uint64(11)) * 2.0 ** -53


def draws(times: np.ndarray, names: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each of the rows, which stand for ``times`` rows each: Poisson numbers of these means."""
    u, out = _uniform(names, seed, tree, 0), np.zeros(len(times))
    few = np.flatnonzero(times <= TERMS)
    mean, share = times[few].astype(np.float64), u[few]
    term = np.exp(-mean)
    below, count, live = term.copy(), np.zeros(len(few)), np.flatnonzero(share >= term)
    while len(live):
        count[live] += 1
        term[live] *= mean[live] / count[live]
        below[live] += term[live]
        live = live[(share[live] >= below[live]) & ((count[live] < mean[live]) | (term[live] > 1e-18))]
    out[few] = count
    many = np.flatnonzero(times > TERMS)
    if len(many):
        z = np.sqrt(-2 * np.log(1 - u[many])) * np.cos(2 * np.pi * _uniform(names[many], seed, tree, 1))
        mean = times[many].astype(np.float64)
        out[many] = np.maximum(np.floor(mean + np.sqrt(mean) * z + (z * z - 1) / 6 + 0.5), 0)
    return out


@dataclasses.dataclass
class _Node:
    tree: int
    node: int
    depth: int
    features: np.ndarray


def _sums(data: B.Blocks, trees: list[BT.Tree], nodes: list[_Node], seed: int, by_class: np.ndarray, classes) -> Iterator[np.ndarray]:
    """Weights (feature drawn x bin x class) of every node, in passes of bounded size."""
    m, k = len(nodes[0].features), len(classes)
    some = max(1, BT.PASS_BYTES // (8 * m * WIDTH * k))
    target = np.array(classes, np.float64)
    for a in range(0, len(nodes), some):
        chunk = nodes[a:a + some]
        own: dict[int, list[int]] = {}
        for place, n in enumerate(chunk):
            own.setdefault(n.tree, []).append(place)
        asked, grown = np.array([n.features for n in chunk]), {t: trees[t] for t in own}
        at_node = [n.node for n in chunk]

        def each(rows: B.Rows) -> np.ndarray:
            out = np.zeros((len(at_node), m, WIDTH, k))
            known = np.isin(rows.y, target)
            bins, times, cls = rows.x[known], rows.key[known], np.searchsorted(target, rows.y[known])
            weight = by_class[cls] if rows.weight is None else by_class[cls] * rows.weight[known]
            names = names_of(bins, cls)
            for t, places in own.items():  # a tree's places follow each other
                slot = np.full(len(grown[t].feature), -1)
                slot[[at_node[p] for p in places]] = np.arange(len(places))
                at = slot[grown[t].leaves(bins)]
                inside = np.flatnonzero(at >= 0)
                drawn = draws(times[inside], names[inside], seed, t)
                inside, drawn = inside[drawn > 0], drawn[drawn > 0]
                at, value, c = at[inside], drawn * weight[inside], cls[inside]
                for j in range(m):
                    cell = (at * WIDTH + bins[inside, asked[places[0] + at, j]]) * k + c
                    out[places[0]:places[-1] + 1, j] = np.bincount(cell, value, len(places) * WIDTH * k).reshape(-1, WIDTH, k)
            return out.ravel()

        yield from B.summed(data, each, len(chunk) * m * WIDTH * k).reshape(len(chunk), m, WIDTH, k)


def best_split(sums: np.ndarray) -> tuple[int, int] | None:
    """(which of the features, cut) of the least Gini impurity (ties: the first feature, the lowest cut), if it lessens it."""
    total = sums[0].sum(0)
    left = np.cumsum(sums, 1)[:, :-1]
    right = total - left
    wl, wr, w = left.sum(2), right.sum(2), total.sum()
    fits = (wl > 1e-12 * w) & (wr > 1e-12 * w)
    if not fits.any():
        return None
    pure = (left ** 2).sum(2) / np.where(fits, wl, 1) + (right ** 2).sum(2) / np.where(fits, wr, 1) - (total ** 2).sum() / w
    pure = np.where(fits, pure, -np.inf)
    top = pure.max()
    if not top > 1e-9 * w:
        return None
    f, cut = np.unravel_index(int(np.flatnonzero(pure.ravel() >= top * (1 - 1e-9))[0]), pure.shape)
    return int(f), int(cut) + 1


def _shares(sums: np.ndarray) -> np.ndarray:
    total = sums.sum()
    return sums / total if total > 0 else np.full(len(sums), 1 / len(sums))


def _merge_equal_leaves(tree: BT.Tree) -> None:
    """Pairs of leaves that predict the same class become one leaf, from below."""
    for node in reversed(range(len(tree.feature))):  # children come after their parent
        first = tree.left[node]
        if tree.feature[node] >= 0 and tree.feature[first] < 0 and tree.feature[first + 1] < 0 and \
                np.argmax(tree.value[first]) == np.argmax(tree.value[first + 1]):
            tree.feature[node], tree.left[node] = -1, -1


def train(data: B.Blocks, trees: int, depth: int, seed: int, by_class: np.ndarray, classes) -> list[BT.Tree]:
    """A forest on ``boosting.binned`` rows. Nodes hold the classes' weights; ``by_class`` weighs the classes."""
    k, m = len(classes), max(1, math.ceil(math.sqrt(data.dim))) if trees > 1 else max(1, data.dim)
    out = [BT.Tree([-1], [0], [False], [-1], [np.zeros(k)]) for _ in range(trees)]
    if not data.dim:
        return out

    def node(tree: int, place: int, level: int) -> _Node:
        rng = np.random.default_rng([seed, tree, place])
        return _Node(tree, place, level, np.sort(rng.choice(data.dim, m, replace=False)))

    level = [node(t, 0, 0) for t in range(trees)] if depth else []
    while level:
        below = []
        for n, sums in zip(level, _sums(data, out, level, seed, by_class, classes)):
            tree = out[n.tree]
            tree.value[n.node] = sums[0].sum(0)
            found = best_split(sums)
            if found is None:
                continue
            j, cut = found
            first = tree.split(n.node, int(n.features[j]), cut, False)
            left = sums[j, :cut].sum(0)
            for s, part in enumerate((left, sums[j].sum(0) - left)):
                tree.value[first + s] = part
                if n.depth + 1 < depth and (part > 0).sum() > 1:
                    below.append(node(n.tree, first + s, n.depth + 1))
        level = below
    for tree in out:
        _merge_equal_leaves(tree)
        tree.__dict__.pop("steps", None)
    return out


def probabilities(trees: list[BT.Tree], bins: np.ndarray) -> np.ndarray:
    """Mean of the trees' shares of the classes (rows x classes)."""
    total = 0.0
    for tree in trees:
        total = total + np.array([_shares(v) for v in tree.value])[tree.leaves(bins)]
    return total / len(trees)


def reweighted(data: B.Blocks, change: Callable[[B.Rows], tuple[np.ndarray, np.ndarray]], sums: int) -> tuple[B.Blocks, np.ndarray]:
    """The rows with new weights, written, and the sums over them of what ``change`` returns beside the weights (rows x ``sums``)."""
    spark, folds, kind = data.table.sparkSession, data.folds, data.kind

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for i, rows in enumerate(B.rows_of(b, folds, kind)):
                weight, beside = change(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, 1) for c in range(6)), pa.array([weight.tobytes()], pa.binary()), pa.array([beside.sum(0).tolist()], pa.list_(pa.float64()))],
                    names=["n", "dim", "x", "y", "part", "key", "weight", "beside"])

    schema = "n int, dim int, x binary, y binary, part binary, key binary, weight binary, beside array<double>"
    path = stage_path(spark, f"weights-{uuid.uuid4().hex}")
    data.read[0].mapInArrow(run, schema).write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    found = table.agg(*[F.sum(F.col("beside")[i]) for i in range(sums)]).first()
    return dataclasses.replace(data, table=table), np.array([v or 0.0 for v in found])


def predicted(df: DataFrame, features: str, cuts: BT.Cuts, value: Callable[[np.ndarray], np.ndarray], kind: str, name: str) -> DataFrame:
    """Adds ``value`` of each row's bins."""
    width = len(cuts.edges)

    @F.pandas_udf(kind)
    def of(*x: pd.Series) -> pd.Series:
        bins = cuts.bins(np.column_stack([v.to_numpy(np.float64) for v in x]))
        found, at = np.unique(bins.view(f"V{width}").ravel(), return_inverse=True)
        out = value(found.view(np.uint8).reshape(len(found), -1))[at]
        return pd.Series(out if out.ndim == 1 else list(out))

    x = vector_to_array(F.col(features))
    return df.withColumn(name, of(*[x[i] for i in range(width)]))
