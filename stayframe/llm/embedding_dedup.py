"""Near-duplicate embeddings by a forest of random-projection trees with spill.

Only vectors with the same (not null) label are compared. Equal vectors of a label are one
class with a count. For each label and tree, random directions (one per level) and cuts of
their projections, fitted on a bounded sample of at most ``SAMPLE`` vectors, split the vectors
again and again until a leaf holds about ``LEAF`` of them; a vector within ``margin(least)`` of a
cut goes to both sides. The projections of a linked pair differ by a normal number of deviation
``sqrt(2 - 2 * least)`` at most, so the share of such pairs that a cut parts follows from the share of the
node's vectors within its margin; of ``CUTS`` places the one with the fewest is taken. Trees are independent,
so a pair is missed only where every tree parts it: each label gets as many trees as bring the expected
share of found pairs, those just at ``least`` (nearer ones are parted less), to ``recall``. A node that
no split of ``TRIES`` makes much smaller, or whose splits would part more than ``PARTED`` of its linked pairs (its
vectors are nearly as near each other as linked ones: a dense group), is not split
further: it stays one leaf. Every class is put in its leaves of all trees (of one, if that is a
single leaf) and compared exactly, in double precision, with all others of each leaf. A pair is
counted in the first tree, and there in the first leaf, that has both (a split's overlap puts both
in several), so a found pair counts once without a table of pairs. What
leaves a leaf is one row per vector: its number of links, and the smallest vector of its linked
group there, whose links are then united over all leaves.

A leaf of more than ``BLOCK`` classes (a dense group that splits cannot part, or more vectors than
the sample supports) is cut into blocks, and every pair of blocks is a task of its own: no limit,
and no task holds more than two blocks. Vectors that are null, empty, zero or hold null or non-finite
components, and those without a label, link with nothing; so do vectors of different lengths.
Repeated rows count as vectors of their own. Empty input: no rows. Extra columns are not read.
"""

from __future__ import annotations

import dataclasses
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import staged
from .components import components

LEAF, BLOCK, SAMPLE, NODE_SAMPLE = 1000, 2048, 100_000, 40
#: Bytes of the sample on the driver at most.
SAMPLE_BYTES = 128 << 20
#: Expected share of found pairs, and trees at most (a label that would need more is one leaf, cut into blocks).
RECALL, MOST_TREES = 0.995, 24
#: Deviations of a linked pair's difference that a split's overlap spans; places tried for a cut; the share of a node's comparisons that a
#: split may leave, the share of linked pairs that it may part, and the directions tried for one that keeps to both.
REACH, CUTS, WORTH, PARTED, TRIES = 0.6, 13, 0.9, 0.12, 8


def margin(least: float) -> float:
    """Half the overlap of a split: directions are normal, so the projections of unit vectors u, v differ by a normal
    number of deviation ``|u - v|``, which is ``sqrt(2 - 2 * least)`` at most for a linked pair."""
    return REACH / 2 * float(np.sqrt(max(0.0, 2 - 2 * least)))


def parted(overlap: float) -> float:
    """Expected share of linked pairs (at the bound) that a cut parts, given the share of vectors in its overlap: a
    pair is parted if its difference spans the overlap and the cut lies inside what is left."""
    tail = 0.5 * math.erfc(REACH / math.sqrt(2))
    return overlap * 2 * (math.exp(-REACH * REACH / 2) / math.sqrt(2 * math.pi) - REACH * tail) / REACH


@dataclasses.dataclass
class Tree:
    """One direction a level; a node's vectors below ``high`` by that of its ``level`` (-1: a leaf) go to ``left``, from ``low`` on to ``right``."""

    directions: np.ndarray
    level: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    #: Expected share of linked pairs that stand together in some leaf.
    recall: float = 1.0

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of unit vectors; a row may stand in several leaves."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k, d in enumerate(self.directions):
            split = self.level[node] == k
            p, at = (x @ d)[row[split]], node[split]
            left, right = p < self.high[at], p >= self.low[at]
            row, node = (np.concatenate([old[~split], a[left], b[right]]) for old, a, b in
                         ((row, row[split], row[split]), (node, self.left[at], self.right[at])))
        return row, node


def grow(x: np.ndarray, total: int, rng: np.random.Generator, least: float, leaf: int | None = None) -> Tree:
    """A tree for ``total`` vectors of which ``x`` (unit vectors) is a sample."""
    leaf, half = LEAF if leaf is None else leaf, margin(least)
    directions, level_of, low, high, left, right = [], [-1], [np.inf], [np.inf], [-1], [-1]
    kept, held = [1.0], [len(x)]
    enough = max(leaf * len(x) / max(total, 1), 2 * NODE_SAMPLE)
    level = [(0, np.arange(len(x)), 1)] if len(x) > enough else []
    while level:
        d, below = rng.normal(size=x.shape[1]), []
        for node, own, tried in level:
            p = np.sort(x[own] @ d)
            cuts = np.quantile(p, np.linspace(0.35, 0.65, CUTS))
            inside = np.searchsorted(p, cuts + half) - np.searchsorted(p, cuts - half)
            cut = cuts[np.lexsort((np.abs(np.arange(CUTS) - CUTS // 2), inside))[0]]
            p = x[own] @ d
            parts = own[p < cut + half], own[p >= cut - half]
            loss = parted((len(parts[0]) + len(parts[1]) - len(own)) / len(own))
            if loss > PARTED or sum(len(part) ** 2 for part in parts) > WORTH * len(own) ** 2:
                if tried < TRIES:  # else linked pairs stand across any split: left to the exact comparison
                    below.append((node, own, tried + 1))
                continue
            level_of[node] = len(directions)
            low[node], high[node], left[node], right[node] = cut - half, cut + half, len(left), len(left) + 1
            for part in parts:
                if len(part) > enough:
                    below.append((len(left), part, 1))
                kept.append(kept[node] * (1 - loss))
                held.append(len(part))
                for column, empty in ((low, np.inf), (high, np.inf), (left, -1), (right, -1), (level_of, -1)):
                    column.append(empty)
        directions.append(d)
        level = below
    ends = np.flatnonzero(np.array(level_of) < 0)
    weight = np.array(held, np.float64)[ends]
    recall = float((np.array(kept)[ends] * weight).sum() / weight.sum()) if weight.sum() else 1.0
    return Tree(np.array(directions).reshape(-1, x.shape[1]), np.array(level_of), np.array(low), np.array(high), np.array(left), np.array(right), recall)


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty, finite throughout and not zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def _trees(x: np.ndarray, total: int, least: float, recall: float, trees: int, seed: list[int]) -> list[Tree]:
    """At least ``trees`` trees, and as many as the wanted recall takes; one leaf has every pair."""
    out, missed = [], 1.0
    while len(out) < trees or missed > 1 - recall:
        if len(out) == max(trees, MOST_TREES):
            return [grow(x[:0], 0, np.random.default_rng(0), least)]
        out.append(grow(x, total, np.random.default_rng([*seed, len(out)]), least))
        if len(out[-1].left) == 1:
            return [out[-1]]
        missed *= 1 - out[-1].recall
    return out


def _forest(classes: DataFrame, trees: int, seed: int, least: float, recall: float) -> dict:
    """Trees by (label, length), from a sample chosen by hash."""
    counts = {(r["label"], r["dim"]): r["n"] for r in classes.groupBy("label", "dim").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF).collect()}
    total = sum(counts.values())
    if not total:
        return {}
    width = max(dim for _, dim in counts)
    size = max(2 * NODE_SAMPLE, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    uniform = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    sample = classes.filter(uniform < size / total).select("label", "dim", "rep", "vector").toPandas().sort_values("rep")
    out = {}
    for (label, dim), own in sample.groupby(["label", "dim"]):
        if (label, dim) in counts:
            out[label, dim] = _trees(_unit(own["vector"]), counts[label, dim], least, recall, trees, [seed, int(dim)])
    return out


def _routed(classes: DataFrame, forest: dict) -> DataFrame:
    """One row per class, tree and leaf; ``seen`` holds its leaves in the trees before
    and its smaller-numbered leaves in this one, as tree << 32 | leaf."""
    shared = classes.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for df in batches:
            for (label, dim), own in df.groupby(["label", "dim"]):
                own = own.reset_index(drop=True)
                known = shared.value.get((label, dim))
                seen = [np.zeros(0, np.int64)] * len(own)
                x = _unit(own["vector"]) if known else None
                for t in range(len(known) if known else 1):  # a small label is one leaf
                    row, leaf = known[t].leaves(x) if known else (np.arange(len(own)), np.zeros(len(own), np.int64))
                    order = np.lexsort((leaf, row))
                    row, leaf = row[order], leaf[order]
                    edge = np.searchsorted(row, np.arange(len(own) + 1))
                    before = [len(s) for s in seen]
                    seen = [np.concatenate([s, t << 32 | leaf[a:z]]) for s, a, z in zip(seen, edge[:-1], edge[1:])]
                    out = own.iloc[row].copy()
                    out["tree"], out["leaf"] = t, leaf
                    out["seen"] = [seen[r][:before[r] + k - edge[r]] for k, r in enumerate(row)]
                    yield out[["label", "dim", "tree", "leaf", "rep", "n", "vector", "seen"]]

    kinds = dict(classes.dtypes)
    return classes.select("label", "dim", "rep", "n", "vector").mapInPandas(
        run, f"label {kinds['label']}, dim int, tree int, leaf bigint, rep bigint, n bigint, vector {kinds['vector']}, seen array<bigint>")


def _pairs(x: np.ndarray, side: np.ndarray, seen: list, within: bool, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of one group and whether no earlier leaf or tree has shown each."""
    width = max((len(s) for s in seen), default=0)
    marks = np.full((len(x), max(width, 1)), -1, np.int64)
    for k, s in enumerate(seen):
        marks[k, :len(s)] = s
    left = np.flatnonzero(side == 0)
    right = left if within else np.flatnonzero(side == 1)
    found = []
    for a in range(0, len(left), 256):
        i = left[a:a + 256]
        u, v = np.nonzero(x[i] @ x[right].T >= least)
        u, v = i[u], right[v]
        if within:
            u, v = u[u < v], v[u < v]
        for c in range(0, len(u), 1 << 16):
            p, q = u[c:c + (1 << 16)], v[c:c + (1 << 16)]
            fresh = np.ones(len(p), bool)
            for w in range(width):
                left_over = np.flatnonzero(fresh & (marks[p, w] >= 0))
                fresh[left_over] = ~(marks[q[left_over]] == marks[p[left_over], w][:, None]).any(1)
            found.append((p, q, fresh))
    if not found:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, bool)
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _compared(routed: DataFrame, least: float) -> DataFrame:
    """(rep, links, root): per class and leaf, its links first seen there and the smallest class linked with it there."""
    leaf = ["label", "dim", "tree", "leaf"]
    sizes = routed.groupBy(*leaf).agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK)
    sizes = sizes.select(*[F.col(c).alias(f"_{c}") for c in leaf], F.ceil(F.col("_n") / (BLOCK // 2)).alias("_blocks"))
    # few rows (one for each leaf beyond the bound), joined by a shuffle or as Spark finds them small
    cut = routed.join(sizes, (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")) & (F.col("tree") == F.col("_tree")) & (F.col("leaf") == F.col("_leaf")), "left")
    blocks = F.coalesce("_blocks", F.lit(1))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cut = cut.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        within = bool(df["first"].iat[0] == df["second"].iat[0])
        side = (df["block"] != df["first"]).to_numpy().astype(int)
        rep, n = df["rep"].to_numpy(), df["n"].to_numpy()
        i, j, fresh = _pairs(_unit(df["vector"]), side, df["seen"].tolist(), within, least)
        links = np.zeros(len(df), np.int64)
        np.add.at(links, i[fresh], n[j[fresh]])
        np.add.at(links, j[fresh], n[i[fresh]])
        root = rep.copy()
        while len(i):
            low = np.minimum(root[i], root[j])
            if (low == root[i]).all() and (low == root[j]).all():
                break
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
        some = np.zeros(len(df), bool)
        some[i] = some[j] = True
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": root[some]})

    picked = cut.select(*leaf, "first", "second", "block", "rep", "n", "vector", "seen")
    return picked.groupBy(*leaf, "first", "second").applyInPandas(run, "rep bigint, links bigint, root bigint")


def near_duplicates(vectors: DataFrame, least: float = 0.93, recall: float = RECALL, trees: int = 1, seed: int = 1,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per vector: id, n_links (other vectors found with cosine >= ``least``), component_id (smallest id
    reachable by links) and kept (whether that is its own). The number of trees follows from ``recall``; ``trees`` is the least."""
    base = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    fits = usable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    keyed = base.filter(fits).withColumn("dim", F.size("vector")) \
        .withColumn("k1", F.xxhash64("label", "vector", F.lit(1))).withColumn("k2", F.xxhash64(F.lit(2), "vector", "label"))
    classes = staged(keyed.groupBy("k1", "k2").agg(F.min("id").cast("bigint").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"),
                                                   F.first("dim").alias("dim"), F.first("vector").alias("vector")), "vector-classes")
    found = staged(_compared(staged(_routed(classes, _forest(classes, trees, seed, least, recall)), "vector-leaves"), least), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.filter("rep <> root"), "rep", "root").withColumnRenamed("node", "rep")
    known = classes.select("k1", "k2", "rep", "n").join(counts, "rep", "left").join(groups, "rep", "left") \
        .select("k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = keyed.select("id", "k1", "k2").join(known, ["k1", "k2"]).select("id", "n_links", "component_id")
    alone = base.filter(~fits).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").cast("bigint").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))
