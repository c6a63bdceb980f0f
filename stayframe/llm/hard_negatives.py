"""Hard negatives by threshold joins with suffix-norm bounds (in the manner of L2AP).

Every component x becomes the integer floor(scale * x); a row's score for an anchor is their integer inner
product, higher first, ties by smaller id. An anchor's positives are its first ``n_positive`` other rows of
the same label. A positive's window holds the first ``n_negative`` rows of another label whose score lies
between ``low`` hundredths of the positive's score and that score itself, both included.

Two joins of anchors with rows above a threshold find them, ``_positives`` and ``_negatives``:

* *Thresholds fall until windows fill.* An anchor starts with a high threshold (a share of its own norm for
  positives; a share of the positive's score for negatives) and is searched again with the next lower one only
  while its window is not full; the last threshold admits every row that counts. So an answer is never cut short.
* *The index.* The dimensions are put in the order of the anchors' energy in them. For an anchor a and its
  threshold t, the trailing dimensions whose suffix norm |a'| keeps ``|a'| * max |x| < t`` are left out of the
  inverted index: no row can reach t by them alone. Anchors are ordered by how many dimensions they keep, so
  the posting list of a dimension is a leading part of the block of anchors.
* *Accumulation and pruning.* A step of rows adds up partial scores along the posting lists, some dimensions at a
  time. After each the remaining norms bound what is still to come, ``partial + |a'| * |x'| < t``, and rows that no
  anchor needs any more, and anchors that need no row any more, leave. What is left is scored exactly.
  The bounds are widened by more than their rounding, so they never refuse a row that counts.
* A task gives no more than its first ``n`` rows of an anchor and window, whatever ties or copies it holds (no row
  behind them can be among the first of all), and its own n-th score lifts the threshold for its later rows. So
  a frequent vector or label makes neither many rows nor a hot key.

Anchors are a fixed share of the rows and go out in blocks of bounded bytes (``BLOCK_BYTES``), one block at a time;
rows are read in place and never shuffled. Only found (anchor, row) pairs are, at most ``n`` an anchor and task.

Rows with a null id, label or vector or with a null or non-finite component take no part; vectors of
different lengths are compared as if the shorter one ended in zeros, so an empty one scores 0. Repeated
rows are rows of their own: an anchor skips itself once, not its copies. An empty table, or one without
anchors, gives no rows. Columns other than id, vector and label are not read. Scores that might
not fit 46 bits (components of about 2**20) raise an OverflowError.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._stage import released, staged
from ._vectors import finite_rows, scaled

#: Bytes of one block of anchors as doubles; partial scores of one step; dimensions added between two prunings.
BLOCK_BYTES, STEP_SCORES, DIMS = 16 << 20, 1 << 20, 8
#: Thresholds for positives as shares of the anchor's squared norm, and for negatives between the window's floor (0) and its top (1).
SHARES, FALLS = (0.8, 0.5, 0.2, None), (0.5, 0.0)
_FOUND = "anchor bigint, slot int, id bigint, score bigint, self boolean"


@dataclasses.dataclass
class Index:
    """A block of anchors, as many dimensions kept as their thresholds ask for (most first), in the order of energy."""

    anchors: np.ndarray
    thresholds: np.ndarray
    order: np.ndarray
    lists: np.ndarray
    suffix: np.ndarray
    row: np.ndarray


def suffix_norms(x: np.ndarray) -> np.ndarray:
    """|(x_d, x_d+1, ...)| for d = 0 .. dim of every row."""
    tail = np.cumsum((x * x)[:, ::-1], 1)[:, ::-1]
    return np.sqrt(np.concatenate([tail, np.zeros((len(x), 1))], 1))


def _above(bound: np.ndarray) -> np.ndarray:
    """A bound widened by more than its rounding errors."""
    return bound * (1 + 1e-9) + 1e-3


def index(anchors: np.ndarray, thresholds: np.ndarray, order: np.ndarray, most: float) -> Index:
    """The inverted index for rows of norm ``most`` at most. ``lists[d]`` anchors, the first ones, keep dimension d."""
    a = anchors[:, order]
    tail = suffix_norms(a)
    keep = (_above(tail[:, :-1] * most) >= thresholds[:, None]).sum(1)  # tails fall, so these are the leading dimensions
    rank = np.argsort(-keep, kind="stable")
    lists = (keep[rank][:, None] > np.arange(a.shape[1])).sum(0)
    return Index(a[rank], thresholds[rank], order, lists, tail[rank], rank)


def candidates(found: Index, x: np.ndarray, tail: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, exact score) of all pairs that reach the anchor's threshold, among rows ``x`` (in the index's order of dimensions)."""
    dim = x.shape[1]
    if not dim:  # vectors without components score 0
        u, v = np.nonzero(np.broadcast_to(thresholds <= 0, (len(x), len(thresholds))))
        return u, v, np.zeros(len(u))
    rows, live, d, out = np.arange(len(x)), np.arange(found.lists[0]), 0, []
    part = np.zeros((len(rows), len(live)))

    def finish(fits: np.ndarray, number: np.ndarray) -> None:
        """The pairs of these live anchors that the bound admits, scored exactly."""
        u, v = np.nonzero(fits)
        for k in range(0, len(u), 1 << 15):
            r, a = rows[u[k:k + (1 << 15)]], live[number[v[k:k + (1 << 15)]]]
            score = part[u[k:k + (1 << 15)], number[v[k:k + (1 << 15)]]] + (x[r, d:] * found.anchors[a, d:]).sum(1)
            ok = score >= thresholds[a]
            out.append((r[ok], a[ok], score[ok]))

    while len(rows) and len(live):
        end = min(d + DIMS, dim)
        part += x[rows, d:end] @ found.anchors[live, d:end].T
        d = end
        fits = _above(part + tail[rows, d][:, None] * found.suffix[live, d][None, :]) >= thresholds[live]
        # anchors that are in no further posting list are done, and all are once few pairs are left
        ends = live >= found.lists[d] if d < dim and fits.mean() > 0.05 else np.ones(len(live), bool)
        number = np.flatnonzero(ends)
        finish(fits[:, number], number)
        row_on, live_on = fits[:, ~ends].any(1), fits.any(0) & ~ends
        part, rows, live = part[np.ix_(row_on, live_on)], rows[row_on], live[live_on]
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in range(3))


def _matrix(column: pa.Array, scale: int, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, integer vectors as doubles, shorter ones filled up with zeros) of an Arrow column."""
    row, values, at = finite_rows(column)
    size = np.diff(at)
    width = int(size.max(initial=0)) if dim is None else dim
    out = np.zeros((len(row), width))
    place = np.arange(len(values)) - np.repeat(at[:-1], size)
    inside = place < width  # further components meet only the anchors' zeros
    whole = scaled(values, scale, 64)
    if whole.dtype == object or (len(whole) and float(np.abs(whole).max()) ** 2 * max(width, 1) >= 2.0 ** 46):
        raise OverflowError("scores would not fit 46 bits")
    out[np.repeat(np.arange(len(row)), size)[inside], place[inside]] = whole[inside]
    return row, out


def _first(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by (score, smaller id) of every (anchor, slot), an anchor's own row apart."""
    order = np.lexsort((ident, -score, own, slot, anchor))
    new = np.ones(len(order), bool)
    same = (np.diff(anchor[order]) == 0) & (np.diff(slot[order]) == 0) & (own[order][1:] == own[order][:-1])
    new[1:] = ~same
    start = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < n]


def _search(rows: DataFrame, block: dict, n: int, scale: int, positive: bool) -> DataFrame:
    """Per task, the first n rows of every anchor (and window) of a block that reach its threshold."""
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        anchors, tops, base = b["vector"], b["tops"], b["threshold"].copy()
        best: list[np.ndarray] | None = None  # columns anchor, slot, id, score, self
        for batch in batches:
            row, x = _matrix(batch.column(2), scale, anchors.shape[1])
            if not len(row) or not len(anchors):
                continue
            ident = batch.column(0).to_numpy(zero_copy_only=False)[row].astype(np.int64)
            label = batch.column(1).to_numpy(zero_copy_only=False)[row]
            own = index(anchors, base, b["order"], float(np.sqrt((x * x).sum(1).max())))
            x = x[:, b["order"]]
            tail = suffix_norms(x)
            step = max(1, STEP_SCORES // len(anchors))
            for at in range(0, len(x), step):
                # the task's own n-th scores may have lifted thresholds since the index was laid: it then only keeps too much
                r, a, score = candidates(own, x[at:at + step], tail[at:at + step], base[own.row])
                r, a = r + at, own.row[a]
                fits = (label[r] == b["label"][a]) == positive
                r, a, score = r[fits], a[fits], score[fits]
                if positive:
                    itself = ident[r] == b["id"][a]
                    near = np.flatnonzero(itself)
                    itself[near] = (x[r[near]] == anchors[a[near]][:, b["order"]]).all(1)
                    new = [a, np.zeros(len(a), np.int64), ident[r], score, itself]
                else:
                    pair, slot = np.nonzero((score[:, None] <= tops[a]) & (100 * score[:, None] >= b["low"] * tops[a]))
                    r, a, score = r[pair], a[pair], score[pair]
                    new = [a, slot, ident[r], score, np.zeros(len(a), bool)]
                if not len(a):
                    continue
                best = new if best is None else [np.concatenate([p, q]) for p, q in zip(best, new)]
                keep = _first(best[0], best[1], best[3], best[2], best[4], n)
                best = [c[keep] for c in best]
                if positive:
                    other = ~best[4]
                    full = np.bincount(best[0][other], minlength=len(base)) >= n
                    worst = np.full(len(base), np.inf)
                    np.minimum.at(worst, best[0][other], best[3][other])
                    base = np.where(full, np.maximum(base, worst), base)
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(b["anchor"][best[0]]), pa.array(best[1].astype(np.int32)), pa.array(best[2]),
                                              pa.array(best[3].astype(np.int64)), pa.array(best[4])], names=["anchor", "slot", "id", "score", "self"])

    out = staged(rows.mapInArrow(released(run), _FOUND), "negatives-found")
    shared.destroy()
    return out


def _blocks(anchors: DataFrame, scale: int) -> Iterator[dict]:
    """The anchors in blocks of bounded bytes, one at a time."""
    rows, size = [], 0
    for r in anchors.toLocalIterator():
        rows.append(r)
        size += 8 * (len(r["vector"]) + 16)
        if size >= BLOCK_BYTES:
            yield _block(rows, scale)
            rows, size = [], 0
    if rows:
        yield _block(rows, scale)


def _block(rows: list, scale: int) -> dict:
    _, x = _matrix(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), scale)
    tops = [r["tops"] for r in rows] if "tops" in rows[0] else [[] for _ in rows]
    wide = max(map(len, tops))
    return {"anchor": np.array([r["anchor"] for r in rows], np.int64), "id": np.array([r["id"] for r in rows], np.int64), "label": np.array([r["label"] for r in rows]),
            "vector": x, "order": np.argsort(-(x * x).sum(0), kind="stable"), "tops": np.array([t + [-np.inf] * (wide - len(t)) for t in tops], np.float64).reshape(len(rows), wide)}


def _merged(parts: list[DataFrame], n: int) -> DataFrame:
    """The first n of every (anchor, slot) over all tasks; an anchor's own row is left out once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    mine = Window.partitionBy("anchor", "slot", "self").orderBy("score", "id")
    out = out.withColumn("_copy", F.row_number().over(mine)).filter(~(F.col("self") & (F.col("_copy") == 1)))
    first = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n).select("anchor", "slot", "rank", "id", "score")


def _rounds(rows: DataFrame, anchors: DataFrame, levels: tuple, n: int, scale: int, threshold, **more) -> DataFrame:
    """The first n rows of every anchor's windows: searched with falling thresholds, each time only for those not yet full."""
    open_, done = anchors, []
    for number, level in enumerate(levels):
        parts = []
        for block in _blocks(open_, scale):
            block["threshold"] = threshold(block, level)
            parts.append(_search(rows, block | more, n, scale, "tops" not in open_.columns))
        if not parts:
            break
        found = staged(_merged(parts, n), "negatives-merged")
        if number == len(levels) - 1:
            done.append(found)
            break
        full = found.groupBy("anchor", "slot").agg(F.max("rank").alias("rank")).filter(F.col("rank") == n).groupBy("anchor").agg(F.count("*").alias("full"))
        windows = F.size("tops") if "tops" in open_.columns else F.lit(1)
        known = open_.join(full, "anchor", "left").select(*open_.columns, (F.coalesce("full", F.lit(0)) >= windows).alias("_full"))
        known = staged(known, "negatives-open")
        done.append(found.join(known.filter("_full").select("anchor"), "anchor", "left_semi"))
        open_ = known.filter(~F.col("_full")).drop("_full")
    out = rows.sparkSession.createDataFrame([], "anchor bigint, slot int, rank int, id bigint, score bigint")
    for d in done:
        out = out.unionByName(d)
    return out


def mine(vectors: DataFrame, anchor: Column, label: Column, n_positive: int = 5, n_negative: int = 5, low: int = 80, scale: int = 256,
         id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    ``anchor`` says of a row whether it is one, ``label`` gives its label."""
    base = vectors.select(F.col(id_col).cast("bigint").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), anchor.alias("_anchor"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    base = base.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~bad)
    rows = base.select("id", "label", "vector")
    anchors = staged(base.filter("_anchor").drop("_anchor").withColumn("anchor", F.monotonically_increasing_id()), "negatives-anchors")
    kinds = dict(vectors.dtypes)

    def norms(block, share):
        size = (block["vector"] ** 2).sum(1)
        return np.full(len(size), -np.inf) if share is None else share * size

    positives = staged(_rounds(rows, anchors, SHARES, n_positive, scale, norms).drop("slot"), "negatives-positives")
    tops = positives.groupBy("anchor").agg(F.array_sort(F.collect_set("score")).alias("tops"))
    # no window lies below a negative score: low/100 of it is above it
    windows = staged(anchors.join(tops, "anchor").withColumn("tops", F.filter("tops", lambda t: t >= 0)).filter(F.size("tops") > 0), "negatives-windows")

    def floors(block, fall):
        least = np.where(np.isfinite(block["tops"]), block["tops"], np.inf).min(1)
        return np.floor(least * (low / 100 + fall * (1 - low / 100))) - (1 if fall == 0 else 0)

    if windows.isEmpty():
        return vectors.sparkSession.createDataFrame([], f"anchor_id {kinds[id_col]}, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    negatives = _rounds(rows, windows, FALLS, n_negative, scale, floors, low=low)
    named = windows.select("anchor", F.posexplode("tops").alias("slot", "positive_score"))
    negatives = negatives.join(named, ["anchor", "slot"]).select("anchor", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = positives.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = pairs.join(negatives, ["anchor", "positive_score"]).join(anchors.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
