"""Hard negatives against all pairs, and the candidate search against a matrix product."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayframe.llm import hard_negatives as HN

VEC = "vec_id bigint, embedding array<double>, label int, anchor string, score string"


def brute(rows, every, n_positive=5, n_negative=5, low=80):
    part = [(i, [math.floor(256 * v) for v in x], y) for i, x, y in rows
            if i is not None and y is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for k, (i, a, y) in enumerate(part):
        if i % every:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(a, x)), j, z) for m, (j, x, z) in enumerate(part) if m != k))
        for s, j, _ in [r for r in scored if r[2] == y][:n_positive]:
            inside = [(t, m) for t, m, z in scored if z != y and low * -s <= 100 * -t <= 100 * -s][:n_negative]
            out += [(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame([(i, x, y, "other", "column") for i, x, y in rows], VEC)
    got = HN.mine(df, anchor=F.col("vec_id") % every == 0, label=F.col("label"), **more)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def clustered(seed, n, dim, labels, noise):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(labels)]
    out = []
    for i in range(n):
        c = r.randrange(labels)
        out.append((i, [v + r.gauss(0, noise) for v in centers[c]], c if r.random() < 0.8 else (c + 1) % labels))
    return out


@pytest.mark.parametrize("seed,noise", [(1, 0.1), (2, 0.5), (3, 2.0)])
def test_equals_all_pairs(spark, seed, noise):
    rows = clustered(seed, 200, 12, 4, noise)
    want = brute(rows, 10)
    assert want and mined(spark, rows, 10) == want


def test_ties_copies_and_odd_rows(spark):
    nan = float("nan")
    r = random.Random(4)
    # few distinct vectors: everything ties; a third of the rows are one vector
    rows = [(i, [float(r.choice([0, 1])), float(r.choice([0, 1])), 1.0], r.choice([0, 1])) for i in range(60)] + [(100 + i, [1.0, 1.0, 1.0], i % 2) for i in range(30)]
    rows += [(20, [1.0, 1.0, 1.0], 0), (20, [1.0, 1.0, 1.0], 0), (20, [1.0, 0.0, 1.0], 1), (None, [1.0] * 3, 0), (200, None, 0), (210, [1.0, None, 1.0], 1),
             (220, [nan, 1.0, 1.0], 0), (230, [1.0, 1.0, 1.0], None), (240, [], 1), (250, [1.0, 1.0], 0), (260, [1.0, 1.0, 1.0, 9.0], 1), (-10, [0.5, 0.5, 0.5], 0)]
    want = brute(rows, 10)
    assert want and mined(spark, rows, 10) == want


def test_zero_and_negative_scores(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [-1.0, 0.0], 0), (3, [0.0, -1.0], 1), (4, [-1.0, 0.5], 1), (5, [0.0, 0.0], 1), (10, [0.0, 0.0], 1)]
    want = brute(rows, 5)
    assert want and mined(spark, rows, 5) == want


def test_other_sizes_of_windows(spark):
    rows = clustered(9, 150, 6, 3, 0.7)
    assert mined(spark, rows, 15, n_positive=2, n_negative=9, low=30) == brute(rows, 15, 2, 9, 30)


def test_none(spark):
    assert mined(spark, [(1, [1.0], 0)], 10) == []
    assert mined(spark, [(10, [1.0], 0)], 10) == []
    assert mined(spark, [(10, [1.0], 0), (11, [-1.0], 0), (12, [1.0], 1)], 10) == []
    with pytest.raises(Exception, match="46 bits"):
        mined(spark, [(10, [1e9], 0), (11, [1e9], 0)], 10)


@pytest.mark.parametrize("level", [-1.0, 0.0, 0.3, 0.7, 1.0, 3.0])
def test_candidates_are_all_that_reach_the_threshold(level):
    r = np.random.default_rng(7)
    dim = 21
    anchors = np.floor(r.normal(size=(40, dim)) * 50 * np.linspace(2, 0.1, dim))
    x = np.floor(np.concatenate([r.normal(size=(300, dim)) * 50, anchors[r.integers(0, 40, 60)] + r.normal(size=(60, dim)) * 5]))
    base = level * (anchors ** 2).sum(1) if level > -1 else np.full(40, -np.inf)
    order = np.argsort(-(anchors ** 2).sum(0), kind="stable")
    own = HN.index(anchors, base, order, float(np.sqrt((x * x).sum(1).max())))
    rows, a, score = HN.candidates(own, x[:, order], HN.suffix_norms(x[:, order]), base[own.row])
    exact = x @ anchors.T
    got = {(int(p), int(own.row[q])): s for p, q, s in zip(rows, a, score)}
    assert len(got) == len(rows)
    assert got == {(int(p), int(q)): exact[p, q] for p, q in zip(*np.nonzero(exact >= base))}
    if level == 0.7:  # the index leaves out trailing dimensions
        assert own.lists[-1] == 0 and own.lists[0] > 0
