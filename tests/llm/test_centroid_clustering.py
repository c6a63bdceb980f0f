"""Centroid clustering against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from stayframe.llm import centroid_clustering as CC

VEC = "vec_id bigint, embedding array<double>, label int, cluster string, distance string"


def brute(rows, k, rounds, dim, scale=256, salt="2"):
    kept = [(i, [math.floor(v) * scale + math.floor((v - math.floor(v)) * scale) for v in x]) for i, x in rows
            if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in first[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            group = [x for (_, x), o in zip(kept, own) if o == j]
            if group:
                centroids[j] = [sum(c) // len(group) for c in zip(*group)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=repr), centroids


def table(spark, rows):
    return spark.createDataFrame([(i, x, 1, "other", "column") for i, x in rows], VEC)


def found(spark, rows, k, rounds, dim):
    assigned, centroids = CC.cluster(table(spark, rows), k=k, rounds=rounds, dim=dim)
    return sorted(((r["id"], r["cluster"], r["distance"]) for r in assigned.collect()), key=repr), centroids


def rows_of(seed, n, dim, spread=1.0):
    r = random.Random(seed)
    return [(i, [round(r.gauss(0, spread), 2) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("k", [1, 2, 5, 8, 40])
def test_equals_brute_force(spark, k):
    rows = rows_of(k, 120, 6)
    assert found(spark, rows, k, 3, 6) == brute(rows, k, 3, 6)


def test_odd_rows_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    # a coarse grid: many vectors lie just between centroids; half of all rows are one vector
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(60)] + [(100 + i, [0.5, 0.5, 0.5]) for i in range(90)]
    rows += [(7, [0.0, 0.0, 0.0]), (7, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 0.0]), (300, None), (301, []), (302, [1.0, None, 0.0]),
             (303, [nan, 0.0, 0.0]), (304, [inf, 0.0, 0.0]), (305, [1.0, 2.0]), (306, [1.0] * 4), (307, [-0.001, -1e-9, 0.0])]
    assert found(spark, rows, 9, 4, 3) == brute(rows, 9, 4, 3)


def test_huge_components_stay_exact(spark):
    rows = [(i, [x * 2.0 ** e, 1.0]) for i, (x, e) in enumerate([(1.0, 20), (1.5, 21), (-1.25, 22), (1.0, 3), (0.1, 0), (1.0, 21)])]
    assert found(spark, rows, 3, 2, 2) == brute(rows, 3, 2, 2)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = rows_of(1, 3, 4)
    assert found(spark, rows, 40, 2, 4) == brute(rows, 40, 2, 4)
    assigned, centroids = CC.cluster(table(spark, [(1, None)]), k=4, rounds=2, dim=4)
    assert assigned.collect() == [] and centroids == []
    assert CC.digest(assigned, centroids).collect() == []


def test_digest(spark):
    rows = rows_of(3, 50, 4)
    want, centroids = brute(rows, 5, 2, 4)
    got = {r["vec_id"]: r for r in CC.digest(*CC.cluster(table(spark, rows), k=5, rounds=2, dim=4)).collect()}
    assert len(got) == 50
    for i, c, d in want:
        assert (got[i]["cluster"], got[i]["distance"]) == (c, d)
        assert got[i]["cluster_inertia"] == sum(x for _, o, x in want if o == c)
        assert got[i]["inertia"] == sum(x for _, _, x in want)
        assert got[i]["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()


@pytest.mark.parametrize("high", [3, 1 << 25, 1 << 40])
def test_tournament_in_every_number_type(high):
    r = np.random.default_rng(high % 97)
    kind = np.int64 if high < 1 << 27 else object
    x, c = r.integers(-high, high, (300, 5)).astype(kind), r.integers(-high, high, (13, 5)).astype(kind)
    far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
    own = CC.bisectors(c)
    number = own.nearest(x)
    assert number.tolist() == [min(range(13), key=lambda j: (d[j], j)) for d in far]
    assert own.distance(x, number).tolist() == [min(d) for d in far]
