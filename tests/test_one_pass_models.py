"""Many fits in one pass: equal to single fits, to independent computations in numpy, and to MLlib's optimum."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from stayframe.operators import blocks as B
from stayframe.operators import boosting as BT
from stayframe.operators import encode as EN
from stayframe.operators import linear as L
from stayframe.operators import perceptron as P
from stayframe.operators import split as SP


def noisy(spark, n=400, dim=3, seed=1, missing=False):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = r.choices([0, 1, 2], [1, 3, 1])[0]
        x = [r.gauss(0.8 * (k == j % 3), 1.0) for j in range(dim)]
        rows.append((i, float(k), *[None if missing and r.random() < 0.2 else v for v in x]))
    cols = [f"x{j}" for j in range(dim)]
    df = spark.createDataFrame(rows, "id long, label double, " + ", ".join(f"{c} double" for c in cols))
    df = SP.kfold(df, "label", ["id"], seed=44, k=3)
    return (df if missing else EN.assemble(df, cols)).checkpoint(), cols


def arrays(df, cols):
    rows = df.orderBy("id").collect()
    x = np.array([[math.nan if r[c] is None else r[c] for c in cols] for r in rows])
    return x, np.array([r["label"] for r in rows]), np.array([r["fold"] for r in rows])


# ---- packed blocks -------------------------------------------------------------

def test_sums_over_many_tasks(spark):
    df, _ = noisy(spark, 500)
    data = B.pack(df, [F.when(F.col("fold") == f, 2).otherwise(1) for f in range(3)])
    wide = B.Blocks(data.table.repartition(150), data.dim, data.folds, data.counts)  # more task sums than one step adds
    for d in (data, wide):
        got = B.summed(d, lambda rows: np.array([len(rows.y), rows.x.sum(), (rows.part == 1).sum()]), 3)
        assert got[0] == 500 and got[2] == 1000
        assert got[1] == pytest.approx(sum(sum(r["features"]) for r in df.collect()))
    assert data.counts.sum() == 1000


def test_hot_copies_are_spread(spark):
    df = spark.createDataFrame([(1.0, 0.0)] * 3000 + [(float(i), 1.0) for i in range(300)], "a double, label double").repartition(4)
    data = B.pack(df, features=["a"])
    sizes = [r["n"] for r in data.table.select("n").collect()]
    assert sum(sizes) == 3300 and max(sizes) < 1500
    assert data.counts.tolist() == [[3000, 300, 0]]


# ---- linear --------------------------------------------------------------------

def objective(w, x, y, weight, loss, reg, l1):
    m = y * (x @ w[:-1] + w[-1])
    if loss == "log":
        v = np.logaddexp(0, -m)
    else:
        gap = np.maximum(1 - m, 0)
        v = np.where(gap < L.CORNER, gap * gap / (2 * L.CORNER), gap - L.CORNER / 2)
    return (weight * v).sum() / weight.sum() + reg * ((1 - l1) / 2 * (w[:-1] ** 2).sum() + l1 * np.abs(w[:-1]).sum())


@pytest.mark.parametrize("point", [L.Point("log", 1e-3), L.Point("log", 1e-2, 0.6), L.Point("log", 0.2, 1.0), L.Point("hinge", 1e-2)])
def test_linear_fit_is_the_optimum(spark, point):
    """No step along any axis, nor a random one, lowers the objective."""
    df, cols = noisy(spark)
    model = L.LinearOvr(point).fit(df)
    x, y, _ = arrays(df, cols)
    r = np.random.default_rng(2)
    for k in range(3):
        w, sign = model.coefficients[:, k], np.where(y == k, 1.0, -1.0)
        weight = np.where(y == k, len(y) / (2 * (y == k).sum()), len(y) / (2 * (y != k).sum()))
        best = objective(w, x, sign, weight, point.loss, point.reg, point.l1)
        steps = [s * e for e in np.eye(4) for s in (1e-2, -1e-2, 1e-3, -1e-3)] + [1e-2 * v for v in r.normal(size=(40, 4))]
        assert min(objective(w + s, x, sign, weight, point.loss, point.reg, point.l1) for s in steps) > best - 1e-9
    if point.l1 == 1.0:
        assert (model.coefficients[:-1] == 0).any()  # exact zeros


@pytest.mark.parametrize("reg,l1", [(1e-2, 0.0), (1e-2, 0.5)])
def test_logistic_equals_mllib(spark, reg, l1):
    df, cols = noisy(spark)
    mine = L.LinearOvr(L.Point("log", reg, l1)).fit(df).coefficients[:, 0]
    n, own = df.count(), df.where("label = 0").count()
    d = df.select("features", (F.col("label") == 0).cast("double").alias("y"), F.when(F.col("label") == 0, n / (2 * own)).otherwise(n / (2 * (n - own))).alias("w"))
    other = LogisticRegression(regParam=reg, elasticNetParam=l1, maxIter=300, tol=1e-12, standardization=False, labelCol="y", weightCol="w").fit(d)
    assert mine[:-1] == pytest.approx(other.coefficients.toArray(), abs=2e-4)
    assert mine[-1] == pytest.approx(other.intercept, abs=2e-4)


def test_linear_search_equals_single_fits(spark):
    df, cols = noisy(spark)
    points = [L.Point("hinge", 1e-3), L.Point("log", 1e-4), L.Point("log", 1e-2, 0.3), L.Point("log", 1.0)]
    _, parts = B.kfold_parts(df)
    counts = L.search(B.pack(df, parts), points)
    for p, point in enumerate(points):
        for fold in range(3):
            out = L.LinearOvr(point).fit(df.where(F.col("fold") != fold)).transform(df.where(F.col("fold") == fold))
            want = np.zeros((3, 3), int)
            for r in out.collect():
                want[int(r["label"]), int(r["prediction"])] += 1
            # a row on the border may fall to either side
            assert np.abs(counts[p, fold] - want).sum() <= 2


def test_linear_fits_take_few_passes_and_agree_with_first_order_steps(spark, monkeypatch):
    """Also where the classes can be told apart and the penalty is weak, where first-order steps take some hundred passes."""
    rows = [(i, float(i % 3), float(i % 3 == 0), float(i % 3 == 1), float(i % 7)) for i in range(300)]
    apart = EN.assemble(spark.createDataFrame(rows, "id long, label double, a double, b double, c double"), ["a", "b", "c"])
    passes, summed = [], B.summed
    monkeypatch.setattr(B, "summed", lambda *a, **b: passes.append(1) or summed(*a, **b))
    for df in (apart, noisy(spark)[0]):
        data, points = B.pack(df), [L.Point("log", 1e-6), L.Point("hinge", 1e-4), L.Point("log", 1e-3, 0.6), L.Point("log", 0.2, 1.0)]
        columns = L.Columns.of(points, [0], L.CLASSES)
        passes.clear()
        newton = L.solve(data, columns)
        assert len(passes) <= 40
        with monkeypatch.context() as m:
            m.setattr(L, "SECOND", 0)
            plain = L.solve(data, columns, max_iter=1000)
        penalty = np.concatenate([np.tile(columns.l1, (data.dim, 1)), np.zeros((1, len(columns.cls)))])
        of = lambda w: L._evaluated(data, columns, L.CLASSES, w)[0] + (penalty * np.abs(w)).sum(0)
        assert (of(newton) <= of(plain) + 1e-7).all()


def test_class_absent_or_alone(spark):
    df, _ = noisy(spark)
    two = df.where("label <> 2")
    assert {r["prediction"] for r in L.LinearOvr(L.Point()).fit(two).transform(df).collect()} <= {0.0, 1.0}
    one = df.where("label = 1")
    assert {r["prediction"] for r in L.LinearOvr(L.Point()).fit(one).transform(df).collect()} == {1.0}


# ---- perceptrons ---------------------------------------------------------------

def numpy_network(x, y, key, batch, point, weights, epochs, batches, seed):
    """One network by plain loops over rows."""
    rng = np.random.default_rng(seed)
    value = P.first_weights(point, x.shape[1], 3, seed)
    squares, moves = np.zeros_like(value), np.zeros_like(value)
    for epoch in range(epochs):
        for b in rng.permutation(batches):
            grad, total = np.zeros_like(value), 0.0
            for i in np.flatnonzero(batch == b):
                layers = P.layers(value, P.shapes(point, x.shape[1], 3))
                acts, masks = [x[i]], []
                for n, w in enumerate(layers):
                    z = acts[-1] @ w[:-1] + w[-1]
                    if n < len(layers) - 1:
                        z = np.maximum(z, 0)
                        m = np.ones(len(z))
                        if point.dropout[n]:
                            m = (P.uniforms(key[i:i + 1], epoch, n, len(z), seed)[0] >= point.dropout[n]) / (1 - point.dropout[n])
                        masks.append(m)
                        z = z * m
                    acts.append(z)
                p = np.exp(acts[-1] - acts[-1].max())
                p /= p.sum()
                wt = weights[int(y[i])]
                total += wt
                delta, grads = (p - np.eye(3)[int(y[i])]) * wt, []
                for n in reversed(range(len(layers))):
                    grads.append(np.concatenate([np.outer(acts[n], delta), delta[None]]).ravel())
                    if n:
                        delta = (layers[n][:-1] @ delta) * (acts[n] > 0) * masks[n - 1]
                grad += np.concatenate(grads[::-1])
            if total:
                g = grad / total
                squares = P.DECAY * squares + (1 - P.DECAY) * g * g
                move = -g * np.sqrt(moves + P.EPSILON) / np.sqrt(squares + P.EPSILON)
                moves = P.DECAY * moves + (1 - P.DECAY) * move * move
                value = value + move
    return value


@pytest.mark.parametrize("point", [P.Point((4,), (0.3,)), P.Point((5, 3), (0.2, 0.5)), P.Point((4,), (0.0,))])
def test_network_equals_numpy(spark, point):
    df, cols = noisy(spark, 120)
    data = B.pack(df, batches=3, seed=9)
    value, = P.train(data, [(point, 0)], epochs=3, batches=3, seed=9, balanced=True)
    x, y, key, batch = [], [], [], []
    for r in data.table.collect():
        x.append(np.frombuffer(r["x"]).reshape(r["n"], -1))
        y.append(np.frombuffer(r["y"]))
        key.append(np.frombuffer(r["key"], np.int64))
        batch += [r["batch"]] * r["n"]
    x, y, key = np.concatenate(x), np.concatenate(y), np.concatenate(key)
    weights = [len(y) / (3 * (y == k).sum()) for k in range(3)]
    want = numpy_network(x, y, key, np.array(batch), point, weights, 3, 3, 9)
    assert value == pytest.approx(want, abs=1e-9)


def test_networks_repeat_and_do_not_touch_each_other(spark):
    df, _ = noisy(spark, 150)
    names, parts = B.kfold_parts(df)
    points = [P.Point((6,), (0.1,)), P.Point((4, 3), (0.2, 0.0))]
    first = P.search(df, parts, points, epochs=2, batches=2, seed=3)
    assert (first == P.search(df, parts, points, epochs=2, batches=2, seed=3)).all()
    alone = P.search(df, parts, points[1:], epochs=2, batches=2, seed=3)
    assert (first[1] == alone[0]).all()
    assert first.sum((1, 2, 3)).tolist() == [150, 150]


def test_dropout_rate_of_masks():
    u = P.uniforms(np.arange(20_000, dtype=np.int64) * 7919, 3, 1, 5, 42)
    assert abs((u < 0.3).mean() - 0.3) < 0.01 and np.abs(np.corrcoef(u.T) - np.eye(5)).max() < 0.05


def test_perceptron_learns(spark):
    r = random.Random(3)
    rows = [(i, float(i % 3), (i % 3) * 4.0 + r.random(), -(i % 3) * 3.0 + r.random()) for i in range(600)]
    df = EN.assemble(EN.standardize(spark.createDataFrame(rows, "id long, label double, a double, b double"), ["a", "b"]), ["a", "b"]).checkpoint()
    for point in (P.Point((10,), (0.1,)), P.Point((10, 10), (0.0, 0.2))):
        out = P.Perceptron(point, epochs=30, batches=4).fit(df).transform(df)
        assert out.where("prediction = label").count() > 560


# ---- boosted trees ---------------------------------------------------------------

def brute_trees(x, y, point, rounds, edges):
    """Softmax boosting by direct search over all cuts of all rows; returns the rows' scores."""
    n, dim = x.shape
    score = np.zeros((n, 3))

    def grow(rows, g, h, depth, out):
        out[rows] = -point.rate * g[rows].sum() / (h[rows].sum() + BT.RIDGE)
        if depth == 0:
            return
        best = None
        G, H = g[rows].sum(), h[rows].sum()
        for f in range(dim):
            v = x[rows, f]
            for cut in edges[f]:
                for missing_left in (True, False):
                    left = np.where(np.isnan(v), missing_left, v <= cut)
                    gl, hl = g[rows][left].sum(), h[rows][left].sum()
                    if hl < point.min_child_weight or H - hl < point.min_child_weight:
                        continue
                    gain = gl ** 2 / (hl + BT.RIDGE) + (G - gl) ** 2 / (H - hl + BT.RIDGE) - G ** 2 / (H + BT.RIDGE)
                    if gain > 1e-9 and (best is None or gain > best[0] * (1 + 1e-9)):
                        best = gain, left
        if best:
            grow(rows[best[1]], g, h, depth - 1, out)
            grow(rows[~best[1]], g, h, depth - 1, out)

    for _ in range(rounds):
        p = BT.softmax(score)
        step = np.zeros((n, 3))
        for c in range(3):
            grow(np.arange(n), p[:, c] - (y == c), np.maximum(2 * p[:, c] * (1 - p[:, c]), 1e-16), point.depth, step[:, c])
        score = score + step
    return score


@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("point", [BT.Point(0.3, 3, 0.1), BT.Point(3.0, 2, 3.0), BT.Point(1.0, 5, 0.3)])
def test_trees_equal_direct_search(spark, point, missing):
    df, cols = noisy(spark, 150, missing=missing)
    model = BT.BoostedTrees(point, rounds=3, features=cols).fit(df)
    x, y, _ = arrays(df, cols)
    for f in range(len(cols)):  # exact quantiles
        v = np.sort(x[~np.isnan(x[:, f]), f])
        want = np.unique([v[max(math.ceil(s * len(v) / BT.BINS), 1) - 1] for s in range(1, BT.BINS)])
        assert model.cuts.edges[f].tolist() == want.tolist()
    want = brute_trees(x, y, point, 3, model.cuts.edges)
    got = BT.scores(model.trees, model.cuts.bins(x), 3)
    assert got == pytest.approx(want, abs=1e-9)
    out = model.transform(df).orderBy("id").collect()
    assert [r["prediction"] for r in out] == got.argmax(1).tolist()


def test_missingness_alone_tells_the_class(spark):
    r = random.Random(8)
    rows = [(i, float(i % 3), None if i % 3 == 1 else r.random(), None if i % 3 == 2 else r.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, label double, a double, b double")
    out = BT.BoostedTrees(BT.Point(0.5, 2, 0.1), rounds=4, features=["a", "b"]).fit(df).transform(df)
    assert out.where("prediction <> label").count() == 0


def test_tree_search_equals_single_fits_and_bounds_its_passes(spark, monkeypatch):
    df, cols = noisy(spark, 200)
    points = [BT.Point(0.3, 3, 0.1), BT.Point(1.0, 4, 1)]
    _, parts = B.kfold_parts(df)
    data = B.pack(df, parts)
    counts = BT.search(data, points, rounds=2)
    monkeypatch.setattr(BT, "PASS_BYTES", 5 * 8 * 3 * (BT.BINS + 1) * 2)  # five nodes a pass
    monkeypatch.setattr(BT, "HELD_BYTES", 1)  # one model at a time
    assert (BT.search(data, points, rounds=2) == counts).all()
    assert counts.sum((1, 2, 3)).tolist() == [200, 200]


def test_quantile_cuts_of_few_negative_and_equal_values(spark):
    df = spark.createDataFrame([(float(i % 3), -1.5 if i % 2 else 0.0, -0.0 if i % 5 else 1e300, None) for i in range(60)], "label double, a double, b double, c double")
    cuts = BT.quantile_cuts(B.pack(df, features=["a", "b", "c"]))
    assert [e.tolist() for e in cuts.edges] == [[-1.5, 0.0], [0.0, 1e300], []]


def test_equal_binned_rows_are_added_up(spark):
    """The passes read combinations of bins, however many rows there are."""
    rows = [(float(i % 3), float(i % 4), float(i % 5) if i % 6 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "label double, a double, b double").repartition(4)
    data = B.pack(df, [F.lit(1), F.when(F.col("a") > 1, 2).otherwise(1)], features=["a", "b"])
    cuts = BT.quantile_cuts(data)
    once = BT.binned(data, cuts)
    got = B.summed(once, lambda r: np.array([len(r.y), r.key.sum(), (r.key * (r.y == 1) * (r.part[:, 1] == 2)).sum()]), 3)
    assert got.tolist() == [len(set(rows)), 6000, sum(y == 1 and a > 1 for y, a, _ in rows)]
