"""Equal rows are packed once; forests on binned rows draw, weigh and split as on single rows."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from stayframe.operators import blocks as B
from stayframe.operators import boosting as BT
from stayframe.operators import encode as EN
from stayframe.operators import forest as FO
from stayframe.operators import linear as L
from stayframe.operators import model as M
from stayframe.operators import perceptron as P


def coarse(spark, n=900, seed=3):
    """Few combinations of values, whose labels are noisy."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = r.randrange(4), r.randrange(3)
        rows.append((float(a), float(b), float(r.choices([0, 1, 2], [1 + a, 1 + 2 * b, 2])[0]), i % 3))
    return EN.assemble(spark.createDataFrame(rows, "a double, b double, label double, fold int"), ["a", "b"]).checkpoint()


def test_equal_rows_are_packed_once_and_fits_are_the_same(spark):
    df = coarse(spark)
    _, parts = B.kfold_parts(df)
    plain, merged = B.pack(df, parts, batches=2, seed=5), B.pack(df, parts, batches=2, seed=5, merged=True)
    assert merged.table.agg(F.sum("n")).first()[0] == df.select("a", "b", "label", "fold").distinct().count()
    assert (merged.counts == plain.counts).all()
    assert B.summed(merged, lambda r: np.array([r.count.sum()]), 1)[0] == 900
    points = [L.Point("log", 1e-3), L.Point("hinge", 1e-2)]
    assert (L.search(plain, points) == L.search(merged, points)).all()
    trees = [BT.Point(0.3, 3, 0.1)]
    assert (BT.search(plain, trees, rounds=2) == BT.search(merged, trees, rounds=2)).all()
    nets = [(P.Point((5, 3), (0.2, 0.0)), f) for f in range(3)]
    for one, other in zip(*(P.train(d, nets, 2, 2, 5) for d in (plain, merged))):
        assert one == pytest.approx(other, abs=1e-9)


def test_estimators_read_merged_rows(spark, monkeypatch):
    df, seen, pack = coarse(spark), [], B.pack

    def watched(*a, **k):
        seen.append(pack(*a, **k))
        return seen[-1]

    monkeypatch.setattr(B, "pack", watched)
    for est in (M.logreg(1e-3), M.boosted_trees(max_iter=1), M.perceptron(2, [3], 1), M.AdaBoostForest(1, trees=2, depth=2)):
        est.fit(df)
    assert [d.table.agg(F.sum("n")).first()[0] for d in seen] == [df.select("a", "b", "label").distinct().count()] * 4


def test_compared_models_share_their_packed_rows(spark, monkeypatch):
    df, written, path = coarse(spark), [], B.stage_path
    monkeypatch.setattr(B, "stage_path", lambda s, name: written.append(name) or path(s, name))
    reg = {"a": M.Spec(lambda: M.logreg(1e-3)), "b": M.Spec(lambda: M.linear_svm(1e-3))}
    M.compare_table(spark, reg, {}, df, df)
    assert len(written) == 1


def test_draws_are_poisson_numbers():
    names = FO.names_of(np.arange(40_000, dtype=np.uint8)[:, None] % 250, np.arange(40_000))
    for n in (1, 7, 64, 65, 900):
        got = FO.draws(np.full(40_000, n), names, 42, 3)
        assert got.mean() == pytest.approx(n, abs=4 * np.sqrt(n / 40_000)) and got.var() == pytest.approx(n, rel=0.05)
        assert (got == FO.draws(np.full(40_000, n), names, 42, 3)).all() and (got != FO.draws(np.full(40_000, n), names, 42, 4)).any()


def test_splits_equal_a_direct_search():
    rng = np.random.default_rng(4)
    sums = rng.integers(0, 5, (2, FO.WIDTH, 3)).astype(float)
    sums[1] = sums[1] * sums[0].sum() / sums[1].sum()
    sums[1, 0] += sums[0].sum(0) - sums[1].sum(0)  # both features see the same rows

    def impurity(s):
        return s.sum() - (s ** 2).sum() / s.sum()

    want = min(((impurity(sums[f, :c].sum(0)) + impurity(sums[f, c:].sum(0)), f, c) for f in range(2) for c in range(1, FO.WIDTH)))
    assert FO.best_split(sums) == want[1:]


def test_forests_repeat_however_rows_lie_and_are_as_good_as_mllibs(spark):
    df, fitted = coarse(spark, 3000), []
    for d in (df, df.repartition(7)):
        data = B.pack(d, merged=True)
        cuts = BT.quantile_cuts(data)
        fitted.append(FO.train(BT.binned(data, cuts), 20, 4, 44, np.ones(3), (0, 1, 2)))
    assert str(fitted[0]) == str(fitted[1])
    right = M.score(FO.predicted(df, "features", cuts, lambda bins: FO.probabilities(fitted[0], bins).argmax(1).astype(float), "double", "prediction"))
    theirs = M.score(RandomForestClassifier(numTrees=20, maxDepth=4, seed=44).fit(df).transform(df))
    assert right > theirs - 0.03


@pytest.mark.parametrize("form", ["probability", "discrete"])
def test_boosted_forests_repeat_however_rows_lie(spark, form):
    df = coarse(spark)
    est = M.AdaBoostForest(rounds=3, trees=4, depth=3, form=form)
    one, other = (est.fit(d).transform(df).select("a", "b", "prediction").distinct() for d in (df, df.repartition(5)))
    assert sorted(one.collect()) == sorted(other.collect())


def test_row_weights_follow_the_probabilities(spark):
    """A round's weights, row by row, are those of the reference's rule."""
    df = coarse(spark)
    data = B.pack(df, merged=True)
    rows = BT.binned(data, BT.quantile_cuts(data))
    forest = FO.train(rows, 3, 2, 1, np.ones(3), (0, 1, 2))
    new, (total,) = FO.reweighted(rows, lambda r: (FO.probabilities(forest, r.x)[:, 0] + 1, (r.key * 2.0)[:, None]), 1)
    assert total == 2 * 900
    got = B.summed(new, lambda r: np.array([len(r.y), np.abs(r.weight - FO.probabilities(forest, r.x)[:, 0] - 1).max()]), 2)
    assert got[0] > 0 and got[1] == 0


def test_equal_leaves_are_merged():
    tree = BT.Tree([0, -1, 1, -1, -1], [1, 0, 1, 0, 0], [False] * 5, [1, -1, 3, -1, -1], [np.array(v) for v in ([6, 4], [0, 4], [6, 1], [4, 0], [2, 1])])
    FO._merge_equal_leaves(tree)
    assert tree.feature == [0, -1, -1, -1, -1]
