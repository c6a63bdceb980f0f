"""The searches over all models take every point of every grid; trees grown on cells are those of the passes."""

import datetime
import random

import numpy as np
import pytest

from stayframe import presets as PR
from stayframe.operators import blocks as B
from stayframe.operators import boosting as BT
from stayframe.operators import model as M
from stayframe.operators import split as SP
from stayframe.plans import registry_ml as R

GRIDS = {"linear_SVM": 11, "logreg": 11, "logreg_elasticnet": 28, "boosted_trees": 140, "perceptron_1hl": 16, "perceptron_2hl": 36, "boosted_trees_missing": 140}


@pytest.fixture
def lineitem(spark, tmp_path):
    r = random.Random(5)
    rows = [(i // 4, i % 4, i % 17, i % 5, float(r.randint(1, 50)), r.uniform(900, 90000), r.randint(0, 10) / 100, r.randint(0, 8) / 100, r.choice("ANR"),
             datetime.datetime(1995, 1, 1) + datetime.timedelta(days=i % 300)) for i in range(240)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, "
                                "l_tax double, l_returnflag string, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def _asked(monkeypatch, spark):
    """Records the registries that a query searches instead of searching them."""
    seen = []

    def points(spark, registry, hyper):
        seen.append(registry)
        return {}, M.grid_table(spark, "none", [])

    monkeypatch.setattr(R, "_all_points", points)
    monkeypatch.setattr(M, "compare_table", lambda spark, *a: spark.createDataFrame([], "model string, " + ", ".join(f"{m} double" for m in M.METRICS)))
    return seen


def _whole(seen):
    specs = {name: spec for registry in seen for name, spec in registry.items()}
    assert {name: len(spec.points()) for name, spec in specs.items()} == GRIDS
    assert all(specs[name].grid == {"step": PR.BOOST_RATES, "depth": PR.BOOST_DEPTHS, "mcw": PR.BOOST_MIN_CHILD_WEIGHTS} for name in ("boosted_trees", "boosted_trees_missing"))
    assert {spec.options["rounds"] for spec in specs.values() if "rounds" in spec.options} == {20}
    assert {spec.options["epochs"] for spec in specs.values() if "epochs" in spec.options} == {10}


def test_grid_search_takes_every_point(spark, lineitem, monkeypatch):
    seen = _asked(monkeypatch, spark)
    R.g01b_grid_search_all_noisy(spark, lineitem)
    _whole(seen)


def test_comparison_takes_every_point(spark, lineitem, monkeypatch):
    seen = _asked(monkeypatch, spark)
    R.g04b_generalisation_all_noisy(spark, lineitem)
    _whole(seen)


@pytest.mark.parametrize("missing", [False, True])
@pytest.mark.parametrize("balanced", [False, True])
def test_trees_on_cells_are_those_of_the_passes(spark, monkeypatch, missing, balanced):
    r = random.Random(7)
    rows = [(i, float(k), *[None if missing and r.random() < 0.3 else round(r.gauss(0.6 * (k == j), 1), 1) for j in range(3)])
            for i in range(500) for k in [r.choices([0, 1, 2, 7], [2, 5, 2, 1])[0]]]  # no class of the fits is 7
    df = SP.kfold(spark.createDataFrame(rows, "id long, label double, a double, b double, c double"), "label", ["id"], seed=44, k=3).checkpoint()
    data = B.pack(df, B.kfold_parts(df)[1], ["a", "b", "c"], merged=True)
    points = [BT.Point(0.3, 3, 0.1), BT.Point(3.0, 6, 3)]
    if not balanced:  # with balanced classes a tree without cuts scores all classes the same, up to rounding
        points.append(BT.Point(0.1, 0, 1))
    fit = lambda: BT.BoostedTrees(points[0], 3, balanced, ["a", "b", "c"]).fit(df).transform(df).orderBy("id").select("prediction").collect()
    counts, predicted = BT.search(data, points, 3, balanced), fit()
    monkeypatch.setattr(BT, "CELL_BYTES", 0)
    assert (BT.search(data, points, 3, balanced) == counts).all() and counts.sum() == len(points) * sum(k < 3 for _, k, *_ in rows)
    assert fit() == predicted


def test_many_nodes_split_as_one_by_one():
    rng = np.random.default_rng(3)
    g, h = rng.normal(size=(40, 3, BT.BINS + 1)), rng.uniform(0, 0.5, (40, 3, BT.BINS + 1))
    for f in (1, 2):  # the same rows in every feature
        g[:, f, 0] += (g[:, 0] - g[:, f]).sum(1)
    h[:20, :, -1] = g[:20, :, -1] = 0
    for part in (slice(0, 20), slice(20, 40)):
        split, feature, cut, left = BT.best_splits(g[part], h[part], 1.0)[:4]
        for i, (a, b) in enumerate(zip(g[part], h[part])):
            want = BT.best_split(np.stack([a, b], -1), 1.0)
            assert (want is not None) == split[i] and (want is None or want[1:] == (feature[i], cut[i], left[i]))


def test_both_tables_of_the_study_are_ranked_once(spark, lineitem, monkeypatch):
    ranked, rank = [], SP.strata_rank
    monkeypatch.setattr(SP, "strata_rank", lambda *a: ranked.append(a) or rank(*a))
    (_, dense), (_, kept) = R._study(spark, lineitem)
    assert len(ranked) == 1
    for got, want in ((dense, R._data(spark, lineitem)[0]), (kept, R._data(spark, lineitem, nulls=True)[0])):
        assert got.columns == want.columns
        flat = lambda df: sorted([[None if v is None else round(v, 9) if isinstance(v, float) else [round(x, 9) for x in v] if hasattr(v, "toArray") else v for v in r]
                                  for r in df.collect()], key=str)
        assert flat(got) == flat(want)


def test_models_share_trees_only_while_these_are_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 9, (1, 300, 3)).astype(float)
    held = BT.Cells(np.unique(rng.integers(0, 20, (900, 3)).astype(np.uint8), axis=0)[:300], counts, counts)
    points = [BT.Point(1.0, 4, w) for w in (3.0, 0.1, 60.0, 0.3)]
    grow, grown = BT._grow, []
    monkeypatch.setattr(BT, "_grow", lambda *a: grown.append(a) or grow(*a))
    together = BT.grown(held, points, 0, 4, np.ones(3))
    assert 3 * 4 * 2 <= len(grown) < 3 * 4 * 4
    for point, (trees, score) in zip(points, together):
        (alone, own), = BT.grown(held, [point], 0, 4, np.ones(3))
        assert alone == trees and (own == score).all()
