"""Missing labels and keys, NaN and infinities, open-ended intervals, values a model cannot take."""

import math

import numpy as np
import pytest
from pyspark.sql import Observation

from stayframe.operators import asof as A
from stayframe.operators import clean as CL
from stayframe.operators import cohort as C
from stayframe.operators import encode as EN
from stayframe.operators import model as M
from stayframe.operators import offsets as O
from stayframe.operators import profile as PR
from stayframe.operators import split as SP

INF, NAN = float("inf"), float("nan")


def test_splits_keep_rows_without_a_label(spark):
    df = spark.createDataFrame([(i, [0, 1, 2, None][i % 4]) for i in range(400)], "k long, label int")
    split = SP.stratified_split(df, "label", ["k"])
    assert sorted(map(tuple, split.groupBy("label", "split").count().collect()), key=str) == sorted(
        [(x, s, n) for x in (0, 1, 2, None) for s, n in (("hyperopt", 80), ("compare", 10), ("test", 10))], key=str)
    assert SP.shuffle_folds(df, "label", ["k"]).count() == 1200
    assert sorted(r["count"] for r in SP.kfold(df, "label", ["k"]).groupBy("label", "fold").count().collect()) == [33] * 8 + [34] * 4


@pytest.mark.parametrize("values", [
    [1.0, INF, 2.0, 3.0], [-INF, INF, 0.0], [INF] * 5, [1e308, -1e308, 0.0, 5.0], [1e-300, 1.0, 1e300, 2.0, 1e-8], [-1e-300, -5.0, -1e200],
    [NAN, 4.0, NAN, 1.0], [0.0, 0.0, 1.0, -0.0], [5e-324, 1e-323, 1.5e-323], list(np.random.default_rng(1).normal(size=3000) * 10.0 ** np.random.default_rng(2).integers(-9, 9, 3000))])
@pytest.mark.parametrize("q", [0.5, 0.25])
def test_exact_quantiles_of_any_doubles(spark, values, q):
    df = spark.createDataFrame([(float(v), 1.0) for v in values] + [(None, 1.0)], "x double, one double")
    got = PR.exact_quantiles(df, ["x", "one"], q)
    own = sorted(v for v in values if not math.isnan(v))
    at = (len(own) - 1) * q
    a, b = own[math.floor(at)], own[math.ceil(at)]
    want = a if a == b else None if a == -INF else a + (at - math.floor(at)) * (b - a)
    assert got["x"] == want or math.isclose(got["x"], want, rel_tol=1e-12) and got["one"] == 1.0


def test_profile_and_histogram_skip_nan(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)] + [(NAN,)], "x double")
    row = PR.profile(df).first()
    assert (row["mean"], row["max"], row["median"]) == (49.5, 99.0, 49.5) and round(row["missing_pct"], 6) == round(100 / 101, 6)
    assert [r["count"] for r in PR.histogram(df, "x", 5).collect()] == [20] * 5
    infinite = df.union(spark.createDataFrame([(INF,), (-INF,), (INF,)], "x double"))
    assert [r["count"] for r in PR.histogram(infinite, "x", 5).collect()] == [21, 20, 20, 20, 22]
    assert PR.numeric_summary(df, ["x"]).first()["max"] == 99.0


def test_asof_never_matches_null_keys(spark):
    ev = spark.createDataFrame([(None, 1, "2024-01-01 00:00:00", 5.0), (1, 2, "2024-01-01 00:00:00", 6.0)], "s long, e long, t string, v double") \
        .selectExpr("s", "e", "cast(t AS timestamp_ntz) AS t", "v", "'i' AS item")
    an = spark.createDataFrame([(None, 1), (1, 2)], "s long, a long").selectExpr("s", "a", "timestamp_ntz'2024-01-02 00:00:00' AS at")
    for hot in (2_000_000, 1):
        out = A.asof_latest(an, ev, key=["s"], anchor_id=["a"], anchor_time="at", event_time="t", value_col="v", item_col="item", tiebreak="e", hot_rows=hot)
        assert sorted((r.a, r.value) for r in out.collect()) == [(1, None), (2, 6.0)]


def test_open_ended_interval_is_not_repeated_for_ever(spark):
    stays = spark.createDataFrame([(1, 10, "2024-01-01", "9999-12-31"), (2, 20, "0001-01-01", "9999-12-31"), (3, 30, "2024-01-01", "9999-12-31")], "k long, s long, a string, z string") \
        .selectExpr("k", "s", "cast(a AS timestamp_ntz) AS a", "cast(z AS timestamp_ntz) AS z")
    points = spark.createDataFrame([(1, 1, "2024-01-05 10:00:00"), (2, 2, "2024-03-05 10:00:00"), (3, 1, "2023-12-31 23:00:00")], "p long, k long, t string") \
        .selectExpr("p", "k", "cast(t AS timestamp_ntz) AS t")
    out = C.interval_join(points, stays, "k", "t", "a", "z")
    assert sorted((r.p, r.s) for r in out.collect()) == [(1, 10), (2, 20)]
    assert C.interval_join(points, stays, "k", "t", "a", "z", how="left").count() == 3
    with pytest.raises(ValueError):
        C.interval_join(points, stays, "k", "t", "a", "z", how="right")


def test_range_max_skips_nan(spark):
    df = spark.createDataFrame([(1, 1, "2024-01-01 01:00:00", 5.0), (2, 1, "2024-01-02 02:00:00", NAN), (3, 1, "2024-01-02 03:00:00", 7.0)], "i long, s long, t string, v double") \
        .selectExpr("i", "s", "cast(t AS timestamp_ntz) AS t", "v")
    out = O.range_max(df, ["s"], "t", "v", ["i"], O.DAY_FRAMES)
    assert {r.i: r.tomorrow for r in out.collect()}[1] == 7.0


def test_inclusion_counts_and_order(spark):
    df = spark.createDataFrame([(1, 5, 1, 10, 1), (1, 5, 1, 11, 1), (2, 5, 0, 12, 1)], "icustay_id long, creatinine_time long, inclusion_age int, anchor_event_id long, x int")
    seen = tuple(Observation() for _ in range(3))
    assert [r.anchor_event_id for r in C.apply_inclusion(df, observations=seen).collect()] == [11]
    assert [list(o.get.values())[0] for o in seen] == [3, 2, 1]
    with pytest.raises(ValueError):
        C.apply_inclusion(df.drop("anchor_event_id"))


def test_values_a_model_cannot_take(spark):
    for step, weight in ((0.0, 1), (-1.0, 1), (0.1, -1)):
        with pytest.raises(ValueError):
            M.boosted_trees(step, min_child_weight=weight)
    # every point of every grid can be fitted, rates above 1 and fractional child weights among them
    registry = {**M.default_registry(4), **M.missing_registry(["a"])}
    assert {k: len(s.points()) for k, s in registry.items()} == {
        "linear_SVM": 11, "logreg": 11, "logreg_elasticnet": 28, "boosted_trees": 140, "perceptron_1hl": 16, "perceptron_2hl": 36, "adaboost_forest": 2,
        "boosted_trees_missing": 140}


@pytest.mark.parametrize("form", ["probability", "discrete"])
def test_boosting_learns_a_simple_rule(spark, form):
    df = EN.assemble(spark.createDataFrame([(float(i % 30), float(i % 7), float(i % 30 // 10)) for i in range(300)], "a double, b double, label double"), ["a", "b"])
    pred = M.AdaBoostForest(rounds=4, rate=0.5, trees=5, depth=3, form=form).fit(df).transform(df)
    assert pred.where("prediction = label").count() >= 280


def test_wide_categories(spark):
    df = spark.createDataFrame([(i, f"v{i % 12_000}") for i in range(12_500)], "k long, c string")
    assert EN.indexed(df, ["c"]).select("c_vector").first()[0].size >= 12_000
    assert EN.dummy_values(df.where("k < 5"), ["c"]) == {"c": ["v0", "v1", "v2", "v3", "v4"]}
    assert CL.size_report(df).first().asDict() == {"n_rows": 12_500, "n_cols": 2}
