"""Model sanity on small fixtures: separable data is learned, outputs are
well-formed, the study plan runs end to end."""

import random

from pyspark.sql import functions as F

from stayframe.operators import encode as EN
from stayframe.operators import model as M
from stayframe.operators import split as SP
from stayframe.plans import training as TR


def _separable(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = i % 3
        rows.append((i, float(k), k * 4.0 + rnd.random(), -k * 3.0 + rnd.random()))
    df = spark.createDataFrame(rows, "id long, label double, a double, b double")
    df = SP.kfold(df, "label", ["id"], seed=44, k=3)
    return EN.assemble(df, ["a", "b"])


def test_linear_models_learn_separable(spark):
    df = _separable(spark)
    for est in (M.logreg(1e-4, max_iter=50), M.linear_svm(1e-4, max_iter=50), M.random_forest(10, 4)):
        acc = M.score(est.fit(df).transform(df))
        assert acc > 0.95


def test_adaboost_and_missing(spark):
    df = _separable(spark)
    acc = M.score(M.AdaBoostForest(rounds=2, trees=5, depth=3).fit(df).transform(df))
    assert acc > 0.9
    raw = df.drop("features").withColumn("a", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("a")))
    m = M.WithMissing(["a", "b"], M.boosted_trees(0.3, 3, 1, max_iter=5).est).fit(raw)
    assert m.transform(raw).where(F.col("prediction").isNull()).count() == 0


def test_grid_search_table(spark):
    df = _separable(spark)
    best, table = M.grid_search(M.Spec(lambda reg=1e-4: M.logreg(reg, max_iter=20), {"reg": [1e-4, 1.0]}), df)
    assert len(table) == 2 and best in [p for p, _, _ in table]


def test_study_plan_end_to_end(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        k = i % 3
        rows.append((i, 100 + i, 1.0 + k + rnd.random(), 40.0 + rnd.random(), 100.0 * rnd.random(),
                     None if i % 4 == 0 else 3600.0 * rnd.random(), "WHITE" if i % 2 else "ASIAN - CHINESE",
                     "FEVER" if i % 3 else "PNEUMONIA", "F" if i % 2 else "M", k))
    df = spark.createDataFrame(rows, "subject_id long, icustay_id long, creatinine double, age double, "
                                     "heart_rate double, heart_rate_delay double, ethnicity string, "
                                     "diagnosis string, gender string, label int")
    dense = TR.prepare_dense(df)
    assert "subject_id" not in dense.columns and "ethnicity_WHITE" in dense.columns
    data = TR.model_input(dense)
    reg = {"logreg": M.Spec(lambda reg=1e-4: M.logreg(reg, max_iter=20), {"reg": [1e-4]})}
    grid, comp, gen = TR.run_study(data, reg)
    assert comp.count() == 1 and gen.count() == 1 and grid.count() == 1
    nulls = TR.prepare_with_nulls(df)
    assert nulls.where(F.col("heart_rate_delay").isNull()).count() > 0


def test_explore_plan(spark):
    from stayframe.plans.explore import explore
    from stayframe.sources.tables import read_table
    li = read_table(spark, "lineitem", "/root/testdata/sf0.001")
    prof, tables = explore(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], sample_n=500)
    rows = {r.column: r for r in prof.collect()}
    assert set(rows) == set(li.columns)
    assert rows["l_quantity"].verdict == "ok" and tables["l_quantity"].count() <= 50
    assert tables["l_returnflag"].count() == 3


def test_grid_search_on_shuffle_splits_with_fbeta(spark):
    df = _separable(spark).drop("fold")
    long = SP.shuffle_folds(df, "label", ["id"], seed=42, n_splits=3, test_size=0.1)
    best, table = M.grid_search(M.Spec(lambda reg=1e-4: M.logreg(reg, max_iter=20), {"reg": [1e-4]}), long,
                                "fold", "fbeta_weighted", role_col="role")
    assert len(table) == 1 and table[0][1] > 0.9


def test_oversample_balanced(spark):
    rows = [(i, 0.0 if i < 300 else (1.0 if i < 400 else 2.0)) for i in range(430)]
    df = spark.createDataFrame(rows, "id long, label double")
    out = M.oversample_balanced(df, "label", seed=42)
    c = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
    assert c[0.0] == 300 and c[1.0] == 300 and abs(c[2.0] - 300) < 40
    again = M.oversample_balanced(df, "label", seed=42)
    assert sorted(r.id for r in again.collect()) == sorted(r.id for r in out.collect())
    acc = M.score(M.perceptron(2, [8], max_iter=50, balanced=True).fit(_separable(spark)).transform(_separable(spark)))
    assert acc > 0.8
