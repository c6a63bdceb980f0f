"""Registered checks, part 3: feature vector, PCA, classifiers, tuning and
comparison on lineitem (label = return flag A/N/R -> 0/1/2). The checks with an
oracle are plumbing checks: they are fitted where the features hold one indicator
per label, so predictions and scores are known. The ``_noisy`` ones run on the four
numeric columns, which say little about the label (rows only); what the fits
compute is held against independent computations in ``tests/test_one_pass_models.py``."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stayframe import presets as P
from stayframe.operators import encode as EN
from stayframe.operators import model as M
from stayframe.operators import split as SP
from stayframe.operators import wide_pca as WP
from stayframe.session import stage_path
from stayframe.sources import tables as IO

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def _numeric(spark, d):
    """Key, numeric columns and label of every line item."""
    li = IO.read_table(spark, "lineitem", d)
    label = (F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(2.0))
    return li.select(*KEY, *[F.col(c).alias(f"x_{c}") for c in NUM], label.alias("label"))


def _with_nulls(column: str):
    return F.when(F.col(column) >= 0.02, F.col(column))


def _data(spark, d, nulls: bool = False):
    """Model input, written once: the fits below scan it several times."""
    df, cols = _numeric(spark, d), [f"x_{c}" for c in NUM]
    if nulls:
        df = df.withColumn("x_l_discount", _with_nulls("x_l_discount"))
    df = EN.standardize(df, cols)
    df = SP.split_and_folds(df, "label", KEY, seed=44, k=3)
    if not nulls:
        df = EN.assemble(df, cols)
    return _written(df, cols if nulls else ["features"]), cols


def _data_both(spark, d):
    """``_data`` without and with NULLs: both have the same split and folds, so the rows are ranked and written once."""
    cols = [f"x_{c}" for c in NUM]
    df = _numeric(spark, d).withColumn("kept", _with_nulls("x_l_discount"))
    df = SP.split_and_folds(EN.standardize(df, [*cols, "kept"]), "label", KEY, seed=44, k=3)
    df = EN.assemble(df, cols).withColumn("x_l_discount", F.col("kept"))
    df = _written(df, ["features", *cols])
    return df.drop(*cols), df.drop("features"), cols


def _written(df, features):
    """``df`` with these features as a table in the shared checkpoint folder. Every fit scans it several times; a scan reads the
    columns it needs, and the work before it is done once (an eager checkpoint does its last stage twice)."""
    path = stage_path(df.sparkSession, f"model-input-{uuid.uuid4().hex}")
    df = df.select("l_orderkey", "l_linenumber", *features, "label", "split", "fold")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


EXACT = ["x_a", "x_n", "x_r", "x_tax"]


def _exact(spark, d, nulls: bool = False):
    """Model input whose label is a function of the features (one indicator per
    return flag, plus a column that says nothing), so the right predictions and
    scores are known. ``nulls`` empties one indicator in some rows; the others
    still tell the class."""
    li = IO.read_table(spark, "lineitem", d)
    flag = F.col("l_returnflag")
    a = F.when(flag == "A", 1.0).otherwise(0.0)
    df = li.select(*KEY, (F.when(F.col("l_linenumber") != 2, a) if nulls else a).alias("x_a"), F.when(flag == "N", 1.0).otherwise(0.0).alias("x_n"),
                   F.when(flag == "R", 1.0).otherwise(0.0).alias("x_r"), F.col("l_tax").alias("x_tax"),
                   F.when(flag == "A", 0.0).when(flag == "N", 1.0).otherwise(2.0).alias("label"))
    df = SP.split_and_folds(df, "label", KEY, seed=44, k=3)
    return _written(df if nulls else EN.assemble(df, EXACT), EXACT if nulls else ["features"])


def _noisy_predictions(spark, d, est, nulls=False):
    """Fitted on a label that the features tell little about: rows only."""
    df, _ = _data(spark, d, nulls)
    model = est.fit(df.where(F.col("split") == "hyperopt"))
    return model.transform(df.where(F.col("split") == "compare")).select("l_orderkey", "l_linenumber", "label", "prediction")


def _exact_predictions(spark, d, est, nulls=False):
    """Fitted on the training part, predicted for all rows."""
    df = _exact(spark, d, nulls)
    return est.fit(df.where(F.col("split") == "hyperopt")).transform(df).select("l_orderkey", "l_linenumber", "label", "prediction")


def e09_assemble(spark, d):
    df, cols = _data(spark, d)
    arr = vector_to_array("features")
    return df.select("l_orderkey", "l_linenumber", *[F.round(arr[i], 6).alias(f"f{i}") for i in range(len(cols))])


def e10_pca(spark, d):
    """Two standardised columns: the explained variances are (1 +- |r|) / 2."""
    df = EN.standardize(IO.read_table(spark, "lineitem", d).select("l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return EN.pca_table(df, ["l_quantity", "l_extendedprice"]).select("component", F.round("explained_variance", 6).alias("explained_variance"))


def e10b_pca_wide(spark, d):
    """The same by randomised range finding, which needs no covariance matrix."""
    df = EN.standardize(IO.read_table(spark, "lineitem", d).select("l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    return WP.wide_pca_table(df, ["l_quantity", "l_extendedprice"], 2).select("component", F.round("explained_variance", 6).alias("explained_variance"))


#: Model checks: name -> (estimator of the feature columns, whether NULLs are kept).
ESTIMATORS = {
    "m01_linear_svm_ovr": (lambda cols: M.linear_svm(1e-4, max_iter=20), False),
    "m02_logreg_l2_ovr": (lambda cols: M.logreg(1e-4, 0.0, max_iter=50), False),
    "m03_logreg_elasticnet_ovr": (lambda cols: M.logreg(1e-4, 0.15, max_iter=50), False),
    "m04_boosted_trees": (lambda cols: M.boosted_trees(0.1, 3, 1), False),
    "m05_perceptron_1hl": (lambda cols: M.perceptron(len(cols), [10], dropout=[0.1]), False),
    "m06_perceptron_2hl": (lambda cols: M.perceptron(len(cols), [32, 16], balanced=True, dropout=[0.0, 0.2]), False),
    "m07_boosted_with_missing": (lambda cols: M.boosted_trees(0.1, 3, 1, features=cols), True),
    "m08_adaboost_forest": (lambda cols: M.AdaBoostForest(rounds=P.ADABOOST_ROUNDS, rate=0.5, trees=10, depth=5), False),
    "m09_random_forest": (lambda cols: M.random_forest(20, 5), False),
    "m10_predict": (lambda cols: M.logreg(1e-4, max_iter=50), False),
}


def _exact_check(make, nulls):
    return lambda spark, d: _exact_predictions(spark, d, make(EXACT), nulls)


def _noisy_check(make, nulls):
    return lambda spark, d: _noisy_predictions(spark, d, make([f"x_{c}" for c in NUM]), nulls)


MODELS = {name: _exact_check(make, nulls) for name, (make, nulls) in ESTIMATORS.items()}
NOISY = {f"{name}_noisy": _noisy_check(make, nulls) for name, (make, nulls) in ESTIMATORS.items()}


def _searched():
    """The study's logistic grid, whole; g05 lists the points of all models."""
    return {k: v for k, v in M.default_registry(len(NUM)).items() if k == "logreg"}


def _search(spark, d):
    """The grid search of g01-g04 and o04, on the input whose scores are known."""
    return _searched_on(_exact(spark, d))


def _searched_on(df):
    spark = df.sparkSession
    return df, *_all_points(spark, _searched(), df.where(F.col("split") == "hyperopt"))


def _all_points(spark, registry, hyper):
    """(best points, grid table) of a registry on its folds."""
    found = M.grid_search_all(registry, hyper, "fold", "accuracy")
    tables = [M.grid_table(spark, name, table) for name, (_, table) in found.items()]
    grid = tables[0]
    for t in tables[1:]:
        grid = grid.unionByName(t)
    return {name: b for name, (b, _) in found.items()}, grid


def _study(spark, d):
    """The study's seven models with their whole grids, on the noisy table and (the null-kept model) on the one with NULLs,
    [(registry, table)]."""
    reg = {k: v for k, v in M.default_registry(len(NUM)).items() if k != "adaboost_forest"}
    dense, kept, cols = _data_both(spark, d)
    return [(reg, dense), (M.missing_registry(cols), kept)]


def g01b_grid_search_all_noisy(spark, d):
    """G01/G02 over all seven models: mean and deviation of the accuracy over the folds, for every point of their grids."""
    tables = [_all_points(spark, reg, df.where(F.col("split") == "hyperopt"))[1] for reg, df in _study(spark, d)]
    return tables[0].unionByName(tables[1])


def g04b_generalisation_all_noisy(spark, d):
    """G03/G04 over all seven models, each at the best of its whole grid."""
    out = []
    for reg, df in _study(spark, d):
        best, _ = _all_points(spark, reg, df.where(F.col("split") == "hyperopt"))
        comp = M.compare_table(spark, reg, best, df.where(F.col("split") == "hyperopt"), df.where(F.col("split") == "compare"))
        test = M.compare_table(spark, reg, best, df.where(F.col("split").isin("hyperopt", "compare")), df.where(F.col("split") == "test"))
        out.append(M.generalisation_table(comp, test))
    return out[0].unionByName(out[1])


def g01_grid_search(spark, d):
    _, best, _ = _search(spark, d)
    return spark.createDataFrame([(k, repr(sorted(v.items()))) for k, v in best.items()], "model string, params string")


def g02_grid_table(spark, d):
    return _search(spark, d)[2]


def g02b_grid_table_noisy(spark, d):
    return _searched_on(_data(spark, d)[0])[2]


def o04_best_of_grid(spark, d):
    return M.best_of_grid(_search(spark, d)[2])


def g03_compare_table(spark, d):
    df, best, _ = _search(spark, d)
    return M.compare_table(spark, _searched(), best, df.where(F.col("split") == "hyperopt"),
                           df.where(F.col("split") == "compare"))


def g04_generalisation_table(spark, d):
    df, best, _ = _search(spark, d)
    reg = _searched()
    comp = M.compare_table(spark, reg, best, df.where(F.col("split") == "hyperopt"), df.where(F.col("split") == "compare"))
    test = M.compare_table(spark, reg, best, df.where(F.col("split").isin("hyperopt", "compare")),
                           df.where(F.col("split") == "test"))
    return M.generalisation_table(comp, test)


def g05_registry(spark, d):
    df, _ = _data(spark, d)
    return M.search_plan(M.default_registry(len(NUM)), df.where(F.col("split") == "hyperopt")).drop("params")


QUERIES = {k: v for k, v in dict(globals()).items()
           if callable(v) and k[:1] in "emgo" and k[1:3].isdigit() and "_" in k} | MODELS | NOISY

def _grid_sql(name, *sizes):
    """(model, point, supported) of a grid with these numbers of values."""
    n = 1
    for k in sizes:
        n *= k
    return f"SELECT '{name}' AS model, CAST(point AS INTEGER) AS point, true AS supported FROM range({n}) AS r(point)"


_PREDICTED = """SELECT l_orderkey, l_linenumber, label, label AS prediction FROM (SELECT *, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS DOUBLE) AS label
        FROM lineitem)"""
_REGS = [repr([("reg", v)]).replace("'", "''") for v in P.LOGREG_ALPHAS]
_GRID = " UNION ALL ".join(f"SELECT 'logreg' AS model, '{r}' AS params, 1.0::DOUBLE AS mean, 0.0::DOUBLE AS std" for r in _REGS)
_FIRST = min(range(len(_REGS)), key=lambda i: _REGS[i])   # equal means: the first of the sorted texts

SQL = {
    **dict.fromkeys(MODELS, _PREDICTED),
    # every point of the grid scores 1 on every fold; the first one is the best
    "g01_grid_search": f"SELECT 'logreg' AS model, '{_REGS[0]}' AS params FROM (SELECT count(*) FROM lineitem)",
    "g02_grid_table": _GRID,
    "o04_best_of_grid": f"SELECT * FROM ({_GRID}) WHERE params = '{_REGS[_FIRST]}'",
    "g03_compare_table": """SELECT 'logreg' AS model, 1.0::DOUBLE AS accuracy, 1.0::DOUBLE AS sensitivity_increase, 1.0::DOUBLE AS specificity_decrease
        FROM (SELECT count(*) FROM lineitem)""",
    "g04_generalisation_table": """SELECT 'logreg' AS model, """ + ", ".join(
        f"{v}::DOUBLE AS {p}_{m}" for p, v in (("compare", 1.0), ("test", 1.0), ("delta", 0.0)) for m in M.METRICS) + " FROM (SELECT count(*) FROM lineitem)",
    "g05_registry": "WITH g AS (" + " UNION ALL ".join([
        _grid_sql("linear_SVM", 11), _grid_sql("logreg", 11), _grid_sql("logreg_elasticnet", 7, 4),
        _grid_sql("boosted_trees", 7, 5, 4),
        _grid_sql("perceptron_1hl", 4, 4), _grid_sql("perceptron_2hl", 3, 2, 3, 2), _grid_sql("adaboost_forest", 2)]) + """),
        r AS (SELECT unnest(range(0, CAST(round(0.8 * n) AS BIGINT))) AS k FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)),
        f AS (SELECT CAST(k % 3 AS INTEGER) AS fold, count(*) AS n_test FROM r GROUP BY 1)
        SELECT model, point, supported, fold, CAST((SELECT sum(n_test) FROM f) AS BIGINT) - n_test AS n_train, n_test FROM g, f""",
    "e10_pca": """SELECT CAST(c AS INTEGER) AS component, round((1 + CASE c WHEN 1 THEN 1 ELSE -1 END * abs(r)) / 2, 6) AS explained_variance
        FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem), range(1, 3) AS t(c)""",
    "e09_assemble": """WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS m2,
        stddev_pop(l_extendedprice) AS s2, avg(l_discount) AS m3, stddev_pop(l_discount) AS s3, avg(l_tax) AS m4,
        stddev_pop(l_tax) AS s4 FROM lineitem)
        SELECT l_orderkey, l_linenumber, round((l_quantity - m1) / s1, 6) AS f0, round((l_extendedprice - m2) / s2, 6) AS f1,
        round((l_discount - m3) / s3, 6) AS f2, round((l_tax - m4) / s4, 6) AS f3 FROM lineitem, s""",
}

SQL["e10b_pca_wide"] = SQL["e10_pca"]

CHECKS = {k: (fn, SQL.get(k)) for k, fn in QUERIES.items()}
