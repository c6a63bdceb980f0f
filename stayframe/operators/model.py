"""Classifiers, tuning and comparison.

Linear classifiers, perceptrons and boosted trees are fitted by passes over packed rows, many grid points and folds in
the same pass (``linear``, ``perceptron``, ``boosting``), boosting over random forests on binned rows (``forest``); single random forests are
MLlib's. The driver holds parameters, sums and scores only. Labels are 0..k-1 doubles, features one vector column.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from typing import Callable

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.operators import blocks as B
from stayframe.operators import boosting as BT
from stayframe.operators import forest as FO
from stayframe.operators import linear as LN
from stayframe.operators import metrics as K
from stayframe.operators import perceptron as PC

CLASSES = (0, 1, 2)


# ---- one-vs-rest with per-problem balanced weights (M01-M03) ----------------

def linear_svm(reg: float = 0.0001, max_iter: int = 100) -> LN.LinearOvr:
    """One-vs-rest hinge loss, L2, balanced."""
    return LN.LinearOvr(LN.Point("hinge", reg), max_iter)


def logreg(reg: float = 0.0001, l1_ratio: float = 0.0, max_iter: int = 100) -> LN.LinearOvr:
    """M02 (``l1_ratio=0``) / M03: one-vs-rest logistic, balanced."""
    return LN.LinearOvr(LN.Point("log", reg, l1_ratio), max_iter)


# ---- trees, perceptrons -------------------------------------------------------

class _Plain:
    """Adapter: MLlib estimator with label/features already set."""

    def __init__(self, est):
        self.est = est

    def fit(self, df):
        return self.est.fit(df)


def boosted_trees(step: float = 0.1, depth: int = 3, min_child_weight: float = 1, max_iter: int = 20, features="features"):
    """Softmax gradient boosting, one tree per class and round; any positive step, children of at least ``min_child_weight``
    hessian. M07: with ``features`` a list of columns, whose nulls are missing values of learned direction."""
    if step <= 0 or min_child_weight < 0:
        raise ValueError(f"step {step}, min_child_weight {min_child_weight}: a positive step and no negative weight")
    return _Plain(BT.BoostedTrees(BT.Point(step, depth, min_child_weight), max_iter, features=features))


def random_forest(trees: int = 20, depth: int = 5, seed: int = 44, weight_col: str | None = None):
    """M09."""
    rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)
    if weight_col:
        rf.setWeightCol(weight_col)
    return _Plain(rf)


def oversample_balanced(df: DataFrame, label: str = "label", seed: int = 42) -> DataFrame:
    """Class balance by repetition (for learners without a weight column):
    each row of class c is repeated ``n_max / n_c`` times on average, the
    whole part always and the fraction by a repeatable hash draw. Runs as a
    per-row ``explode``; only the per-class counts reach the driver."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    if not counts:
        return df
    n_max = max(counts.values())
    u = (F.abs(F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed))) % 1_000_000_007) / F.lit(1_000_000_007.0)
    rep = F.lit(1)
    for cls, n in counts.items():
        whole, frac = divmod(n_max / n, 1.0)
        rep = F.when(F.col(label) == cls, F.lit(int(whole)) + (u < frac).cast("int")).otherwise(rep)
    cols = df.columns
    return df.withColumn("_rep", rep).where(F.col("_rep") > 0) \
             .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_rep")))).select(*cols)


class Oversampled:
    """Fit ``inner`` on a class-balanced (oversampled) copy of the input."""

    def __init__(self, inner, label: str = "label", seed: int = 42):
        self.inner, self.label, self.seed = inner, label, seed

    def fit(self, df):
        return self.inner.fit(oversample_balanced(df, self.label, self.seed))


def perceptron(n_features: int, hidden: list[int], max_iter: int = 10, seed: int = 42, n_classes: int = 3,
               balanced: bool = False, dropout: list[float] | None = None, batches: int = 4):
    """Fully connected network (rectified hidden units, dropout, softmax out), ``max_iter`` epochs of ``batches``
    steps; ``balanced=True`` weights the classes. The inputs are those of the data (``n_features`` is not needed)."""
    point = PC.Point(tuple(hidden), tuple(dropout or [0.0] * len(hidden)))
    return PC.Perceptron(point, max_iter, batches, seed, balanced, classes=tuple(range(n_classes)))


class WithMissing:
    """For learners that take no NULLs (M07 has learned directions instead, see ``boosted_trees``): one 0/1 indicator
    per column, median imputation, then the wrapped estimator."""

    def __init__(self, cols: list[str], inner, out: str = "features"):
        self.cols, self.inner, self.out = cols, inner, out

    def _prep(self, df):
        ind = [F.col(c).isNull().cast("double").alias(f"{c}__isnull") for c in self.cols]
        return df.select("*", *ind)

    def fit(self, df):
        d = self._prep(df)
        imp_cols = [f"{c}__imp" for c in self.cols]
        pipe = Pipeline(stages=[
            Imputer(inputCols=self.cols, outputCols=imp_cols, strategy="median"),
            VectorAssembler(inputCols=imp_cols + [f"{c}__isnull" for c in self.cols], outputCol=self.out)])
        prep = pipe.fit(d)
        model = self.inner.fit(prep.transform(d))
        return _WithMissingModel(self, prep, model)


class _WithMissingModel:
    def __init__(self, owner, prep, model):
        self.owner, self.prep, self.model = owner, prep, model

    def transform(self, df):
        cols = [f"{c}__imp" for c in self.owner.cols] + [f"{c}__isnull" for c in self.owner.cols]
        return self.model.transform(self.prep.transform(self.owner._prep(df))).drop(*cols)


# ---- AdaBoost over random forests (M08) ---------------------------------------

class AdaBoostForest:
    """Multi-class boosting with random forests as base learners, each forest
    class-balanced by itself. ``form='probability'`` (SAMME.R, the study's
    default) updates the row weights by the forests' class probabilities;
    ``'discrete'`` (SAMME) by their predictions. Forests see bins only, so rows
    of equal bins and label are added up once and keep equal weights; the weights
    are a column of that table, written anew every round (so a lost executor
    repeats its own tasks)."""

    def __init__(self, rounds: int = 50, rate: float = 0.5, trees: int = 10, depth: int = 5, seed: int = 42,
                 n_classes: int = 3, form: str = "probability"):
        if form not in ("probability", "discrete"):
            raise ValueError(f"form {form}: probability or discrete")
        self.rounds, self.rate, self.trees, self.depth, self.seed, self.k = rounds, rate, trees, depth, seed, n_classes
        self.form = form

    def fit(self, df: DataFrame) -> "AdaBoostForestModel":
        classes, k, rate = tuple(range(self.k)), self.k, self.rate
        data = B.pack(df, classes=classes, merged=True)
        cuts = BT.quantile_cuts(data)
        rows = BT.binned(data, cuts)
        n, by_class = data.counts.sum(), B.class_weights(data.counts)[0]
        models, alphas, scale = [], [], 1.0
        for m in range(self.rounds if len(cuts.edges) else 0):
            forest = FO.train(rows, self.trees, self.depth, self.seed + m, scale * by_class, classes)

            def judged(r: B.Rows, forest=forest, scale=scale):
                """Class, row weight, number of rows, and probabilities."""
                weight = scale * (np.ones(len(r.y)) if r.weight is None else r.weight)
                return np.minimum(np.searchsorted(classes, r.y), k - 1), weight, r.key * np.isin(r.y, classes), FO.probabilities(forest, r.x)

            if self.form == "probability":
                def change(r: B.Rows, judged=judged):
                    cls, weight, times, p = judged(r)
                    logs = _log_probabilities(p)
                    true, rest = logs[np.arange(len(logs)), cls], logs.sum(1)
                    # exp(-rate * (k-1)/k * sum_j y_j log p_j) with y = 1 for the label, -1/(k-1) else
                    weight = weight * np.exp(-rate * (k - 1) / k * (true - (rest - true) / (k - 1)))
                    return weight, np.stack([times * weight, times * (p.argmax(1) != cls)], 1)

                models.append(forest)
                alphas.append(1.0)
                rows, (total, wrong) = FO.reweighted(rows, change, 2)
                if not wrong or not total:
                    break
                scale = n / total
                continue

            def errors(r: B.Rows, judged=judged):
                cls, weight, times, p = judged(r)
                return np.array([(times * weight).sum(), (times * weight * (p.argmax(1) != cls)).sum()])

            tot, bad = B.summed(rows, errors, 2)
            err = bad / tot
            if err >= 1 - 1.0 / k:
                break
            alpha = rate * (math.log((1 - err) / max(err, 1e-12)) + math.log(k - 1))
            models.append(forest)
            alphas.append(alpha)
            if err <= 0:
                break

            def raised(r: B.Rows, judged=judged, alpha=alpha):
                cls, weight, times, p = judged(r)
                weight = weight * np.where(p.argmax(1) != cls, math.exp(alpha), 1.0)
                return weight, (times * weight)[:, None]

            rows, (s,) = FO.reweighted(rows, raised, 1)
            scale = n / s
        return AdaBoostForestModel(models, alphas, k, self.form, cuts)


def _log_probabilities(p: np.ndarray) -> np.ndarray:
    """Logarithms of the forest's class probabilities (bounded below, as usual)."""
    return np.log(np.maximum(p, 2.2e-16))


class AdaBoostForestModel:
    def __init__(self, models, alphas, k, form="discrete", cuts=None):
        self.models, self.alphas, self.k, self.form, self.cuts = models, alphas, k, form, cuts

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction``: the class with the largest score (ties: the smallest class)."""
        models, alphas, k, form = self.models, self.alphas, self.k, self.form
        if not models:
            return df.withColumn("prediction", F.lit(0.0))

        def best(bins: np.ndarray) -> np.ndarray:
            score = np.zeros((len(bins), k))
            for forest, alpha in zip(models, alphas):
                p = FO.probabilities(forest, bins)
                if form == "probability":
                    logs = _log_probabilities(p)
                    score += (k - 1.0) * (logs - logs.sum(1, keepdims=True) / k)
                else:
                    score[np.arange(len(p)), p.argmax(1)] += alpha
            return score.argmax(1).astype(np.float64)

        return FO.predicted(df, "features", self.cuts, best, "double", "prediction")


# ---- scoring, tuning, comparison ---------------------------------------------

METRICS = ("accuracy", "sensitivity_increase", "specificity_decrease")


def score(pred: DataFrame, metric: str = "accuracy") -> float:
    """One metric of a prediction frame: accuracy, sensitivity_increase,
    specificity_decrease, or fbeta_weighted (beta 0.5)."""
    if metric == "fbeta_weighted":
        return K.fbeta_weighted(pred.select("label", "prediction"), beta=0.5).first()[0]
    row = K.scores(pred.select("label", "prediction")).first()
    return row[metric]


def score_row(pred: DataFrame) -> dict:
    row = K.scores(pred.select("label", "prediction")).first()
    return {m: row[m] for m in METRICS}


@dataclass
class Spec:
    """A registry entry (G05): estimator factory + grid of keyword values. ``point`` turns the keywords into a point of
    ``linear``, ``perceptron`` or ``boosting``, whose grids are searched in common passes; ``options`` go to that search."""
    factory: Callable[..., object]
    grid: dict = field(default_factory=dict)
    point: Callable[..., object] | None = None
    options: dict = field(default_factory=dict)
    features: str | list[str] = "features"

    def points(self):
        keys = list(self.grid)
        return [dict(zip(keys, v)) for v in itertools.product(*[self.grid[k] for k in keys])] or [{}]


def metric_of(counts: np.ndarray, metric: str = "accuracy") -> np.ndarray:
    """A metric of confusion counts (... x truth x prediction); 0 where it is undefined."""
    c = counts.astype(np.float64)
    ratio = lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1), 0.0)
    if metric == "accuracy":
        return ratio(np.trace(c, axis1=-2, axis2=-1), c.sum((-2, -1)))
    if metric == "sensitivity_increase":
        return ratio(c[..., 0, 0], c[..., 0, :].sum(-1))
    if metric == "specificity_decrease":
        tn = c[..., 0, 0] + c[..., 0, 2] + c[..., 2, 0] + c[..., 2, 2]
        return ratio(tn, tn + c[..., 0, 1] + c[..., 2, 1])
    if metric == "fbeta_weighted":
        hit, truth, said = np.diagonal(c, axis1=-2, axis2=-1), c.sum(-1), c.sum(-2)
        f = ratio(1.25 * hit, 0.25 * truth + said)  # beta 0.5
        return ratio((f * truth).sum(-1), truth.sum(-1))
    raise ValueError(f"metric {metric}")


def search_counts(registry: dict[str, Spec], df: DataFrame, fold_col: str = "fold", role_col: str | None = None) -> dict[str, np.ndarray]:
    """Confusion counts (points x folds x truth x prediction) of every model's whole grid.

    All linear grids share their passes, so do all perceptrons of like options, and all boosted trees. Models without
    ``point`` are fitted one after the other.

    k-fold (T04): each fold is the test part once, the others train.
    Shuffle splits (T03, the long form of ``split.shuffle_folds``): pass
    ``role_col='role'``; fold i trains on its 'train' rows, tests on 'test'."""
    names, parts = B.shuffle_parts(df, fold_col, role_col) if role_col else B.kfold_parts(df, fold_col)
    out, groups, packed = {}, {}, {}
    for name, spec in registry.items():
        points = [spec.point(**p) for p in spec.points()] if spec.point else None
        if points:
            groups.setdefault((type(points[0]), str(spec.features), repr(sorted(spec.options.items()))), []).append((name, points))
    for (kind, _, _), members in groups.items():
        spec = registry[members[0][0]]
        points = [p for _, own in members for p in own]
        if kind is PC.Point:
            counts = PC.search(df, parts, points, features=spec.features, **spec.options)
        else:
            if str(spec.features) not in packed:
                packed[str(spec.features)] = B.pack(df, parts, spec.features, merged=True)
            counts = (LN if kind is LN.Point else BT).search(packed[str(spec.features)], points, **spec.options)
        at = 0
        for name, own in members:
            out[name] = counts[at:at + len(own)]
            at += len(own)
    for name, spec in registry.items():
        if spec.point:
            continue
        counts = []
        for p in spec.points():
            for f in names:
                if role_col:
                    this = df.where(F.col(fold_col) == f)
                    train, test = this.where(F.col(role_col) == "train"), this.where(F.col(role_col) == "test")
                else:
                    train, test = df.where(F.col(fold_col) != f), df.where(F.col(fold_col) == f)
                row = K.confusion_counts(spec.factory(**p).fit(train).transform(test)).first()
                counts.append([[row[f"c{i}{j}"] for j in CLASSES] for i in CLASSES])
        out[name] = np.array(counts).reshape(len(spec.points()), len(names), len(CLASSES), len(CLASSES))
    return out


def grid_search_all(registry: dict[str, Spec], df: DataFrame, fold_col: str = "fold", metric: str = "accuracy",
                    role_col: str | None = None) -> dict[str, tuple[dict, list[tuple[dict, float, float]]]]:
    """G01/G02 of many models: per model the best point (the first best on ties) and its (point, mean, std) table."""
    out = {}
    for name, counts in search_counts(registry, df, fold_col, role_col).items():
        values = metric_of(counts, metric)
        table = [(p, float(v.mean()), float(v.std())) for p, v in zip(registry[name].points(), values)]
        out[name] = max(table, key=lambda r: r[1])[0], table
    return out


def grid_search(spec: Spec, df: DataFrame, fold_col: str = "fold", metric: str = "accuracy",
                role_col: str | None = None) -> tuple[dict, list[tuple[dict, float, float]]]:
    """G01/G02 of one model: the best point (O04) and the (point, mean, std) table."""
    return grid_search_all({"model": spec}, df, fold_col, metric, role_col)["model"]


def grid_table(spark, name: str, table) -> DataFrame:
    """G02 as a DataFrame: model, params, mean, std."""
    rows = [(name, repr(sorted(p.items())), float(m), float(s)) for p, m, s in table]
    return spark.createDataFrame(rows, "model string, params string, mean double, std double")


def best_of_grid(grid: DataFrame) -> DataFrame:
    """The best row per model (highest mean, then params)."""
    from pyspark.sql import Window
    w = Window.partitionBy("model").orderBy(F.desc("mean"), "params")
    return grid.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def compare_table(spark, registry: dict[str, Spec], best: dict[str, dict], train: DataFrame,
                  test: DataFrame) -> DataFrame:
    """G03 (train=hyperopt, test=compare) / G04 (train=hyperopt+compare,
    test=test): one row of metrics per model."""
    rows = []
    with B.shared():  # models of like input share the packed training rows
        for name, spec in registry.items():
            model = spec.factory(**best.get(name, {})).fit(train)
            s = score_row(model.transform(test))
            rows.append((name, *[None if s[m] is None else float(s[m]) for m in METRICS]))
    return spark.createDataFrame(rows, "model string, accuracy double, sensitivity_increase double, "
                                       "specificity_decrease double")


def generalisation_table(compare: DataFrame, test: DataFrame) -> DataFrame:
    """Both tables side by side with the change test - compare."""
    c = compare.select("model", *[F.col(m).alias(f"compare_{m}") for m in METRICS])
    t = test.select("model", *[F.col(m).alias(f"test_{m}") for m in METRICS])
    j = c.join(t, "model")
    return j.select("*", *[(F.col(f"test_{m}") - F.col(f"compare_{m}")).alias(f"delta_{m}") for m in METRICS])


def _tree_point(step, depth, mcw) -> BT.Point:
    return BT.Point(step, depth, mcw)


def default_registry(n_features: int, epochs: int = 10, rounds: int = 20) -> dict[str, Spec]:
    """The study's models and their whole grids."""
    from stayframe import presets as P
    trees = {"step": P.BOOST_RATES, "depth": P.BOOST_DEPTHS, "mcw": P.BOOST_MIN_CHILD_WEIGHTS}
    net = {"epochs": epochs, "batches": 4, "seed": 42, "balanced": False}
    return {
        "linear_SVM": Spec(lambda reg=1e-4: linear_svm(reg), {"reg": P.SVM_ALPHAS}, lambda reg: LN.Point("hinge", reg)),
        "logreg": Spec(lambda reg=1e-4: logreg(reg), {"reg": P.LOGREG_ALPHAS}, lambda reg: LN.Point("log", reg)),
        "logreg_elasticnet": Spec(lambda reg=1e-4, l1=0.15: logreg(reg, l1), {"reg": P.ENET_ALPHAS, "l1": P.ENET_L1_RATIOS},
                                  lambda reg, l1: LN.Point("log", reg, l1)),
        "boosted_trees": Spec(lambda step=0.1, depth=3, mcw=1: boosted_trees(step, depth, mcw, rounds), trees, _tree_point, {"rounds": rounds}),
        "perceptron_1hl": Spec(lambda h=10, d=0.0: perceptron(n_features, [h], epochs, dropout=[d]), {"h": P.MLP1_UNITS, "d": P.MLP1_DROPOUT},
                               lambda h, d: PC.Point((h,), (d,)), net),
        "perceptron_2hl": Spec(lambda h1=10, d1=0.0, h2=10, d2=0.0: perceptron(n_features, [h1, h2], epochs, dropout=[d1, d2]),
                               {"h1": P.MLP2_UNITS_1, "d1": P.MLP2_DROPOUT_1, "h2": P.MLP2_UNITS_2, "d2": P.MLP2_DROPOUT_2},
                               lambda h1, d1, h2, d2: PC.Point((h1, h2), (d1, d2)), net),
        "adaboost_forest": Spec(lambda rate=0.5: AdaBoostForest(P.ADABOOST_ROUNDS, rate), {"rate": P.ADABOOST_RATES}),
    }


def missing_registry(cols: list[str], rounds: int = 20) -> dict[str, Spec]:
    """The model of the null-kept table (M07), with the grid of the other boosted trees."""
    from stayframe import presets as P
    grid = {"step": P.BOOST_RATES, "depth": P.BOOST_DEPTHS, "mcw": P.BOOST_MIN_CHILD_WEIGHTS}
    return {"boosted_trees_missing": Spec(lambda step=0.1, depth=3, mcw=1: boosted_trees(step, depth, mcw, rounds, cols), grid, _tree_point,
                                          {"rounds": rounds}, cols)}


def search_plan(registry: dict[str, Spec], df: DataFrame, fold_col: str = "fold") -> DataFrame:
    """G05 as a table: every grid point of every model on every fold, with the
    rows it trains and scores on."""
    folds = sorted((r[0], r[1]) for r in df.groupBy(fold_col).count().collect())
    total = sum(n for _, n in folds)
    rows = [(name, i, repr(sorted(p.items())), True, f, total - n, n)
            for name, spec in registry.items() for i, p in enumerate(spec.points()) for f, n in folds]
    return df.sparkSession.createDataFrame(rows, "model string, point int, params string, supported boolean, fold int, n_train long, n_test long")
