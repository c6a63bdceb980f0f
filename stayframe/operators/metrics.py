"""Classification metrics from a (label, prediction) frame.

Everything is derived from one global aggregate of ``k*k`` conditional
counts (combined map-side), so absent classes give zeros, not errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = (0, 1, 2)


def _c(i, j):
    return f"c{i}{j}"


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes=CLASSES) -> DataFrame:
    """One row with ``c<i><j>`` = rows of truth i predicted j."""
    return df.agg(*[F.count_if((F.col(label) == i) & (F.col(prediction) == j)).alias(_c(i, j))
                    for i in classes for j in classes])


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes=CLASSES) -> DataFrame:
    """The full grid (label, prediction, count), truth in rows."""
    cc = confusion_counts(df, label, prediction, classes)
    cells = [F.struct(F.lit(i).alias("label"), F.lit(j).alias("prediction"), F.col(_c(i, j)).alias("count"))
             for i in classes for j in classes]
    return cc.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def _scores_from(cc: DataFrame, classes=CLASSES) -> DataFrame:
    c = lambda i, j: F.col(_c(i, j))
    n = sum(c(i, j) for i in classes for j in classes)
    correct = sum(c(i, i) for i in classes)
    sens = F.try_divide(c(0, 0), c(0, 0) + c(0, 1) + c(0, 2))
    tn = c(0, 0) + c(0, 2) + c(2, 0) + c(2, 2)
    spec = F.try_divide(tn, tn + c(0, 1) + c(2, 1))
    return cc.select(F.try_divide(correct, n).alias("accuracy"),            # K02
                     sens.cast("double").alias("sensitivity_increase"),     # K03
                     spec.cast("double").alias("specificity_decrease"),     # K04
                     n.alias("n"))


def scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """K02-K04 in one row: accuracy, recall of class 0, and the specificity of
    class 1 (TN / (TN + FP) with class 1 as positive)."""
    return _scores_from(confusion_counts(df, label, prediction))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          classes=CLASSES, beta: float = 1.0) -> DataFrame:
    """Per class precision, recall, F-beta and support."""
    cc = confusion_counts(df, label, prediction, classes)
    rows = []
    for k in classes:
        tp = F.col(_c(k, k))
        support = sum(F.col(_c(k, j)) for j in classes)
        predicted = sum(F.col(_c(i, k)) for i in classes)
        p = F.coalesce(F.try_divide(tp, predicted), F.lit(0.0))
        r = F.coalesce(F.try_divide(tp, support), F.lit(0.0))
        b2 = beta * beta
        f = F.coalesce(F.try_divide((1 + b2) * p * r, b2 * p + r), F.lit(0.0))
        rows.append(F.struct(F.lit(k).alias("class"), p.cast("double").alias("precision"),
                             r.cast("double").alias("recall"), f.cast("double").alias("f_score"),
                             support.alias("support")))
    return cc.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def fbeta_weighted(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   beta: float = 0.5, classes=CLASSES) -> DataFrame:
    """Support-weighted F-beta (beta 0.5 in the original)."""
    rep = classification_report(df, label, prediction, classes, beta)
    return rep.agg(F.try_divide(F.sum(F.col("f_score") * F.col("support")), F.sum("support"))
                   .cast("double").alias("fbeta_weighted"))


def random_baseline(df: DataFrame, label: str = "label") -> DataFrame:
    """Expected sensitivity/specificity of a classifier that draws labels
    with the class frequencies: p(0) and 1 - p(1)."""
    n = F.count(F.lit(1))
    return df.agg((F.count_if(F.col(label) == 0) / n).alias("sensitivity_increase"),
                  (1 - F.count_if(F.col(label) == 1) / n).alias("specificity_decrease"))
