"""Encoding and scaling.

Scalers fit with one aggregate pass (a handful of driver scalars) and apply
as plain column arithmetic; the rows stay on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dummy_values(df: DataFrame, cols: list[str]) -> dict[str, list]:
    """Sorted distinct non-NULL values per column, in one job. Each becomes a
    column of the result, so the list is as long as the schema it makes; for
    columns of very many values use ``indexed`` (one vector column)."""
    if not cols:
        return {}
    sets = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in cols]).first()
    return {c: list(sets[c]) for c in cols}


def indexed(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns of any number of values as one sparse 0/1 vector each
    (``<c>_vector``; NULL and the last value of the order give zeros)."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    index = [f"_i_{c}" for c in cols]
    out = StringIndexer(inputCols=cols, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc").fit(df).transform(df)
    return OneHotEncoder(inputCols=index, outputCols=[f"{c}_vector" for c in cols]).fit(out).transform(out).drop(*index, *cols)


def dummies(df: DataFrame, cols: list[str], values: dict[str, list] | None = None) -> DataFrame:
    """One 0/1 column ``<c>_<value>`` per value (NULL -> all 0); the
    source columns are replaced, as ``get_dummies`` does."""
    cols = [c for c in cols if c in df.columns]
    values = values or dummy_values(df, cols)
    keep = [F.col(c) for c in df.columns if c not in cols]
    new = [F.when(F.col(c) == F.lit(v), 1).otherwise(0).alias(f"{c}_{v}") for c in cols for v in values[c]]
    return df.select(*keep, *new)


def fit_standard(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (NULLs skipped)."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"], row[f"s_{i}"]) for i, c in enumerate(cols)}


def apply_standard(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[(F.try_divide(F.col(c) - F.lit(stats[c][0]), F.lit(stats[c][1])).alias(c)
                        if c in stats else F.col(c)) for c in df.columns])


def standardize(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """``(x - mean) / std`` with the population std, each column on
    its own non-NULL values; NULL stays NULL. ``fit_on`` fits on another frame
    (e.g. the training split) instead of all rows."""
    cols = [c for c in cols if c in df.columns]
    return apply_standard(df, fit_standard(fit_on if fit_on is not None else df, cols))


def fit_shared(df: DataFrame, cols: list[str]) -> tuple[float, float]:
    """E03 fit: one mean/std over all values of all ``cols`` together."""
    long = df.select(F.explode(F.array(*[F.col(c).cast("double") for c in cols])).alias("_x"))
    m, s = long.agg(F.avg("_x"), F.stddev_pop("_x")).first()
    return m, s


def standardize_shared(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Every column of ``cols`` scaled with the shared mean/std."""
    cols = [c for c in cols if c in df.columns]
    if not cols:
        return df
    m, s = fit_shared(fit_on if fit_on is not None else df, cols)
    return apply_standard(df, {c: (m, s) for c in cols})


def fit_together(df: DataFrame, categories: list[str], scaled: list[str], shared: list[str], inside: Column) -> tuple[dict[str, list], dict[str, tuple[float, float]]]:
    """E01, E02 and E03 in one pass: the categories' values (of all rows), and mean and population std of each scaled column
    and of all shared ones together (of the rows ``inside``)."""
    part = [F.when(inside, F.col(c).cast("double")) for c in [*scaled, *shared]]
    aggs = [f(x).alias(f"{n}{i}") for i, x in enumerate(part) for n, f in (("n", F.count), ("m", F.avg), ("s", F.stddev_pop))]
    aggs += [F.sort_array(F.collect_set(c)).alias(f"v{i}") for i, c in enumerate(categories)]
    if not aggs:
        return {}, {}
    row = df.agg(*aggs).first()
    stats = {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(scaled)}
    own = [(row[f"n{i}"], row[f"m{i}"], row[f"s{i}"]) for i in range(len(scaled), len(part)) if row[f"n{i}"]]
    if own:
        n = sum(k for k, _, _ in own)
        mean = sum(k * m for k, m, _ in own) / n
        std = math.sqrt(sum(k * (s * s + (m - mean) ** 2) for k, m, s in own) / n)
        stats.update({c: (mean, std) for c in shared})
    else:
        stats.update({c: (None, None) for c in shared})
    return {c: list(row[f"v{i}"]) for i, c in enumerate(categories)}, stats


def mean_range_normalize(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(x - mean) / (max - min)``."""
    row = df.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[(F.max(c) - F.min(c)).alias(f"r_{i}") for i, c in enumerate(cols)]).first()
    st = {c: (row[f"m_{i}"], row[f"r_{i}"]) for i, c in enumerate(cols)}
    return apply_standard(df, st)


def min_max_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(x - min) / (max - min)``."""
    row = df.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(cols)],
                 *[(F.max(c) - F.min(c)).alias(f"r_{i}") for i, c in enumerate(cols)]).first()
    return apply_standard(df, {c: (row[f"lo_{i}"], row[f"r_{i}"]) for i, c in enumerate(cols)})


def one_hot_label(df: DataFrame, label: str = "label", n_classes: int = 3) -> DataFrame:
    """``<label>_<k>`` 0/1 columns."""
    return df.select("*", *[F.when(F.col(label) == k, 1).otherwise(0).alias(f"{label}_{k}") for k in range(n_classes)])


def balanced_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """``n / (k * count(class))`` as a column; the per-class counts are
    an aggregate (one row per class) joined back."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    n, k = counts.agg(F.sum("_c"), F.count(F.lit(1))).first()
    cw = counts.select(label, (F.lit(float(n)) / (F.lit(k) * F.col("_c"))).alias(weight))
    return df.join(cw, label, "left")  # one row per class; AQE broadcasts it from runtime size


def assemble(df: DataFrame, cols: list[str], out: str = "features", handle_invalid: str = "error") -> DataFrame:
    """Feature vector (double)."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid=handle_invalid).transform(df)


def pca_table(df: DataFrame, cols: list[str], k: int | None = None) -> DataFrame:
    """Principal components of ``cols``: (component, explained_variance).
    The covariance is aggregated on the executors; only the small k x k
    result reaches the driver."""
    from pyspark.ml.feature import PCA
    k = k or len(cols)
    vec = assemble(df.select(*cols), cols, "_f")
    model = PCA(k=k, inputCol="_f", outputCol="_pc").fit(vec)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    return df.sparkSession.createDataFrame([(i + 1, v) for i, v in enumerate(ev)],
                                           "component int, explained_variance double")
