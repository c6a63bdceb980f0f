"""Column profiler and frequency tables.

The profile is two passes: one aggregate over all columns (type, count,
missing, distinct, median, mean, min, max), then one pass over the unpivoted
(column, value) pairs for frequencies; histograms add one binning pass per
numeric column set.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayframe.operators.clean import NUMERIC, nan_to_null


QUANTILE_BINS = 1024


def finite(c: str) -> Column:
    """The column as a double, NULL where it is NaN (missing, as in pandas)."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def _bin(x: Column, lo: float, hi: float) -> Column:
    """Monotone bin number of ``x`` in [lo, hi], at least two bins when lo < hi:
    infinities and signs first, then equal widths, on a log scale where the
    magnitudes differ much (so the number of levels is bounded)."""
    inf = float("inf")
    if lo == -inf or hi == inf:
        return F.when(x == -inf, 0).when(x == inf, 2).otherwise(1)
    if lo < 0 < hi or lo == 0 < hi or lo < 0 == hi:
        return F.when(x < 0, 0).when(x == 0, 1).otherwise(2)
    if lo < 0:
        return F.lit(QUANTILE_BINS) - _bin(-x, -hi, -lo)
    if hi / lo > 1e6:
        top = math.log(hi) - math.log(lo)
        return F.least(F.floor((F.log(x) - F.lit(math.log(lo))) / F.lit(top / QUANTILE_BINS)), F.lit(QUANTILE_BINS - 1)).cast("int")
    return F.when(x == hi, QUANTILE_BINS).otherwise(F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(QUANTILE_BINS))), F.lit(QUANTILE_BINS - 1))).cast("int")


def exact_quantiles(df: DataFrame, cols: list[str], q: float = 0.5) -> dict[str, float | None]:
    """Exact quantile (linear interpolation, as ``percentile`` / DuckDB
    ``quantile_cont``) of each column's non-missing values (NaN is missing),
    without gathering a column's values in one task. Each level is one job for
    all columns: the values inside every open range are counted in at most
    1,025 bins, and the bin with the wanted rank is the next range, until its
    smallest and largest value are equal. The number of jobs does not grow with
    the number of columns or rows."""
    stats = df.agg(*[f(finite(c)).alias(f"{n}_{i}") for i, c in enumerate(cols) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    found: dict[tuple, float] = {}
    todo, pos = {}, {}
    for i, c in enumerate(cols):
        n, lo, hi = stats[f"n_{i}"], stats[f"lo_{i}"], stats[f"hi_{i}"]
        if not n:
            continue
        pos[c] = (n - 1) * q
        for k in {math.floor(pos[c]), math.ceil(pos[c])}:
            if lo == hi:
                found[c, k] = lo
            else:
                todo[c, k] = (lo, hi, 0)
    while todo:
        ranges = list(todo.items())
        tags = []
        for i, ((c, _), (lo, hi, _)) in enumerate(ranges):
            x = finite(c)
            tags.append(F.when((x >= lo) & (x <= hi), F.struct(F.lit(i).alias("i"), _bin(x, lo, hi).alias("b"), x.alias("x"))))
        tagged = df.select(F.explode(F.array_compact(F.array(*tags))).alias("t"))
        counts = tagged.groupBy("t.i", "t.b").agg(F.count(F.lit(1)).alias("n"), F.min("t.x").alias("lo"), F.max("t.x").alias("hi")).collect()
        by_range: dict[int, list] = {}
        for r in counts:
            by_range.setdefault(r.i, []).append(r)
        for i, ((c, k), (_, _, skip)) in enumerate(ranges):
            del todo[c, k]
            for r in sorted(by_range[i], key=lambda r: r.b):
                if skip + r.n > k:
                    if r.lo == r.hi:
                        found[c, k] = r.lo
                    else:
                        todo[c, k] = (r.lo, r.hi, skip)
                    break
                skip += r.n
    out: dict[str, float | None] = dict.fromkeys(cols)
    for c, at in pos.items():
        a, b = found[c, math.floor(at)], found[c, math.ceil(at)]
        x = a if a == b else a + (at - math.floor(at)) * (b - a)
        out[c] = None if math.isnan(x) else x   # above -inf there is no value in between
    return out


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    """(value, count) by descending count, then value."""
    src = df.where(F.col(col).isNotNull()) if dropna else df
    return src.groupBy(col).agg(F.count(F.lit(1)).alias("count")) \
              .orderBy(F.desc("count"), F.asc_nulls_first(col))


def class_proportions(df: DataFrame, col: str) -> DataFrame:
    """Share of each value (count over the total, a scalar pass)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    total = df.count()
    return counts.select(col, "count", (F.col("count") / F.lit(total)).alias("share"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row (column, nulls) per column plus the total as ``__total__``."""
    row_df = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = row_df.unpivot([], df.columns, "column", "nulls")
    total = row_df.select(F.lit("__total__").alias("column"),
                          sum(F.col(c) for c in df.columns).alias("nulls"))
    return long.unionByName(total)


def missing_rate_table(df: DataFrame) -> DataFrame:
    """(column, missing_rate)."""
    row_df = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return row_df.unpivot([], df.columns, "column", "missing_rate")


def distinct_count(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    """Number of distinct non-NULL values (exact; HLL when ``approx``)."""
    f = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(f(F.col(col)).alias("n_distinct"))


#: A column with about so many distinct values, or fewer, is counted as one set per task.
SET_VALUES = 10_000


def distinct_counts(df: DataFrame, cols: list[str], about: dict[str, int]) -> dict[str, int]:
    """Exact numbers of distinct non-NULL values of many columns, given estimates (``approx_count_distinct``). No row is
    copied per column: columns of few values are sets, all in one aggregation; each of the others is a plain
    distinct of that column alone (its scan reads nothing else), all in one job."""
    kinds = dict(df.dtypes)
    value = lambda c: F.col(c) + F.lit(0).cast(kinds[c]) if kinds[c] in ("float", "double") else F.col(c)  # noqa: E731  (-0.0 is 0.0)
    few = [c for c in cols if about[c] <= SET_VALUES]
    out = {}
    if few:
        row = df.agg(*[F.size(F.collect_set(value(c))).alias(str(i)) for i, c in enumerate(few)]).first()
        out = {c: row[i] for i, c in enumerate(few)}
    many = [c for c in cols if c not in out]
    if many:
        counts = [df.select(value(c).alias("v")).where("v is not null").groupBy("v").agg(F.lit(i).alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")) for i, c in enumerate(many)]
        out.update({c: 0 for c in many})
        out.update({many[r["i"]]: r["n"] for r in reduce(lambda a, b: a.unionByName(b), counts).collect()})
    return out


def numeric_summary(df: DataFrame, cols: list[str], exact_median: bool = True) -> DataFrame:
    """A10: one row per column: median, mean, min, max. The exact median is
    found by distributed bin refinement (``exact_quantiles``); the approximate
    one by ``percentile_approx``."""
    row = df.agg(*[F.avg(finite(c)).alias(f"{c}__mean") for c in cols], *[F.min(finite(c)).alias(f"{c}__min") for c in cols],
                 *[F.max(finite(c)).alias(f"{c}__max") for c in cols],
                 *([] if exact_median else [F.percentile_approx(finite(c), 0.5).alias(f"{c}__med") for c in cols]))
    meds = exact_quantiles(df, cols) if exact_median else None
    structs = [F.struct(F.lit(c).alias("column"),
                        (F.lit(meds[c]).cast("double") if meds is not None else F.col(f"{c}__med")).alias("median"),
                        F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__min").alias("min"),
                        F.col(f"{c}__max").alias("max")) for c in cols]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def mode(df: DataFrame, col: str) -> DataFrame:
    """Most frequent non-NULL value; ties go to the smallest value. The
    pick is an aggregation over (value, count) rows (combined map-side), not a
    map of all values in one buffer."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    best = counts.agg(F.min(F.struct((-F.col("count")).alias("neg"), F.col(col).alias("v"))).alias("m"))
    return best.where(F.col("m").isNotNull()).select(F.col("m.v").alias("mode"), (-F.col("m.neg")).alias("count"))


def top_values(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values (TakeOrderedAndProject)."""
    return value_counts(df, col).limit(k)


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins of the non-missing values (NaN is missing): (bin
    1..bins, lo, hi, count). The range is that of the finite values; -inf and inf
    count in the first and the last bin. Pass 1 finds min/max (two scalars),
    pass 2 bins and counts."""
    x = finite(col)
    inside = F.when(F.abs(x) != float("inf"), x)
    lo, hi, n = df.agg(F.min(inside), F.max(inside), F.count(x)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count long")
    lo, hi = (0.0, 0.0) if lo is None else (lo, hi)
    width = hi / bins - lo / bins if hi > lo else 1.0
    b = (F.when(x == float("inf"), bins).when(x == -float("inf"), 1)
         .otherwise(F.least(F.floor((x - F.lit(lo)) / F.lit(width)) + 1, F.lit(bins))).cast("int"))
    return (df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
                    (F.lit(lo) + F.col("bin") * F.lit(width)).alias("hi"), "count").orderBy("bin"))


def category_counts(df: DataFrame, col: str, max_categories: int = 50, k: int = 10) -> DataFrame:
    """Full counts when there are fewer than ``max_categories``
    distinct values, else the ``k`` most frequent."""
    n = df.agg(F.count_distinct(col)).first()[0]
    return value_counts(df, col) if n < max_categories else top_values(df, col, k)


def mean_std(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and sample std per column (the ``describe`` rows)."""
    row_df = df.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols], *[F.stddev_samp(c).alias(f"{c}__std") for c in cols])
    return row_df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__mean").alias("mean"),
                                                        F.col(f"{c}__std").alias("std")) for c in cols])).alias("r")) \
                 .select("r.*")


def profile(df: DataFrame, truncate: bool = False, approx_distinct: bool = False,
            exact_median: bool = True) -> DataFrame:
    """One row per column: type, n, missing %, distinct, verdict
    (``empty`` / ``useless`` / ``ok``), numeric stats, and the mode of
    non-numeric columns. Distinct counts are exact (``distinct_counts``);
    ``approx_distinct=True`` leaves them at the HLL sketches' estimates. NaN is
    missing."""
    df = nan_to_null(df)
    fields = df.schema.fields
    numeric = [f.name for f in fields if isinstance(f.dataType, NUMERIC)]
    aggs = [F.count(F.lit(1)).alias("__n")]
    for f in fields:
        c = f.name
        aggs += [F.count(c).alias(f"{c}__nn"), F.approx_count_distinct(c).alias(f"{c}__nd")]
        if c in numeric:
            aggs += [F.avg(c).alias(f"{c}__mean"),
                     F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
            if not exact_median:
                aggs.append(F.percentile_approx(c, 0.5).cast("double").alias(f"{c}__med"))
    one = df.agg(*aggs)
    row = one.first()
    one = df.sparkSession.createDataFrame([row], one.schema)
    if not approx_distinct:
        names = [f.name for f in fields]
        exact = distinct_counts(df, names, {c: row[f"{c}__nd"] for c in names})
        one = one.withColumns({f"{c}__nd": F.lit(exact[c]).cast("long") for c in names})
    meds = exact_quantiles(df, numeric) if (numeric and exact_median) else {}
    modes = _modes(df, [f.name for f in fields if f.name not in numeric])
    rows = []
    for f in fields:
        c = f.name
        num = c in numeric
        st = (lambda s: F.col(f"{c}__{s}").cast("long").cast("double")) if truncate else (lambda s: F.col(f"{c}__{s}"))
        rows.append(F.struct(
            F.lit(c).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
            (100.0 * (F.col("__n") - F.col(f"{c}__nn")) / F.col("__n")).alias("missing_pct"),
            F.col(f"{c}__nd").alias("n_distinct"),
            F.when(F.col(f"{c}__nn") == 0, "empty").when(F.col(f"{c}__nd") == 1, "useless")
             .otherwise("ok").alias("verdict"),
            (_trunc(F.lit(meds.get(c)).cast("double") if exact_median else F.col(f"{c}__med"), truncate)
             if num else F.lit(None).cast("double")).alias("median"),
            (st("mean") if num else F.lit(None).cast("double")).alias("mean"),
            (st("min") if num else F.lit(None).cast("double")).alias("min"),
            (st("max") if num else F.lit(None).cast("double")).alias("max"),
            (F.lit(None).cast("string") if num else F.lit(modes.get(c)).cast("string")).alias("mode")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _trunc(c, truncate: bool):
    return c.cast("long").cast("double") if truncate else c


def _modes(df: DataFrame, cols: list[str]) -> dict:
    """Mode of several columns in one pass over (column, value) pairs: counts
    per pair, then the (most frequent, smallest) value per column by an
    aggregation over the counts."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                         for c in cols])).alias("r")).select("r.c", "r.v").where(F.col("v").isNotNull())
    counts = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("v"))).alias("m"))
    return {r.c: r.m.v for r in best.collect()}
