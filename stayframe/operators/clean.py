"""Column and row cleaning.

Column decisions (sparse / empty columns) need one aggregate pass whose
result is one number per column; the rows never leave the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """P10: drop the listed columns that exist."""
    return df.drop(*[c for c in names if c in df.columns])


def drop_matching(df: DataFrame, contains: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drop columns whose name contains ``contains`` (except ``keep``)."""
    return df.drop(*[c for c in df.columns if contains in c and c not in keep])


def select_matching(df: DataFrame, contains: str) -> list[str]:
    """Names of the columns whose name contains ``contains``."""
    return [c for c in df.columns if contains in c]


def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL in ``subset`` (all columns by default)."""
    return df.dropna(how="any", subset=subset)


def missing_rates(df: DataFrame, cols: list[str] | None = None) -> dict[str, float]:
    """A08 as driver scalars: one aggregate pass, one number per column."""
    cols = cols or df.columns
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return {c: (row[c] if row[c] is not None else 0.0) for c in cols}


def drop_sparse_columns(df: DataFrame, max_missing: float = 0.3) -> tuple[DataFrame, list[str]]:
    """Drop columns whose missing rate is strictly above ``max_missing``."""
    rates = missing_rates(df)
    sparse = [c for c, r in rates.items() if r > max_missing]
    return df.drop(*sparse), sparse


def drop_empty_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Drop columns with no value at all; returns the dropped names."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    empty = [c for c in df.columns if row[c] == 0]
    return df.drop(*empty), empty


def in_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]], keep_null: bool = False) -> Column:
    """Whether ``lo < x < hi`` (strict) for each listed column that exists (or, ``keep_null``, NULL)."""
    conds = [F.lit(True)]
    for c, (lo, hi) in ranges.items():
        if c in df.columns:
            inside = (F.col(c) > lo) & (F.col(c) < hi)
            conds.append((inside | F.col(c).isNull()) if keep_null else F.coalesce(inside, F.lit(False)))
    return reduce(lambda a, b: a & b, conds)


def range_filter(df: DataFrame, ranges: dict[str, tuple[float, float]], keep_null: bool = False) -> DataFrame:
    """P17 (``keep_null=False``) / P18: keep ``lo < x < hi`` (strict) for each
    listed column that exists; NULL is kept only in the null-tolerant form."""
    return df.where(in_ranges(df, ranges, keep_null))


def one_sided_filter(df: DataFrame, rules: list[tuple[str, str, float]]) -> DataFrame:
    """``(column, '<' or '>', limit)`` rules, strict."""
    conds = [(F.col(c) < v) if op == "<" else (F.col(c) > v) for c, op, v in rules if c in df.columns]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def finite_filter(df: DataFrame, cols: list[str]) -> DataFrame:
    """P20: numeric columns must be finite (not NULL, NaN or +-inf); other
    columns must be non-NULL."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    conds = []
    for c in cols:
        if isinstance(types[c], NUMERIC):
            x = F.col(c).cast("double")
            conds.append(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        else:
            conds.append(F.col(c).isNotNull())
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise NaN to NULL once at ingest (pandas treats both as missing)."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast(types[c])).alias(c)
                       if isinstance(types[c], (T.FloatType, T.DoubleType)) else F.col(c) for c in df.columns])


def size_report(df: DataFrame) -> DataFrame:
    """One row (n_rows, n_cols)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).alias("n_cols"))
