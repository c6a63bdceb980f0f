"""Types of undeclared text columns, found in one pass, and the rows that do not fit them.

Every column's texts are counted against each type of a lattice, from the narrowest: boolean, bigint, double, date, timestamp,
string. The counts of parts of a table add up to those of the whole, so one aggregation (combined map-side, one row per
task) decides all columns. A column gets the narrowest type that all of its texts fit, or all but a share ``max_bad`` of them;
empty texts are missing values and fit any type; a column of missing values only is a string.
Texts that do not fit become NULL and are reported with their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(nan|inf|infinity)\s*$"
LATTICE = ("boolean", "bigint", "double", "date", "timestamp_ntz")


def parsed(text: Column, kind: str) -> Column:
    """``text`` as a value of ``kind``, NULL where it does not fit."""
    if kind == "boolean":
        return F.when(F.lower(F.trim(text)) == "true", True).when(F.lower(F.trim(text)) == "false", False)
    if kind == "bigint":
        return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("bigint"))
    if kind == "double":
        return F.when(F.lower(text).rlike(NUMBER), F.trim(text).try_cast("double"))
    if kind == "date":
        return F.when(text.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s*$"), F.trim(text).try_cast("date"))
    if kind == "timestamp_ntz":
        return F.when(text.rlike(r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}.*)?\s*$"), F.trim(text).try_cast("timestamp_ntz"))
    return text


def _given(c: str) -> Column:
    return F.when(F.trim(F.col(c)) != "", F.col(c))


def infer_types(df: DataFrame, max_bad: float = 0.0) -> DataFrame:
    """(column, type, n, n_bad) of the text columns of ``df``: n texts are given, n_bad do not fit the type."""
    aggs = []
    for i, c in enumerate(df.columns):
        aggs.append(F.count(_given(c)).alias(f"n_{i}"))
        aggs += [F.count_if(_given(c).isNotNull() & parsed(_given(c), t).isNull()).alias(f"bad_{i}_{t}") for t in LATTICE]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(df.columns):
        n = row[f"n_{i}"]
        fits = [t for t in LATTICE if n and row[f"bad_{i}_{t}"] <= max_bad * n]
        kind = fits[0] if fits else "string"
        out.append((c, kind, n, row[f"bad_{i}_{kind}"] if fits else 0))
    return df.sparkSession.createDataFrame(out, "column string, type string, n bigint, n_bad bigint")


def typed(df: DataFrame, types: DataFrame) -> DataFrame:
    """The columns in their types, and ``_bad``: the names of the columns whose text does not fit."""
    kinds = {r["column"]: r["type"] for r in types.collect()}  # one row per column
    values = [parsed(_given(c), kinds[c]).alias(c) for c in df.columns]
    bad = [F.when(_given(c).isNotNull() & parsed(_given(c), kinds[c]).isNull(), F.lit(c)) for c in df.columns if kinds[c] != "string"]
    return df.select(*values, F.array_compact(F.array(*bad) if bad else F.array().cast("array<string>")).alias("_bad"))


def read_undeclared_csv(spark: SparkSession, path: str, max_bad: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(typed rows with ``_bad``, inferred types) of a CSV with a header and no declared schema."""
    text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    types = infer_types(text, max_bad)
    return typed(text, types), types
