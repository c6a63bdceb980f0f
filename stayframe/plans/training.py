"""Training-set preparation and the model study (the dense path and the
null-kept path), composed from the operators.

Driver-side values here are column lists, per-column scalars (rates, means,
stds) and the bounded category lists of the dummy columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe import presets as P
from stayframe.functions.recode import dict_recode, keep_list, stringify_null, substring_recode
from stayframe.operators import clean as CL
from stayframe.operators import encode as EN
from stayframe.operators import model as M
from stayframe.operators import split as SP
from stayframe.session import ensure_checkpoint_dir, stage_path

ROW_KEY = "row_key"


def add_row_key(df: DataFrame, col: str = ROW_KEY) -> DataFrame:
    """A content hash used as the split key (repeatable, no global row number)."""
    return df.withColumn(col, F.md5(F.to_json(F.struct(*[F.col(c) for c in df.columns]))))


def drop_ids(df: DataFrame) -> DataFrame:
    """Drop id columns (names containing ``_id``), keeping the row key."""
    return df.drop(*[c for c in df.columns if "_id" in c and c != ROW_KEY])


def recode_categories(df: DataFrame, ethnicity_map: dict = P.ETHNICITY_GROUPS, nan_text: bool = False) -> DataFrame:
    """Ethnicity groups; diagnosis substring recodes then keep-list."""
    out = df
    if "ethnicity" in out.columns:
        out = out.withColumn("ethnicity", dict_recode("ethnicity", ethnicity_map))
    if "diagnosis" in out.columns:
        d = stringify_null("diagnosis") if nan_text else F.col("diagnosis")
        out = out.withColumn("diagnosis", keep_list(substring_recode(d, P.DIAGNOSIS_SUBSTRING_RECODES),
                                                    P.DIAGNOSES_KEPT))
    return out


def prepare_dense(df: DataFrame, max_missing: float = P.MAX_MISSING, fit_on_split: bool = False,
                  seed: int = P.SEED_SPLIT) -> DataFrame:
    """Dense path: ids dropped, sparse columns dropped, rows with any NULL or
    NaN dropped, categories recoded and dummy-encoded, open-range outliers
    dropped, numerics standardised one by one and delays with one shared
    scaler: fitted on all rows, as in the study, or (``fit_on_split``, Q12) on
    the training part of the split, whose column ``split`` is then added."""
    df = CL.nan_to_null(df)
    _, sparse = CL.drop_sparse_columns(drop_ids(df), max_missing)
    df = recode_categories(CL.drop_null_rows(drop_ids(add_row_key(df)).drop(*sparse)))
    categories, scaled, delays = ([c for c in cols if c in df.columns] for cols in (P.DUMMY_COLUMNS, P.NUMERIC_SCALED, [c for c in df.columns if "_delay" in c]))
    if fit_on_split:
        # recoded once; the counts of the split, the moments and the result read that
        df = _written(df)
        df = CL.range_filter(EN.dummies(df, categories), P.FEATURE_RANGES)
        df = SP.split_at_cuts(df, "label", [ROW_KEY], seed=seed)
        _, stats = EN.fit_together(df.where(F.col("split") == "hyperopt"), [], scaled, delays, F.lit(True))
        return EN.apply_standard(df, stats)
    # recoded once; the values and all moments come from one pass over that
    ensure_checkpoint_dir(df.sparkSession)
    df = df.checkpoint()
    values, stats = EN.fit_together(df, categories, scaled, delays, CL.in_ranges(df, P.FEATURE_RANGES))
    return EN.apply_standard(CL.range_filter(EN.dummies(df, categories, values), P.FEATURE_RANGES), stats)


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder, whose scans read the columns they need."""
    path = stage_path(df.sparkSession, f"prepared-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare_with_nulls(df: DataFrame) -> DataFrame:
    """Null-kept path: empty columns dropped, NULL diagnosis as text ``nan``
    (then OTHER), null-tolerant outlier filter, null-aware scaling."""
    df = drop_ids(add_row_key(CL.nan_to_null(df)))
    df, _ = CL.drop_empty_columns(df)
    df = recode_categories(df, nan_text=True)
    df = EN.dummies(df, [c for c in P.DUMMY_COLUMNS if c in df.columns])
    df = CL.range_filter(df, P.FEATURE_RANGES, keep_null=True)
    df = EN.standardize(df, [c for c in P.NUMERIC_SCALED_WITH_NULLS if c in df.columns])
    return EN.standardize_shared(df, [c for c in df.columns if "_delay" in c])


def model_input(df: DataFrame, seed: int = P.SEED_SPLIT, folds: int = 3, with_nulls: bool = False) -> DataFrame:
    """Split (80/10/10 stratified), fold column, ``features`` vector and a
    double ``label``; the null-kept path leaves assembling to ``WithMissing``."""
    df = df.withColumn("label", F.col("label").cast("double"))
    if "split" not in df.columns:
        df = SP.stratified_split(df, "label", [ROW_KEY], seed=seed)
    df = SP.kfold(df, "label", [ROW_KEY], seed=seed, k=folds)
    feats = [c for c in df.columns if c not in (ROW_KEY, "label", "split", "fold")]
    if not with_nulls:
        df = EN.assemble(df, feats)
    return df


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW_KEY, "label", "split", "fold", "features")]


def run_study(data: DataFrame, registry: dict[str, M.Spec], metric: str = "accuracy"):
    """Grid search on hyperopt folds, compare table (fit hyperopt,
    score compare) and generalisation table (fit hyperopt+compare, score
    test). Returns (grid table, compare, generalisation)."""
    spark = data.sparkSession
    ensure_checkpoint_dir(spark)
    data = data.checkpoint()
    hyper = data.where(F.col("split") == "hyperopt")
    found = M.grid_search_all(registry, hyper, "fold", metric)
    best = {name: b for name, (b, _) in found.items()}
    grids = [M.grid_table(spark, name, table) for name, (_, table) in found.items()]
    grid = grids[0]
    for g in grids[1:]:
        grid = grid.unionByName(g)
    comp = M.compare_table(spark, registry, best, hyper, data.where(F.col("split") == "compare"))
    test = M.compare_table(spark, registry, best, data.where(F.col("split").isin("hyperopt", "compare")),
                           data.where(F.col("split") == "test"))
    return grid, comp, M.generalisation_table(comp, test)
