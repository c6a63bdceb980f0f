"""Build the labelled forecasting dataset (cohort -> as-of features ->
static attributes -> singletons/dedupe -> night labels).

Shuffle budget at scale: the stay table and its attributes are small next to
the events; the events are read once per role (anchors, features) with the
item filter pushed into the scan; the as-of step shuffles the tagged feature
events once on (subject, feature, bucket); everything after works on anchor
rows (one per stay x anchor time).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayframe.operators import asof as A
from stayframe.operators import cohort as C
from stayframe.operators.clean import drop_columns, drop_matching, nan_to_null
from stayframe.operators.label import add_labels
from stayframe.operators.offsets import drop_singletons


@dataclass
class Tables:
    """The clinical tables (any source: catalog, parquet, JDBC)."""
    icustays: DataFrame
    chartevents: DataFrame
    patients: DataFrame
    rrt: DataFrame
    diagnoses_icd: DataFrame
    admissions: DataFrame


@dataclass
class Params:
    anchor_item: object
    excluded_codes: list
    features: dict                    # feature -> list of item ids
    min_age: float = 15.0
    min_stay_hours: float = 48.0
    label_band: float = 0.15
    hours: tuple = (0, 5)
    keep_flagged: bool = False        # Q1
    as_coded: bool = False            # Q2
    admission_match: str = "admission"  # Q3
    bucket_us: int = A.DEFAULT_BUCKET_US
    hot_rows: int | None = A.DEFAULT_HOT_ROWS   # cut time buckets holding more rows than this
    materialize: bool = True          # checkpoint the cohort and the merged stage


ANCHOR_ID = ["icustay_id", "creatinine_time"]


def included_cohort(t: Tables, p: Params) -> DataFrame:
    co = C.cohort(t.icustays, nan_to_null(t.chartevents), t.patients, t.rrt, t.diagnoses_icd, anchor_item=p.anchor_item,
                  excluded_codes=p.excluded_codes, min_age=p.min_age, min_stay_hours=p.min_stay_hours,
                  keep_flagged=p.keep_flagged, with_codes=False)
    return C.apply_inclusion(co)


def feature_events(t: Tables, p: Params) -> DataFrame:
    """Chart events of the spec items, tagged with their feature. The spec is
    tiny and fixed, so it becomes an ``isin`` filter pushed to the scan plus a
    map lookup, not a join."""
    item_to_feature = {i: f for f, items in p.features.items() for i in items}
    ev = nan_to_null(t.chartevents).where(F.col("itemid").isin(list(item_to_feature)) & F.col("valuenum").isNotNull())
    m = F.create_map(*[x for kv in item_to_feature.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return ev.withColumn("feature", m[F.col("itemid")])


def feature_table(cohort: DataFrame, t: Tables, p: Params, staged: bool = False) -> DataFrame:
    """Wide table of every feature for every anchor, in one pass. The
    cohort is written first (unless it is ``staged``), not computed by each branch."""
    feats = list(p.features)
    cohort = cohort if staged else _stage(cohort, p)
    long = A.asof_latest(cohort, feature_events(t, p), key=["subject_id"], anchor_id=ANCHOR_ID,
                         anchor_time="creatinine_time", event_time="storetime", value_col="valuenum",
                         item_col="itemid", tiebreak="event_id", lower_bound="intime", feature_col="feature",
                         features=feats, how="left", bucket_us=p.bucket_us, hot_rows=p.hot_rows,
                         materialize=p.materialize)
    if p.as_coded:
        long = A.asof_as_coded(long.where(F.col("value").isNotNull()), "creatinine_time")
    return A.pivot_features(long, ANCHOR_ID, feats, require_any=True)


def merged_table(t: Tables, p: Params) -> DataFrame:
    """J11 + P10/P11 + A03 + P09: features and static attributes on the same
    anchors, helper columns dropped, singleton stays dropped, one row per
    (stay, anchor time)."""
    co = _stage(included_cohort(t, p), p)
    wide = feature_table(co, t, p, staged=True)
    static = C.attach_admission(co, t.admissions, t.patients, p.admission_match)
    static_keys = static.select(*ANCHOR_ID, "ethnicity", "diagnosis", "gender", F.lit(True).alias("_st"))
    if p.admission_match == "subject":
        # the fan-out leaves one row per admission; keep one per anchor
        static_keys = C.keep_first(static_keys, ANCHOR_ID, ["ethnicity", "diagnosis", "gender"])
    # full outer merge of features and statics on the anchor == anchors of the
    # cohort found by either side
    m = (co.join(wide, ANCHOR_ID, "left").join(static_keys, ANCHOR_ID, "left")
         .where(F.col("_st").isNotNull() | _any_found(p)).drop("_st"))
    m = drop_columns(m, ["intime", "outtime", "length_of_stay", "rrt", "diagnoses", "hadm_id"])
    m = drop_matching(m, "_time", keep=("creatinine_time",))
    m = drop_matching(m, "_itemid")
    m = _stage(m, p)
    m = drop_singletons(m, "icustay_id")
    return C.keep_first(m, ANCHOR_ID, [-F.col("anchor_event_id")]).drop("anchor_event_id")


def _stage(df: DataFrame, p: Params) -> DataFrame:
    """Stage boundary: the frame is used by several branches downstream, so it
    is written once to the shared checkpoint folder (``spark.checkpoint.dir``)
    instead of being recomputed per branch; the write also cuts the lineage."""
    if not p.materialize:
        return df
    from stayframe.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _any_found(p: Params):
    cond = F.lit(False)
    for f in p.features:
        cond = cond | F.col(f"{f}_delay").isNotNull()
    return cond


def labelled_dataset(t: Tables, p: Params) -> DataFrame:
    """The final table: merged rows of night anchors with yesterday / day
    before values and the label; unlabelled rows dropped."""
    return add_labels(merged_table(t, p), band=p.label_band, hours=p.hours, bucket_us=p.bucket_us,
                      hot_rows=p.hot_rows, materialize=p.materialize)


def clinical_params(spark, spec_path: str | None = None, **overrides) -> Params:
    """Parameters of the study on the clinical tables: anchor item, excluded
    codes, thresholds, label band and the feature spec (from ``spec_path`` or
    the built-in copy), all from ``presets``."""
    from stayframe import presets as P
    from stayframe.sources.tables import load_feature_spec, spec_items
    spec = load_feature_spec(spark, path=spec_path) if spec_path else load_feature_spec(spark, csv_text=P.FEATURE_SPEC_CSV)
    kw = dict(anchor_item=P.ANCHOR_ITEM, excluded_codes=P.EXCLUDED_CODES, features=spec_items(spec),
              min_age=P.MIN_AGE_YEARS, min_stay_hours=P.MIN_STAY_HOURS, label_band=P.LABEL_BAND,
              hours=P.ANCHOR_HOURS)
    kw.update(overrides)
    return Params(**kw)
