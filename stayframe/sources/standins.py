"""Driver tables in clinical roles.

The clinical tables are not available, so the pipeline is exercised on the
driver's tables, each derived by Spark from them (no fixed small input):

* chartevents  <- events (user_id, event_type as item, ts as storetime, value)
* icustays     <- events: one stay per (user, 10-day bucket from 2024-01-01),
                  intime/outtime = first/last event of the bucket
* patients     <- customer; dob = first order date, gender from account balance
* rrt          <- stays of customers in the MACHINERY segment
* diagnoses    <- orders: one code (o_orderpriority) per order
* admissions   <- customer x nation: ethnicity = nation name, diagnosis = segment
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayframe.functions.time import DAY_US, epoch_us
from stayframe.sources.tables import read_table

STAY_DAYS = 10
STAY_ORIGIN = "2024-01-01 00:00:00"

# Stand-in parameters (the clinical values are in presets.py).
ANCHOR_ITEM = "purchase"
EXCLUDED_CODES = ["1-URGENT"]
MIN_STAY_HOURS = 192.0
MIN_AGE_YEARS = 15.0
LABEL_BAND = 20.0
FEATURES = {"browse": ["click", "view"], "error": ["error"], "signup": ["signup"]}


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, name, sf_dir)


def chartevents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("user_id").alias("subject_id"), F.col("event_type").alias("itemid"),
        F.col("value").alias("valuenum"), F.col("ts").alias("storetime"))


def icustays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = t(spark, sf_dir, "events")
    origin = epoch_us(F.lit(STAY_ORIGIN).cast("timestamp_ntz"))
    bucket = F.floor((epoch_us("ts") - origin) / F.lit(STAY_DAYS * DAY_US)).cast("long")
    return (ev.groupBy(F.col("user_id").alias("subject_id"), bucket.alias("bucket"))
            .agg(F.min("ts").alias("intime"), F.max("ts").alias("outtime"))
            .select("subject_id", F.col("subject_id").alias("hadm_id"),
                    (F.col("subject_id") * 100 + F.col("bucket")).alias("icustay_id"), "intime", "outtime"))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = t(spark, sf_dir, "customer")
    first_order = (t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("subject_id"))
                   .agg(F.min("o_orderdate").cast("timestamp_ntz").alias("dob")))
    return (cust.select(F.col("c_custkey").alias("subject_id"),
                        F.when(F.col("c_acctbal") < 4500, "F").otherwise("M").alias("gender"))
            .join(first_order, "subject_id"))


def rrt(spark: SparkSession, sf_dir: str, stays: DataFrame | None = None) -> DataFrame:
    machinery = (t(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "MACHINERY")
                 .select(F.col("c_custkey").alias("subject_id")))
    stays = stays if stays is not None else icustays(spark, sf_dir)
    return stays.join(machinery, "subject_id", "left_semi").select("icustay_id")


def diagnoses_icd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_custkey").alias("hadm_id"),
        F.col("o_orderpriority").alias("icd9_code"))


def admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = t(spark, sf_dir, "customer")
    nation = t(spark, sf_dir, "nation")
    return (cust.join(nation, cust.c_nationkey == nation.n_nationkey)
            .select(F.col("c_custkey").alias("subject_id"), F.col("c_custkey").alias("hadm_id"),
                    F.col("n_name").alias("ethnicity"), F.col("c_mktsegment").alias("diagnosis")))


def tables(spark: SparkSession, sf_dir: str):
    """All stand-in tables as a ``plans.dataset.Tables``."""
    from stayframe.plans.dataset import Tables
    stays = icustays(spark, sf_dir)
    return Tables(icustays=stays, chartevents=chartevents(spark, sf_dir),
                  patients=patients(spark, sf_dir), rrt=rrt(spark, sf_dir, stays),
                  diagnoses_icd=diagnoses_icd(spark, sf_dir), admissions=admissions(spark, sf_dir))


def params(**overrides):
    """Stand-in parameters as a ``plans.dataset.Params``."""
    from stayframe.plans.dataset import Params
    kw = dict(anchor_item=ANCHOR_ITEM, excluded_codes=EXCLUDED_CODES, features=FEATURES,
              min_age=MIN_AGE_YEARS, min_stay_hours=MIN_STAY_HOURS, label_band=LABEL_BAND)
    kw.update(overrides)
    return Params(**kw)
