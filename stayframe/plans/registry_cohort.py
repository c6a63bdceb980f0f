"""Registered checks, part 1: sources, cohort, joins, as-of, day windows and
time functions, on the driver tables in their clinical roles
(``sources.standins``). Each entry is ``name -> (spark_fn, duckdb_sql | None)``;
both sides alias every computed column alike and round computed doubles to 6
places.
"""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from stayframe.functions import time as TF
from stayframe.functions.recode import three_way_label
from stayframe.operators import asof as A
from stayframe.operators import cohort as C
from stayframe.operators import label as L
from stayframe.operators import lookback as LB
from stayframe.operators import offsets as O
from stayframe.plans import dataset as D
from stayframe.session import stage_path
from stayframe.sources import infer as IN
from stayframe.sources import standins as S
from stayframe.sources import tables as IO

R6 = lambda c: F.round(c, 6)

# ---- DuckDB stand-in tables (same derivations as sources.standins) ---------
STAYS = """stays AS (
  SELECT user_id AS subject_id, user_id AS hadm_id, user_id * 100 + b AS icustay_id,
         min(ts) AS intime, max(ts) AS outtime
  FROM (SELECT user_id, ts, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00'))
                                       / 864000000000) AS BIGINT) AS b FROM events)
  GROUP BY user_id, b)"""
PATIENTS = """patients AS (
  SELECT c_custkey AS subject_id, CASE WHEN c_acctbal < 4500 THEN 'F' ELSE 'M' END AS gender, o.dob
  FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS dob FROM orders GROUP BY o_custkey) o
    ON o.o_custkey = c_custkey)"""
RRT = """rrt AS (SELECT icustay_id FROM stays
  WHERE subject_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))"""
DIAG = """diag AS (SELECT o_custkey AS subject_id, o_custkey AS hadm_id, o_orderpriority AS icd9_code FROM orders)"""
DIAGSET = """diagset AS (SELECT subject_id, hadm_id,
  coalesce(bool_or(icd9_code IN ('1-URGENT')), false) AS has_excluded,
  array_to_string(list_sort(list(DISTINCT icd9_code)), ', ') AS codes FROM diag GROUP BY subject_id, hadm_id)"""
ATTRS = """attrs AS (
  SELECT s.subject_id, s.hadm_id, s.icustay_id, s.intime, s.outtime, p.dob, d.has_excluded, d.codes,
         (epoch_us(s.outtime) - epoch_us(s.intime)) / 3600000000.0 AS length_of_stay,
         (epoch_us(s.intime) - epoch_us(p.dob)) / 1e6 / 31556908.8 AS age,
         (s.icustay_id NOT IN (SELECT icustay_id FROM rrt)) AS rrt
  FROM stays s JOIN patients p USING (subject_id) JOIN diagset d USING (subject_id, hadm_id))"""
COHORT = """cohort AS (
  SELECT a.subject_id, a.icustay_id, a.hadm_id, a.intime, a.outtime, e.value AS creatinine,
         e.ts AS creatinine_time, e.event_id AS anchor_event_id, a.age, a.length_of_stay, a.rrt,
         CASE WHEN a.age >= 15 THEN 1 ELSE 0 END AS inclusion_age,
         CASE WHEN a.length_of_stay >= 192 THEN 1 ELSE 0 END AS inclusion_length_of_stay,
         CASE WHEN a.rrt THEN 1 ELSE 0 END AS inclusion_rrt,
         CASE WHEN a.has_excluded THEN 0 ELSE 1 END AS inclusion_diagnoses
  FROM attrs a JOIN events e ON e.user_id = a.subject_id AND e.event_type = 'purchase'
   AND e.value IS NOT NULL AND e.ts BETWEEN a.intime AND a.outtime)"""
INCLUDED = """included AS (
  SELECT subject_id, icustay_id, hadm_id, intime, outtime, creatinine, creatinine_time, anchor_event_id,
         age, length_of_stay, rrt FROM cohort
  WHERE inclusion_age = 1 AND inclusion_length_of_stay = 1 AND inclusion_rrt = 1 AND inclusion_diagnoses = 1
  QUALIFY row_number() OVER (PARTITION BY icustay_id, creatinine_time ORDER BY anchor_event_id DESC) = 1)"""
# all cohort anchors (no inclusion filter) for the as-of checks: more rows
ALLANCH = """allanch AS (SELECT subject_id, icustay_id, intime, creatinine_time FROM cohort)"""


def W(*ctes):
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = [STAYS, PATIENTS, RRT, DIAG, DIAGSET, ATTRS, COHORT]


def asof_sql(feature_items: list[str], anchors: str = "allanch", how: str = "inner", feature: str | None = None) -> str:
    items = ", ".join(f"'{i}'" for i in feature_items)
    join = "JOIN" if how == "inner" else "LEFT JOIN"
    f = f"'{feature}' AS feature, " if feature else ""
    return f"""SELECT a.icustay_id, a.creatinine_time, {f}
       arg_max(e.value, (e.ts, e.event_id)) AS value,
       round((epoch_us(a.creatinine_time) - epoch_us(max(e.ts))) / 1e6, 6) AS delay,
       max(e.ts) AS time, arg_max(e.event_type, (e.ts, e.event_id)) AS item
FROM {anchors} a {join} events e ON e.user_id = a.subject_id AND e.event_type IN ({items})
  AND e.value IS NOT NULL AND e.ts BETWEEN a.intime AND a.creatinine_time
GROUP BY a.icustay_id, a.creatinine_time"""


# ---- Spark side --------------------------------------------------------------

def _t(spark, d, name):
    return IO.read_table(spark, name, d)


def _cohort(spark, d, **kw):
    t = S.tables(spark, d)
    return C.cohort(t.icustays, t.chartevents, t.patients, t.rrt, t.diagnoses_icd, anchor_item=S.ANCHOR_ITEM,
                    excluded_codes=S.EXCLUDED_CODES, min_age=S.MIN_AGE_YEARS, min_stay_hours=S.MIN_STAY_HOURS, **kw)


def _attrs(spark, d):
    t = S.tables(spark, d)
    return C.stay_attributes(t.icustays, t.patients, t.rrt, t.diagnoses_icd, excluded_codes=S.EXCLUDED_CODES,
                             min_age=S.MIN_AGE_YEARS, min_stay_hours=S.MIN_STAY_HOURS)


def _asof(spark, d, items, how="inner", anchors=None, truncate_hour=False):
    ev = S.chartevents(spark, d)
    an = anchors if anchors is not None else _cohort(spark, d)
    if truncate_hour:
        ev = ev.withColumn("storetime", F.date_trunc("hour", "storetime").cast("timestamp_ntz"))
    fe = C.item_filter(ev, "itemid", items, "valuenum")
    long = A.asof_latest(an, fe, key=["subject_id"], anchor_id=["icustay_id", "creatinine_time"],
                         anchor_time="creatinine_time", event_time="storetime", value_col="valuenum",
                         item_col="itemid", tiebreak="event_id", lower_bound="intime", how=how)
    return long.withColumn("delay", R6(F.col("delay")))


def _tag(d: str) -> str:
    import hashlib
    return hashlib.md5(d.encode()).hexdigest()[:12]


def s01_table_scan(spark, d):
    return _t(spark, d, "events").select("event_id", "user_id", "event_type", "value", "ts")


def s02_namespace(spark, d):
    name, before = f"ns_{_tag(d)}", spark.catalog.currentDatabase()
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")
    for t in ("orders", "customer"):
        spark.sql(f"CREATE OR REPLACE VIEW {name}.{t} AS SELECT * FROM parquet.`{d}/{t}.parquet`")
    try:
        IO.use_namespace(spark, name)
        orders, customer = IO.read_table(spark, "orders"), IO.read_table(spark, "customer")
    finally:
        IO.use_namespace(spark, before)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


def s03_csv_scan(spark, d):
    path = stage_path(spark, f"s03_events_csv_{_tag(d)}")
    IO.write_table(_t(spark, d, "events").select("event_id", "user_id", "event_type", "value"), path, fmt="csv")
    return IO.read_csv(spark, path, "event_id long, user_id long, event_type string, value double")


def _mixed_csv(spark, d):
    """A CSV of text in which one column holds some words among its numbers, another is empty."""
    path = stage_path(spark, f"s03_mixed_csv_{_tag(d)}")
    e = _t(spark, d, "events")
    IO.write_table(e.select("event_id", "user_id", "event_type", "value", "ts", F.to_date("ts").alias("day"), (F.col("value") > 100).alias("high"),
                            F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("mixed"),
                            F.lit(None).cast("string").alias("nothing")), path, fmt="csv")
    return IN.read_undeclared_csv(spark, path, max_bad=0.05)


def s03b_undeclared_types(spark, d):
    return _mixed_csv(spark, d)[1]


def s03c_undeclared_rows(spark, d):
    rows = _mixed_csv(spark, d)[0]
    return rows.select("event_id", "user_id", "event_type", "value", "day", "high", "mixed", F.array_join("_bad", ",").alias("bad"))


def s04_table_sink(spark, d):
    path = stage_path(spark, f"s04_lineitem_{_tag(d)}")
    IO.write_table(_t(spark, d, "lineitem"), path, partition_by=["l_returnflag"])
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


SPEC_CSV_STANDIN = """name,table,variable,item_id,item_id_2
Browse,events,value,click,view
Error,events,value,error,
Signup,events,value,signup,
Nothing,events,value,,
"""


def s05_feature_spec(spark, d):
    spec = IO.load_feature_spec(spark, csv_text=SPEC_CSV_STANDIN, item_type="string")
    tagged = A.tag_features(S.chartevents(spark, d), spec)
    return tagged.groupBy("feature", "itemid").agg(F.count(F.lit(1)).alias("n"), R6(F.sum("valuenum")).alias("total"))


def s06_parameterised_features(spark, d):
    """The per-feature query of the study, built once for every spec row:
    spec loaded from its CSV form (S05), one as-of pass for all features."""
    spec = IO.load_feature_spec(spark, csv_text=SPEC_CSV_STANDIN, item_type="string")
    p = S.params(features={f: v for f, v in IO.spec_items(spec).items() if f in S.FEATURES})
    wide = D.feature_table(_cohort(spark, d), S.tables(spark, d), p)
    return wide.select("icustay_id", "creatinine_time",
                       *[c for f in S.FEATURES for c in (F.col(f), R6(F.col(f"{f}_delay")).alias(f"{f}_delay"),
                                                         F.col(f"{f}_itemid"))])


def s07_fixed_sample(spark, d):
    return IO.fixed_size_sample(_t(spark, d, "events"), 500, ["event_id"], seed=42).select("event_id", "value")


def p01_project_rename(spark, d):
    return S.chartevents(spark, d)


def p02_item_filter(spark, d):
    return C.item_filter(S.chartevents(spark, d), "itemid", "purchase", "valuenum").select("event_id", "valuenum")


def p03_item_set_filter(spark, d):
    return C.item_filter(S.chartevents(spark, d), "itemid", ["click", "view"], "valuenum").select("event_id", "itemid")


def p04_time_containment(spark, d):
    ev = S.chartevents(spark, d)
    return C.interval_join(ev, S.icustays(spark, d), "subject_id", "storetime", "intime", "outtime") \
        .select("event_id", "icustay_id")


def p05_presence_flag(spark, d):
    return C.presence_flag(S.icustays(spark, d), S.rrt(spark, d), "icustay_id", "rrt").select("icustay_id", "rrt")


def p06_inclusion_flags(spark, d):
    a = _attrs(spark, d)
    return a.select("icustay_id", R6(F.col("age")).alias("age"), R6(F.col("length_of_stay")).alias("length_of_stay"),
                    "inclusion_age", "inclusion_length_of_stay", "inclusion_rrt", "inclusion_diagnoses")


def p07_array_overlap(spark, d):
    ds = C.diagnosis_sets(S.diagnoses_icd(spark, d), ["subject_id", "hadm_id"], "icd9_code", S.EXCLUDED_CODES)
    return ds.select("subject_id", "has_excluded", C.codes_text("diagnoses").alias("codes"))


def p08_apply_inclusion(spark, d):
    inc = C.apply_inclusion(_cohort(spark, d, with_codes=False))
    return inc.select("icustay_id", "creatinine_time", "creatinine", "anchor_event_id", R6(F.col("age")).alias("age"))


def p08b_inclusion_counts(spark, d):
    """The three counts that the inclusion filter reports."""
    seen = tuple(Observation() for _ in range(3))
    C.apply_inclusion(_cohort(spark, d, with_codes=False), observations=seen).write.format("noop").mode("overwrite").save()
    counts = {}
    for o in seen:
        counts.update(o.get)
    return spark.createDataFrame([(counts["initial"], counts["included"], counts["unique"])], "initial long, included long, n_unique long")


def j01_interval_join(spark, d):
    return C.anchor_rows(_attrs(spark, d), S.chartevents(spark, d), anchor_item=S.ANCHOR_ITEM) \
        .select("icustay_id", "anchor_event_id", "creatinine", "creatinine_time")


def j02_dimension_join(spark, d):
    return S.icustays(spark, d).join(S.patients(spark, d), "subject_id").select("icustay_id", "dob", "gender")


def j03_left_flag_join(spark, d):
    return C.presence_flag(S.icustays(spark, d), S.rrt(spark, d), "icustay_id", "has_flag", true_when_absent=False) \
        .select("icustay_id", "has_flag")


def j04_aggregate_then_join(spark, d):
    ds = C.diagnosis_sets(S.diagnoses_icd(spark, d), ["subject_id", "hadm_id"], "icd9_code", S.EXCLUDED_CODES)
    return S.icustays(spark, d).join(ds, ["subject_id", "hadm_id"]).select(
        "icustay_id", "has_excluded", F.size("diagnoses").alias("n_codes"))


def j05_fanout_join(spark, d):
    t = S.tables(spark, d)
    inc = C.apply_inclusion(_cohort(spark, d, with_codes=False))
    return C.attach_admission(inc, t.admissions, t.patients, match="subject") \
        .select("icustay_id", "creatinine_time", "ethnicity", "diagnosis", "gender")


def j06_lookback_candidates(spark, d):
    return _asof(spark, d, ["click", "view"], how="left")


def j07_argmin_as_coded(spark, d):
    co = (_cohort(spark, d).select("subject_id", "icustay_id", "intime",
                                   F.date_trunc("hour", "creatinine_time").cast("timestamp_ntz").alias("creatinine_time"))
          .dropDuplicates())
    long = _asof(spark, d, ["click", "view"], how="inner", anchors=co, truncate_hour=True)
    return A.asof_as_coded(long, "creatinine_time", feature=False)


def _lookback(spark, d, anchors=None, truncate=None):
    ev = S.chartevents(spark, d)
    an = anchors if anchors is not None else _cohort(spark, d)
    if truncate:
        ev = ev.withColumn("storetime", F.date_trunc(truncate, "storetime").cast("timestamp_ntz"))
    return LB.Lookback(an, C.item_filter(ev, "itemid", ["click", "view"], "valuenum"), key=["subject_id"], anchor_id=["icustay_id", "creatinine_time"],
                       anchor_time="creatinine_time", event_time="storetime", value_col="valuenum", item_col="itemid", tiebreak="event_id", lower_bound="intime")


def j06b_candidate_summary(spark, d):
    """Number and sum of every anchor's candidates, from its interval alone."""
    return _lookback(spark, d).intervals.select("icustay_id", "creatinine_time", "n", R6("total").alias("total"), R6("delay").alias("delay"))


def j06c_candidate_rows(spark, d):
    """The candidates themselves, one row each."""
    return _lookback(spark, d).expand().withColumn("delay", R6("delay"))


def j07b_argmin_all_ties(spark, d):
    """The argmin self-join as written, on days: many events share an instant, and every tie stays."""
    co = _cohort(spark, d).select("subject_id", "icustay_id", F.date_trunc("day", "intime").cast("timestamp_ntz").alias("intime"),
                                  F.date_trunc("day", "creatinine_time").cast("timestamp_ntz").alias("creatinine_time")).dropDuplicates()
    return LB.argmin_as_coded(_lookback(spark, d, co, "day"), "creatinine_time").withColumn("delay", R6("delay"))


def j08_asof_latest_prior(spark, d):
    return _asof(spark, d, ["click", "view"])


def j09_all_features(spark, d):
    t = S.tables(spark, d)
    p = S.params()
    wide = D.feature_table(_cohort(spark, d), t, p)
    return wide.select("icustay_id", "creatinine_time",
                       *[c for f in S.FEATURES for c in (F.col(f), R6(F.col(f"{f}_delay")).alias(f"{f}_delay"),
                                                         F.col(f"{f}_itemid"))])


def j10_merge_outer(spark, d):
    ev = _t(spark, d, "events").withColumn("day", F.to_date("ts"))
    buys = ev.where(F.col("event_type") == "purchase").groupBy("user_id", "day").agg(R6(F.sum("value")).alias("spent"))
    errs = ev.where(F.col("event_type") == "error").groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("errors"))
    return A.merge_outer([buys, errs], ["user_id", "day"])


def j11_static_dynamic_merge(spark, d):
    m = D.merged_table(S.tables(spark, d), S.params())
    return m.select("subject_id", "icustay_id", "creatinine", "creatinine_time", R6(F.col("age")).alias("age"),
                    *[c for f in S.FEATURES for c in (F.col(f), R6(F.col(f"{f}_delay")).alias(f"{f}_delay"))],
                    "ethnicity", "diagnosis", "gender")


def a01_group_to_array(spark, d):
    ds = C.diagnosis_sets(S.diagnoses_icd(spark, d), ["subject_id", "hadm_id"], "icd9_code", S.EXCLUDED_CODES)
    return ds.select("subject_id", C.codes_text("diagnoses").alias("codes"))


def a02_group_min(spark, d):
    long = _asof(spark, d, ["click", "view"])
    return long.groupBy("creatinine_time").agg(F.min("delay").alias("min_delay"))


def a03_drop_singletons(spark, d):
    ev = _t(spark, d, "events").withColumn("grp", F.concat_ws(":", "user_id", F.to_date("ts").cast("string")))
    return O.drop_singletons(ev, "grp").select("event_id", "grp")


def _night(spark, d):
    return L.hour_filter(_t(spark, d, "events"), "ts").select("event_id", "user_id", "ts", "value")


def _offsets(spark, d, frames):
    n = _night(spark, d)
    return O.range_max(n, ["user_id"], "ts", "value", ["event_id"], frames)


def a04_conditional_max(spark, d):
    return _offsets(spark, d, O.DAY_FRAMES).select("event_id", "tomorrow", "yesterday", "before_yesterday")


def w01_next_day_max(spark, d):
    return _offsets(spark, d, {"tomorrow": O.DAY_FRAMES["tomorrow"]}).select("event_id", "tomorrow")


def w02_previous_day_max(spark, d):
    return _offsets(spark, d, {"yesterday": O.DAY_FRAMES["yesterday"]}).select("event_id", "yesterday")


def w03_day_before_max(spark, d):
    return _offsets(spark, d, {"before_yesterday": O.DAY_FRAMES["before_yesterday"]}) \
        .select("event_id", "before_yesterday")


def w04_last_known_value(spark, d):
    # every error event gets the last purchase value of the same user up to it
    ev = _t(spark, d, "events")
    an = ev.where(F.col("event_type") == "error").select("user_id", "event_id", "ts")
    fe = ev.where(F.col("event_type") == "purchase")
    long = A.asof_latest(an, fe, key=["user_id"], anchor_id=["event_id"], anchor_time="ts", event_time="ts",
                         value_col="value", item_col="event_type", tiebreak="event_id", how="left")
    return long.select("event_id", F.col("value").alias("last_purchase"), R6(F.col("delay")).alias("delay"))


def w05_keep_first(spark, d):
    ev = _t(spark, d, "events")
    return C.keep_first(ev.select("user_id", "event_type", "event_id", "ts", "value"), ["user_id", "event_type"],
                        ["ts", "event_id"])


def p12_hour_filter(spark, d):
    return _night(spark, d).select("event_id", "ts")


def p13_drop_null_label(spark, d):
    return L.add_labels(_t(spark, d, "events"), stay="user_id", time_col="ts", value_col="value",
                        band=S.LABEL_BAND, drop_work_columns=False) \
        .select("event_id", "label", "value_tomorrow", "value_yesterday", "value_before_yesterday")


def f01_duration_hours(spark, d):
    return S.icustays(spark, d).select("icustay_id", R6(TF.hours_between("intime", "outtime")).alias("length_of_stay"))


def f02_delay_seconds(spark, d):
    return S.icustays(spark, d).select("icustay_id", R6(TF.delay_seconds("intime", "outtime")).alias("delay"))


def f03_age_years(spark, d):
    st = S.icustays(spark, d).join(S.patients(spark, d), "subject_id")
    return st.select("icustay_id", R6(TF.age_years("dob", "intime")).alias("age"))


def f04_hour(spark, d):
    return _t(spark, d, "events").select("event_id", TF.hour_of("ts").alias("hour"))


def f05_floor_days(spark, d):
    ev = _t(spark, d, "events")
    ref = TF.epoch_us(F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return ev.select("event_id", TF.floor_days(TF.epoch_us("ts") - ref).alias("days"))


def f06_three_way_label(spark, d):
    ev = _t(spark, d, "events")
    return ev.select("event_id", three_way_label(F.col("value") - F.lit(245.0), 100.0).alias("label"))


def f07_difference(spark, d):
    out = L.add_labels(_t(spark, d, "events"), stay="user_id", time_col="ts", value_col="value",
                       band=S.LABEL_BAND, drop_unlabelled=False, drop_work_columns=False)
    return out.select("event_id", R6(F.col("value_tomorrow") - F.col("value")).alias("diff"))


def f08_sort_and_join(spark, d):
    ds = C.diagnosis_sets(_t(spark, d, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderstatus").alias("code")), ["subject_id"], "code", [])
    return ds.select("subject_id", C.codes_text("diagnoses").alias("codes"))


QUERIES = {k: v for k, v in dict(globals()).items()
           if callable(v) and k[:1] in "spjawf" and k[1:3].isdigit() and "_" in k}

J08_ANCH = W(*BASE, ALLANCH)

SQL = {
    "s01_table_scan": "SELECT event_id, user_id, event_type, value, ts FROM events",
    "s02_namespace": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "s03_csv_scan": "SELECT event_id, user_id, event_type, value FROM events",
    "s03b_undeclared_types": " UNION ALL ".join(f"SELECT '{c}' AS column, '{t}' AS type, count({x}) AS n, {b} AS n_bad FROM events" for c, t, x, b in [
        ("event_id", "bigint", "event_id", 0), ("user_id", "bigint", "user_id", 0), ("event_type", "string", "event_type", 0), ("value", "double", "value", 0),
        ("ts", "timestamp_ntz", "ts", 0), ("day", "date", "ts", 0), ("high", "boolean", "value", 0),
        ("mixed", "double", "CASE WHEN event_id % 50 = 0 THEN 0 ELSE value END", "count(*) FILTER (event_id % 50 = 0)"), ("nothing", "string", "NULL", 0)]),
    "s03c_undeclared_rows": """SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day, value > 100 AS high,
        CASE WHEN event_id % 50 <> 0 THEN value END AS mixed, CASE WHEN event_id % 50 = 0 THEN 'mixed' ELSE '' END AS bad FROM events""",
    "s04_table_sink": "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem",
    "s05_feature_spec": """SELECT CASE WHEN event_type IN ('click','view') THEN 'browse' ELSE event_type END AS feature,
        event_type AS itemid, count(*) AS n, round(sum(value), 6) AS total FROM events
        WHERE event_type IN ('click','view','error','signup') AND value IS NOT NULL GROUP BY ALL""",
    "s07_fixed_sample": """SELECT event_id, value FROM events
        ORDER BY md5(concat_ws('|', CAST(event_id AS VARCHAR), '42')), event_id LIMIT 500""",
    "p01_project_rename": """SELECT event_id, user_id AS subject_id, event_type AS itemid, value AS valuenum,
        ts AS storetime FROM events""",
    "p02_item_filter": "SELECT event_id, value AS valuenum FROM events WHERE event_type = 'purchase' AND value IS NOT NULL",
    "p03_item_set_filter": """SELECT event_id, event_type AS itemid FROM events
        WHERE event_type IN ('click','view') AND value IS NOT NULL""",
    "p04_time_containment": W(STAYS) + """SELECT e.event_id, s.icustay_id FROM events e JOIN stays s
        ON e.user_id = s.subject_id AND e.ts BETWEEN s.intime AND s.outtime""",
    "p05_presence_flag": W(STAYS, RRT) + "SELECT icustay_id, icustay_id NOT IN (SELECT icustay_id FROM rrt) AS rrt FROM stays",
    "p06_inclusion_flags": W(*BASE[:-1]) + """SELECT icustay_id, round(age, 6) AS age,
        round(length_of_stay, 6) AS length_of_stay,
        CASE WHEN age >= 15 THEN 1 ELSE 0 END AS inclusion_age,
        CASE WHEN length_of_stay >= 192 THEN 1 ELSE 0 END AS inclusion_length_of_stay,
        CASE WHEN rrt THEN 1 ELSE 0 END AS inclusion_rrt,
        CASE WHEN has_excluded THEN 0 ELSE 1 END AS inclusion_diagnoses FROM attrs""",
    "p07_array_overlap": W(DIAG, DIAGSET) + "SELECT subject_id, has_excluded, codes FROM diagset",
    "p08_apply_inclusion": W(*BASE, INCLUDED) + """SELECT icustay_id, creatinine_time, creatinine, anchor_event_id,
        round(age, 6) AS age FROM included""",
    "p08b_inclusion_counts": W(*BASE, INCLUDED) + """SELECT (SELECT count(*) FROM cohort) AS initial,
        (SELECT count(*) FROM cohort WHERE inclusion_age = 1 AND inclusion_length_of_stay = 1 AND inclusion_rrt = 1
         AND inclusion_diagnoses = 1) AS included, (SELECT count(*) FROM included) AS n_unique""",
    "j01_interval_join": W(*BASE) + "SELECT icustay_id, anchor_event_id, creatinine, creatinine_time FROM cohort",
    "j02_dimension_join": W(STAYS, PATIENTS) + "SELECT icustay_id, dob, gender FROM stays JOIN patients USING (subject_id)",
    "j03_left_flag_join": W(STAYS, RRT) + """SELECT s.icustay_id, r.icustay_id IS NOT NULL AS has_flag
        FROM stays s LEFT JOIN (SELECT DISTINCT icustay_id FROM rrt) r USING (icustay_id)""",
    "j04_aggregate_then_join": W(STAYS, DIAG) + """SELECT s.icustay_id,
        coalesce(bool_or(d.icd9_code IN ('1-URGENT')), false) AS has_excluded,
        CAST(count(DISTINCT d.icd9_code) AS INTEGER) AS n_codes
        FROM stays s JOIN diag d USING (subject_id, hadm_id) GROUP BY s.icustay_id""",
    "j05_fanout_join": W(*BASE, INCLUDED) + """SELECT i.icustay_id, i.creatinine_time, n_name AS ethnicity,
        c_mktsegment AS diagnosis, p.gender FROM included i
        JOIN customer c ON c.c_custkey = i.subject_id JOIN nation ON n_nationkey = c_nationkey
        JOIN patients p ON p.subject_id = i.subject_id""",
    "j06_lookback_candidates": J08_ANCH + asof_sql(["click", "view"], how="left"),
    "j07_argmin_as_coded": W(*BASE) + """,
        allanch AS (SELECT subject_id, icustay_id, intime, date_trunc('hour', creatinine_time) AS creatinine_time
                    FROM cohort),
        ev AS (SELECT event_id, user_id, event_type, value, date_trunc('hour', ts) AS ts FROM events),
        best AS (SELECT a.icustay_id, a.creatinine_time, arg_max(e.value, (e.ts, e.event_id)) AS value,
                   round((epoch_us(a.creatinine_time) - epoch_us(max(e.ts))) / 1e6, 6) AS delay,
                   max(e.ts) AS time, arg_max(e.event_type, (e.ts, e.event_id)) AS item
                 FROM allanch a JOIN ev e ON e.user_id = a.subject_id AND e.event_type IN ('click','view')
                  AND e.value IS NOT NULL AND e.ts BETWEEN a.intime AND a.creatinine_time
                 GROUP BY a.icustay_id, a.creatinine_time)
        SELECT * FROM best QUALIFY delay = min(delay) OVER (PARTITION BY creatinine_time)""",
    "j06b_candidate_summary": J08_ANCH + """SELECT a.icustay_id, a.creatinine_time, count(e.ts) AS n, round(sum(e.value), 6) AS total,
          round((epoch_us(a.creatinine_time) - epoch_us(max(e.ts))) / 1e6, 6) AS delay
        FROM allanch a LEFT JOIN events e ON e.user_id = a.subject_id AND e.event_type IN ('click','view')
          AND e.value IS NOT NULL AND e.ts BETWEEN a.intime AND a.creatinine_time
        GROUP BY a.icustay_id, a.creatinine_time""",
    "j06c_candidate_rows": J08_ANCH + """SELECT a.icustay_id, a.creatinine_time, e.value, round((epoch_us(a.creatinine_time) - epoch_us(e.ts)) / 1e6, 6) AS delay,
          e.ts AS time, e.event_type AS item
        FROM allanch a JOIN events e ON e.user_id = a.subject_id AND e.event_type IN ('click','view')
          AND e.value IS NOT NULL AND e.ts BETWEEN a.intime AND a.creatinine_time""",
    "j07b_argmin_all_ties": W(*BASE) + """,
        anchors AS (SELECT DISTINCT subject_id, icustay_id, date_trunc('day', intime) AS intime, date_trunc('day', creatinine_time) AS creatinine_time FROM cohort),
        ev AS (SELECT user_id, event_type, value, date_trunc('day', ts) AS ts FROM events WHERE event_type IN ('click','view') AND value IS NOT NULL),
        feat AS (SELECT a.icustay_id, a.creatinine_time, e.value, round((epoch_us(a.creatinine_time) - epoch_us(e.ts)) / 1e6, 6) AS delay, e.ts AS time, e.event_type AS item
                 FROM anchors a JOIN ev e ON e.user_id = a.subject_id AND e.ts BETWEEN a.intime AND a.creatinine_time)
        SELECT a.* FROM feat a JOIN (SELECT creatinine_time, min(delay) AS delay FROM feat GROUP BY creatinine_time) b
          ON a.creatinine_time = b.creatinine_time WHERE a.delay = b.delay""",
    "j08_asof_latest_prior": J08_ANCH + asof_sql(["click", "view"]),
    "j10_merge_outer": """WITH ev AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
        buys AS (SELECT user_id, day, round(sum(value), 6) AS spent FROM ev WHERE event_type = 'purchase' GROUP BY ALL),
        errs AS (SELECT user_id, day, count(*) AS errors FROM ev WHERE event_type = 'error' GROUP BY ALL)
        SELECT coalesce(b.user_id, e.user_id) AS user_id, coalesce(b.day, e.day) AS day, spent, errors
        FROM buys b FULL JOIN errs e ON b.user_id = e.user_id AND b.day = e.day""",
    "a01_group_to_array": W(DIAG, DIAGSET) + "SELECT subject_id, codes FROM diagset",
    "a02_group_min": J08_ANCH + ", j AS (" + asof_sql(["click", "view"]) + """)
        SELECT creatinine_time, min(delay) AS min_delay FROM j GROUP BY creatinine_time""",
    "a03_drop_singletons": """WITH g AS (SELECT event_id, concat_ws(':', CAST(user_id AS VARCHAR),
        CAST(CAST(ts AS DATE) AS VARCHAR)) AS grp FROM events)
        SELECT event_id, grp FROM g QUALIFY count(*) OVER (PARTITION BY grp) > 1""",
    "w04_last_known_value": """SELECT a.event_id, arg_max(e.value, (e.ts, e.event_id)) AS last_purchase,
        round((epoch_us(a.ts) - epoch_us(max(e.ts))) / 1e6, 6) AS delay
        FROM events a LEFT JOIN events e ON e.user_id = a.user_id AND e.event_type = 'purchase' AND e.ts <= a.ts
        WHERE a.event_type = 'error' GROUP BY a.event_id, a.ts""",
    "w05_keep_first": """SELECT user_id, event_type, event_id, ts, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
    "p12_hour_filter": "SELECT event_id, ts FROM events WHERE hour(ts) BETWEEN 0 AND 5",
    "f01_duration_hours": W(STAYS) + """SELECT icustay_id,
        round((epoch_us(outtime) - epoch_us(intime)) / 3600000000.0, 6) AS length_of_stay FROM stays""",
    "f02_delay_seconds": W(STAYS) + "SELECT icustay_id, round((epoch_us(outtime) - epoch_us(intime)) / 1e6, 6) AS delay FROM stays",
    "f03_age_years": W(STAYS, PATIENTS) + """SELECT icustay_id,
        round((epoch_us(intime) - epoch_us(dob)) / 1e6 / 31556908.8, 6) AS age FROM stays JOIN patients USING (subject_id)""",
    "f04_hour": "SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour FROM events",
    "f05_floor_days": """SELECT event_id, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00'))
        / 86400000000) AS BIGINT) AS days FROM events""",
    "f06_three_way_label": """SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value - 245.0 > 100 THEN 0
        WHEN value - 245.0 < -100 THEN 1 ELSE 2 END AS label FROM events""",
    "f08_sort_and_join": """SELECT o_custkey AS subject_id, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ', ') AS codes
        FROM orders GROUP BY o_custkey""",
}

NIGHT_W = """WITH n AS (SELECT event_id, user_id, ts, value, epoch_us(ts) AS us FROM events WHERE hour(ts) BETWEEN 0 AND 5),
  w AS (SELECT *,
    max(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 FOLLOWING AND 172799999999 FOLLOWING) AS tomorrow,
    max(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS yesterday,
    max(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 172800000000 PRECEDING AND 86400000001 PRECEDING)
      AS before_yesterday FROM n)
"""
SQL.update({
    "a04_conditional_max": NIGHT_W + "SELECT event_id, tomorrow, yesterday, before_yesterday FROM w",
    "w01_next_day_max": NIGHT_W + "SELECT event_id, tomorrow FROM w",
    "w02_previous_day_max": NIGHT_W + "SELECT event_id, yesterday FROM w",
    "w03_day_before_max": NIGHT_W + "SELECT event_id, before_yesterday FROM w",
    "p13_drop_null_label": NIGHT_W + """, l AS (SELECT *, CASE WHEN tomorrow IS NULL THEN NULL WHEN tomorrow - value > 20.0 THEN 0
        WHEN tomorrow - value < -20.0 THEN 1 ELSE 2 END AS label FROM w)
        SELECT event_id, label, tomorrow AS value_tomorrow, yesterday AS value_yesterday,
        before_yesterday AS value_before_yesterday FROM l WHERE label IS NOT NULL""",
    "f07_difference": NIGHT_W + "SELECT event_id, round(tomorrow - value, 6) AS diff FROM w",
})

_FEATS = {"browse": ["click", "view"], "error": ["error"], "signup": ["signup"]}


def _wide_sql(anchors: str) -> str:
    parts = []
    for f, items in _FEATS.items():
        parts.append(f"{f} AS (" + asof_sql(items, anchors=anchors) + ")")
    sel = ", ".join(f"{f}.value AS {f}, {f}.delay AS {f}_delay, {f}.item AS {f}_itemid" for f in _FEATS)
    keys = "SELECT icustay_id, creatinine_time FROM browse UNION SELECT icustay_id, creatinine_time FROM error " \
           "UNION SELECT icustay_id, creatinine_time FROM signup"
    joins = " ".join(f"LEFT JOIN {f} USING (icustay_id, creatinine_time)" for f in _FEATS)
    return ",\n".join(parts) + f",\n wide AS (SELECT k.icustay_id, k.creatinine_time, {sel} FROM ({keys}) k {joins})\n"


SQL["j09_all_features"] = W(*BASE, ALLANCH) + ", " + _wide_sql("allanch") + "SELECT * FROM wide"
SQL["s06_parameterised_features"] = SQL["j09_all_features"]
SQL["j11_static_dynamic_merge"] = W(*BASE, INCLUDED) + ", inc2 AS (SELECT * FROM included), " + \
    _wide_sql("inc2") + """, st AS (SELECT i.*, n_name AS ethnicity, c_mktsegment AS diagnosis, p.gender
      FROM included i JOIN customer c ON c.c_custkey = i.subject_id JOIN nation ON n_nationkey = c_nationkey
      JOIN patients p ON p.subject_id = i.subject_id),
    m AS (SELECT st.subject_id, st.icustay_id, st.creatinine, st.creatinine_time, round(st.age, 6) AS age,
      w.browse, w.browse_delay, w.error, w.error_delay, w.signup, w.signup_delay, st.ethnicity, st.diagnosis, st.gender
      FROM st LEFT JOIN wide w USING (icustay_id, creatinine_time))
    SELECT * FROM m WHERE icustay_id IN (SELECT icustay_id FROM m GROUP BY icustay_id HAVING count(*) > 1)"""

CHECKS = {k: (fn, SQL.get(k)) for k, fn in QUERIES.items()}


def l01_labelled_dataset(spark, d):
    """The whole dataset build on the stand-ins: cohort, all-feature as-of,
    static attributes, singleton/duplicate drops, night filter, day offsets,
    label (the main output of the study)."""
    out = D.labelled_dataset(S.tables(spark, d), S.params())
    return out.select("subject_id", "icustay_id", "creatinine", R6(F.col("age")).alias("age"),
                      *[c for f in S.FEATURES for c in (F.col(f), R6(F.col(f"{f}_delay")).alias(f"{f}_delay"))],
                      "ethnicity", "diagnosis", "gender", "creatinine_yesterday", "creatinine_before_yesterday",
                      "label")


QUERIES["l01_labelled_dataset"] = l01_labelled_dataset
SQL["l01_labelled_dataset"] = SQL["j11_static_dynamic_merge"].replace(
    "SELECT * FROM m WHERE icustay_id IN",
    """, mm AS (SELECT * FROM m WHERE icustay_id IN""") + """),
    n AS (SELECT *, epoch_us(creatinine_time) AS us FROM mm WHERE hour(creatinine_time) BETWEEN 0 AND 5),
    w AS (SELECT *,
      max(creatinine) OVER (PARTITION BY icustay_id ORDER BY us RANGE BETWEEN 86400000000 FOLLOWING
                            AND 172799999999 FOLLOWING) AS tm,
      max(creatinine) OVER (PARTITION BY icustay_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING
                            AND 1 PRECEDING) AS creatinine_yesterday,
      max(creatinine) OVER (PARTITION BY icustay_id ORDER BY us RANGE BETWEEN 172800000000 PRECEDING
                            AND 86400000001 PRECEDING) AS creatinine_before_yesterday FROM n)
    SELECT subject_id, icustay_id, creatinine, age, browse, browse_delay, error, error_delay, signup, signup_delay,
      ethnicity, diagnosis, gender, creatinine_yesterday, creatinine_before_yesterday,
      CASE WHEN tm - creatinine > 20.0 THEN 0 WHEN tm - creatinine < -20.0 THEN 1 ELSE 2 END AS label
    FROM w WHERE tm IS NOT NULL"""
CHECKS["l01_labelled_dataset"] = (l01_labelled_dataset, SQL["l01_labelled_dataset"])
