"""Hand-written edge rows (FIXTURES.md, golden edge rows)."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stayframe.functions.recode import dict_recode, keep_list, substring_recode
from stayframe import presets as P
from stayframe.operators import asof as A
from stayframe.operators import clean as CL
from stayframe.operators import cohort as C
from stayframe.operators import encode as EN
from stayframe.operators import label as L
from stayframe.operators import metrics as K
from stayframe.operators import offsets as O

T0 = datetime(2024, 3, 1, 2, 0, 0)
US = timedelta(microseconds=1)


def _anchors(spark, rows):
    return spark.createDataFrame(rows, "subject_id long, icustay_id long, intime timestamp_ntz, creatinine_time timestamp_ntz")


def _events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, subject_id long, itemid long, valuenum double, storetime timestamp_ntz")


def _asof(an, ev, **kw):
    return A.asof_latest(an, ev, key=["subject_id"], anchor_id=["icustay_id", "creatinine_time"],
                         anchor_time="creatinine_time", event_time="storetime", value_col="valuenum",
                         item_col="itemid", tiebreak="event_id", lower_bound="intime", **kw)


def test_inclusive_bounds_delay_zero_wins(spark):
    intime = T0 - timedelta(hours=5)
    an = _anchors(spark, [(1, 10, intime, T0)])
    ev = _events(spark, [(1, 1, 7, 1.0, intime), (2, 1, 7, 2.0, T0)])
    r = _asof(an, ev).collect()
    assert [(x.value, x.delay) for x in r] == [(2.0, 0.0)]
    # only the event at intime: still a candidate
    r = _asof(an, _events(spark, [(1, 1, 7, 1.0, intime)])).collect()
    assert r[0].value == 1.0 and r[0].delay == 5 * 3600.0


def test_before_stay_and_future_event_ignored(spark):
    intime = T0 - timedelta(hours=5)
    an = _anchors(spark, [(1, 10, intime, T0)])
    ev = _events(spark, [(1, 1, 7, 1.0, intime - US), (2, 1, 7, 2.0, T0 + US)])
    r = _asof(an, ev).collect()
    assert r[0].value is None


def test_tie_on_time_highest_id(spark):
    an = _anchors(spark, [(1, 10, T0 - timedelta(days=1), T0)])
    t = T0 - timedelta(hours=1)
    ev = _events(spark, [(5, 1, 7, 5.0, t), (9, 1, 8, 9.0, t), (3, 1, 7, 3.0, t)])
    r = _asof(an, ev).collect()
    assert len(r) == 1 and r[0].value == 9.0 and r[0].item == 8


def test_carry_across_buckets(spark):
    # the latest event is many buckets before the anchor
    an = _anchors(spark, [(1, 10, T0 - timedelta(days=9), T0)])
    ev = _events(spark, [(1, 1, 7, 1.0, T0 - timedelta(days=8)), (2, 1, 7, 2.0, T0 - timedelta(days=3))])
    r = _asof(an, ev, bucket_us=3_600_000_000).collect()
    assert r[0].value == 2.0 and r[0].delay == 3 * 86400.0


def test_shared_instant_default_vs_as_coded(spark):
    an = _anchors(spark, [(1, 10, T0 - timedelta(days=1), T0), (2, 20, T0 - timedelta(days=1), T0)])
    ev = _events(spark, [(1, 1, 7, 1.0, T0 - timedelta(hours=1)), (2, 2, 7, 2.0, T0 - timedelta(hours=3))])
    long = _asof(an, ev)
    assert sorted(r.value for r in long.collect()) == [1.0, 2.0]
    coded = A.asof_as_coded(long, "creatinine_time", feature=False).collect()
    assert [r.icustay_id for r in coded] == [10]


def test_day_offsets(spark):
    D = timedelta(days=1)
    offs = [D, D - US, 2 * D - US, 2 * D, -US, -D, -D - US, -2 * D, -2 * D - US]
    rows = [(0, 1, T0, 100.0)] + [(i + 1, 1, T0 + o, float(i + 1)) for i, o in enumerate(offs)]
    df = spark.createDataFrame(rows, "id long, stay long, t timestamp_ntz, v double")
    for bucket in (6 * 3_600_000_000, 24 * 3_600_000_000):
        out = O.range_max(df, ["stay"], "t", "v", ["id"], O.DAY_FRAMES, bucket_us=bucket)
        r = out.where("id = 0").first()
        # tomorrow: 24h yes(1), 24h-1us no, 48h-1us yes(3), 48h no -> max(1, 3)
        assert r.tomorrow == 3.0
        # yesterday: -1us (5), -24h (6) yes; -24h-1us no
        assert r.yesterday == 6.0
        # before: -24h-1us (7), -48h (8) yes; -48h-1us no
        assert r.before_yesterday == 8.0


def test_label_band_and_drop(spark):
    rows = [(1, 1, T0, 1.0), (2, 1, T0 + timedelta(days=1), 1.2),
            (3, 2, T0, 1.0), (4, 2, T0 + timedelta(days=1), 0.8),
            (5, 3, T0, 1.0), (6, 3, T0 + timedelta(days=1), 1.1),
            (7, 4, T0, 1.0)]
    df = spark.createDataFrame(rows, "id long, icustay_id long, creatinine_time timestamp_ntz, creatinine double")
    out = L.add_labels(df, band=0.15, drop_work_columns=False)
    got = {r.id: r.label for r in out.collect()}
    assert got == {1: 0, 3: 1, 5: 2}


def test_hour_filter(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 5, 59, 59, 999999)), (2, datetime(2024, 1, 1, 6, 0, 0))],
                               "id long, t timestamp_ntz")
    assert [r.id for r in L.hour_filter(df, "t").collect()] == [1]


def test_inclusion_flags(spark):
    diag = spark.createDataFrame([(1, 1, "5856"), (1, 1, "100"), (2, 2, None)], "subject_id long, hadm_id long, icd9_code string")
    ds = {r.subject_id: r.has_excluded for r in C.diagnosis_sets(diag, ["subject_id", "hadm_id"], "icd9_code",
                                                                   P.EXCLUDED_CODES).collect()}
    assert ds == {1: True, 2: False}
    df = spark.createDataFrame([(15.0, 48.0, True, False), (14.99, 47.9, False, True)],
                               "age double, length_of_stay double, rrt boolean, has_excluded boolean")
    r = C.inclusion_flags(df, 15.0, 48.0).collect()
    assert (r[0].inclusion_age, r[0].inclusion_length_of_stay, r[0].inclusion_rrt, r[0].inclusion_diagnoses) == (1, 1, 1, 1)
    assert (r[1].inclusion_age, r[1].inclusion_length_of_stay, r[1].inclusion_rrt, r[1].inclusion_diagnoses) == (0, 0, 0, 0)
    # as coded (Q1): keeps the flagged stays
    r = C.inclusion_flags(df, 15.0, 48.0, keep_flagged=True).collect()
    assert (r[0].inclusion_rrt, r[1].inclusion_rrt) == (0, 1)


def test_singleton_stay_dropped(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "icustay_id long, x long")
    assert sorted(r.x for r in O.drop_singletons(df, "icustay_id").collect()) == [1, 2]


def test_outlier_bounds(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 20.0), (3, 10.0), (4, None)], "id long, creatinine double")
    strict = [r.id for r in CL.range_filter(df, {"creatinine": (0.0, 20.0)}).collect()]
    tolerant = sorted(r.id for r in CL.range_filter(df, {"creatinine": (0.0, 20.0)}, keep_null=True).collect())
    assert strict == [3] and tolerant == [3, 4]


def test_recode_and_unmapped(spark):
    df = spark.createDataFrame([("FEVER, DYSPNEA", "WHITE"), ("SHORTNESS OF BREATH", "MARTIAN"), ("SEPSIS", None)],
                               "diagnosis string, ethnicity string")
    out = df.select(keep_list(substring_recode("diagnosis", P.DIAGNOSIS_SUBSTRING_RECODES), P.DIAGNOSES_KEPT).alias("d"),
                    dict_recode("ethnicity", P.ETHNICITY_GROUPS).alias("e"))
    rows = out.collect()
    assert [r.d for r in rows] == ["SEPSIS", "RESPIRATORY FAILURE", "SEPSIS"]
    assert [r.e for r in rows] == ["WHITE", None, None]
    dm = EN.dummies(out, ["e"]).collect()
    assert [r.e_WHITE for r in dm] == [1, 0, 0]


def test_sparse_column_limit(spark):
    rows = [(i, None if i < 30 else 1.0, None if i < 31 else 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    kept, dropped = CL.drop_sparse_columns(df, 0.3)
    assert dropped == ["b"] and "a" in kept.columns


def test_absent_class_confusion(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (0, 1)], "label int, prediction int")
    cm = {(r.label, r.prediction): r["count"] for r in K.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[(2, 2)] == 0 and cm[(0, 0)] == 1
    s = K.scores(df).first()
    assert abs(s.sensitivity_increase - 0.5) < 1e-12 and abs(s.accuracy - 1 / 3) < 1e-12


def test_null_time_or_value_is_never_a_candidate(spark):
    an = spark.createDataFrame([(1, 10, None, T0)], "subject_id long, icustay_id long, intime timestamp_ntz, "
                                                    "creatinine_time timestamp_ntz")
    ev = _events(spark, [(1, 1, 7, 1.0, None), (2, 1, 7, None, T0 - timedelta(hours=1))])
    r = A.asof_latest(an, ev, key=["subject_id"], anchor_id=["icustay_id", "creatinine_time"],
                      anchor_time="creatinine_time", event_time="storetime", value_col="valuenum",
                      item_col="itemid", tiebreak="event_id").collect()
    assert len(r) == 1 and r[0].value is None
    df = spark.createDataFrame([(1, 1, T0, 1.0), (2, 1, None, 9.0)], "id long, stay long, t timestamp_ntz, v double")
    out = {x.id: x.tomorrow for x in O.range_max(df, ["stay"], "t", "v", ["id"], O.DAY_FRAMES).collect()}
    assert out[1] is None
