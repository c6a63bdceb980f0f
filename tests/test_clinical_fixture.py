"""End to end on a hand-written clinical fixture (FIXTURES.md schemas) with
the study's own parameters; expected rows worked out by hand."""

from datetime import datetime as dt

from stayframe.plans.dataset import Tables, clinical_params, labelled_dataset


def _tables(spark):
    icu = spark.createDataFrame([
        (1, 11, 101, dt(2020, 1, 1), dt(2020, 1, 6)),     # 120 h
        (2, 22, 202, dt(2020, 1, 1), dt(2020, 1, 6)),     # excluded by diagnosis code
    ], "subject_id long, hadm_id long, icustay_id long, intime timestamp_ntz, outtime timestamp_ntz")
    ce = spark.createDataFrame([
        (1, 1, 220615, 1.0, dt(2020, 1, 2, 3, 0)),    # A1
        (2, 1, 220615, 1.5, dt(2020, 1, 3, 4, 0)),    # A2: +25 h
        (3, 1, 220615, 1.2, dt(2020, 1, 4, 5, 0)),    # A3: +25 h
        (4, 1, 220615, 9.9, dt(2020, 1, 4, 7, 0)),    # 07:00, dropped by the hour filter
        (5, 1, 211, 80.0, dt(2020, 1, 2, 1, 0)),      # heart rate, 2 h before A1
        (6, 1, 220045, 90.0, dt(2020, 1, 3, 3, 59)),  # heart rate, 60 s before A2
        (7, 1, 211, 70.0, dt(2019, 12, 31, 23, 0)),   # before the stay: never used
        (8, 2, 220615, 1.0, dt(2020, 1, 2, 3, 0)),
        (9, 2, 220615, 2.0, dt(2020, 1, 3, 3, 0)),
    ], "event_id long, subject_id long, itemid long, valuenum double, storetime timestamp_ntz")
    pat = spark.createDataFrame([(1, dt(1950, 1, 1), "F"), (2, dt(1960, 1, 1), "M")],
                                "subject_id long, dob timestamp_ntz, gender string")
    rrt = spark.createDataFrame([(999,)], "icustay_id long")
    diag = spark.createDataFrame([(1, 11, "4019"), (2, 22, "5856")], "subject_id long, hadm_id long, icd9_code string")
    adm = spark.createDataFrame([(1, 11, "WHITE", "FEVER"), (2, 22, "ASIAN", "SEPSIS")],
                                "subject_id long, hadm_id long, ethnicity string, diagnosis string")
    return Tables(icu, ce, pat, rrt, diag, adm)


import pytest


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_labelled_dataset_by_hand(spark, hot_rows):
    # hot_rows=2 cuts every bucket into time slices: same answer expected
    out = labelled_dataset(_tables(spark), clinical_params(spark, hot_rows=hot_rows))
    assert len(out.columns) == 64          # 61 features + label + subject / stay ids
    rows = {r.creatinine: r for r in out.collect()}
    assert set(rows) == {1.0, 1.5}          # A3 has no next-day value; stay 202 excluded
    a1, a2 = rows[1.0], rows[1.5]
    assert (a1.label, a2.label) == (0, 1)  # +0.5 increase, -0.3 decrease
    assert a1.heart_rate == 80.0 and a1.heart_rate_delay == 7200.0
    assert a2.heart_rate == 90.0 and a2.heart_rate_delay == 60.0
    assert a1.creatinine_yesterday is None and a1.creatinine_before_yesterday is None
    # A1 is 25 h before A2: floor(-25 h / 24 h) = -2 -> "day before yesterday"
    assert a2.creatinine_yesterday is None and a2.creatinine_before_yesterday == 1.0
    assert abs(a1.age - 70.0) < 0.01 and a1.gender == "F" and a1.ethnicity == "WHITE"
    assert a1.temperature is None and a1.temperature_delay is None
