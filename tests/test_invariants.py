"""Invariants on the driver tables."""

from pyspark.sql import functions as F

from stayframe.operators import encode as EN
from stayframe.operators import metrics as K
from stayframe.operators import split as SP
from stayframe.plans import dataset as D
from stayframe.plans import registry_cohort as R
from stayframe.sources import standins as S
from stayframe.sources.tables import read_table

SF = "/root/testdata/sf0.01"


def test_asof_never_looks_ahead(spark):
    co = R._cohort(spark, SF)
    wide = D.feature_table(co, S.tables(spark, SF), S.params(materialize=False))
    j = wide.join(co.select("icustay_id", "creatinine_time", "intime"), ["icustay_id", "creatinine_time"])
    for f in S.FEATURES:
        bad = j.where((F.col(f"{f}_time") > F.col("creatinine_time")) | (F.col(f"{f}_time") < F.col("intime"))
                      | (F.col(f"{f}_delay") < 0)).count()
        assert bad == 0


def test_split_disjoint_complete_and_sized(spark):
    ev = read_table(spark, "events", SF).select("event_id", "event_type")
    s = SP.stratified_split(ev, "event_type", ["event_id"], seed=44)
    assert s.count() == ev.count() and s.select("event_id").distinct().count() == ev.count()
    sizes = {(r.event_type, r.split): r["count"] for r in SP.split_balance(s, "split", "event_type").collect()}
    for t, n in {r.event_type: r["count"] for r in ev.groupBy("event_type").count().collect()}.items():
        n1 = int(n * 0.8 + 0.5)
        n2 = int((n - n1) * 0.5 + 0.5)
        assert sizes[(t, "hyperopt")] == n1 and sizes[(t, "compare")] == n2 and sizes[(t, "test")] == n - n1 - n2


def test_standardised_moments(spark):
    li = read_table(spark, "lineitem", SF).select("l_quantity", "l_extendedprice")
    z = EN.standardize(li, ["l_quantity", "l_extendedprice"])
    for c in z.columns:
        m, s = z.agg(F.avg(c), F.stddev_pop(c)).first()
        assert abs(m) < 1e-9 and abs(s - 1) < 1e-9


def test_confusion_sums_to_n(spark):
    li = read_table(spark, "lineitem", SF)
    df = li.select(F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"),
                   F.when(F.col("l_tax") < 0.03, 0).when(F.col("l_tax") < 0.06, 1).otherwise(2).alias("prediction"))
    total = K.confusion_matrix(df).agg(F.sum("count")).first()[0]
    assert total == li.count()


def test_as_coded_flag_keeps_a_subset(spark):
    co = R._cohort(spark, SF)
    t = S.tables(spark, SF)
    default = D.feature_table(co, t, S.params())
    coded = D.feature_table(co, t, S.params(as_coded=True))
    keys = ["icustay_id", "creatinine_time"]
    assert coded.join(default, keys, "left_anti").count() == 0
    assert coded.count() <= default.count()
