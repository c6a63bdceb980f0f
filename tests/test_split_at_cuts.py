"""A split by the hashes next to its cuts is the ranked one, and moves no rows."""

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from stayframe import presets as PR
from stayframe.operators import split as SP
from stayframe.plans import training as T


def parts(df, cols):
    return collections.Counter((r["split"], *["nan" if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in cols]) for r in df.collect())


@pytest.mark.parametrize("keys", [100_000, 40, 1])
@pytest.mark.parametrize("kind", ["string", "double"])
def test_equals_the_ranked_split(spark, keys, kind):
    r = random.Random(keys)
    labels = [None, "a", "b"] if kind == "string" else [None, 0.0, -0.0, 1.5, math.nan]
    rows = [(r.randrange(keys), r.choice(labels)) for _ in range(1200)] + [(1, "few" if kind == "string" else 9.0)]
    df = spark.createDataFrame(rows, f"key long, label {kind}").repartition(4)
    for args in ({}, {"first": 0.0}, {"first": 0.5, "second": 0.0}, {"first": 1.0}):
        for label in ("label", None):
            got = SP.split_at_cuts(df, label, ["key"], **args)
            assert got.columns == ["key", "label", "split"]
            if label is None and keys < 1000:  # which of the rows of one key come first is open there
                assert parts(got, []) == parts(SP.stratified_split(df, label, ["key"], **args), [])
            else:
                assert parts(got, ["key", "label"]) == parts(SP.stratified_split(df, label, ["key"], **args), ["key", "label"])


def test_no_rows_and_many_strata(spark, monkeypatch):
    df = spark.createDataFrame([(i, i % 7) for i in range(300)], "key long, label int")
    assert SP.split_at_cuts(df.where("key < 0"), "label", ["key"]).collect() == []
    want = parts(SP.stratified_split(df, "label", ["key"]), ["key", "label"])
    assert parts(SP.split_at_cuts(df, "label", ["key"]), ["key", "label"]) == want
    monkeypatch.setattr(SP, "MOST_STRATA", 3)
    assert parts(SP.split_at_cuts(df, "label", ["key"]), ["key", "label"]) == want


def test_fit_on_split_moves_no_rows(spark):
    r = random.Random(2)
    rows = [(i, r.uniform(1, 19), r.uniform(20, 100), r.uniform(1, 999), r.choice(list(PR.ETHNICITY_GROUPS)[:3]), i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "icustay_id long, creatinine double, age double, ph_blood_delay double, ethnicity string, label int")
    out = T.prepare_dense(df, fit_on_split=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    hyper = out.where(F.col("split") == "hyperopt")
    n, mean, std, shared = hyper.agg(F.count(F.lit(1)), F.avg("age"), F.stddev_pop("creatinine"), F.avg("ph_blood_delay")).first()
    assert n == sum(round(0.8 * 300) for _ in range(3))
    assert abs(mean) < 1e-9 and abs(std - 1) < 1e-9 and abs(shared) < 1e-9
