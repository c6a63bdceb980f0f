"""Positional candidate intervals, ties, CSV types, resampled metrics, wide PCA, distinct counts."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stayframe.operators import lookback as LB
from stayframe.operators import profile as PR
from stayframe.operators import resample as RS
from stayframe.operators import wide_pca as WP
from stayframe.sources import infer as IN

T0 = datetime(2024, 1, 1)
HOUR = 3_600_000_000


def _tables(spark, seed=5, n=400):
    """Few instants, so most events tie; one subject holds most of them."""
    r = random.Random(seed)
    events = [(i, 0 if r.random() < 0.7 else r.randint(1, 3), T0 + timedelta(hours=r.randint(0, 60)), float(r.randint(0, 9)), r.choice(["a", "b"])) for i in range(n)]
    events += [(n, None, T0, 1.0, "a"), (n + 1, 0, None, 1.0, "a"), (n + 2, 0, T0, None, "a")]
    anchors = [(k, r.randint(0, 4), T0 + timedelta(hours=r.randint(-2, 62)), T0 + timedelta(hours=r.randint(0, 30)) if k % 3 else None) for k in range(60)]
    anchors += [(100, None, T0, T0), (101, 0, None, T0), (102, 0, T0, T0 + timedelta(hours=5))]
    ev = spark.createDataFrame(events, "e long, s long, t timestamp_ntz, v double, item string")
    an = spark.createDataFrame(anchors, "k long, s long, at timestamp_ntz, lo timestamp_ntz")
    return events, anchors, ev, an


def _candidates(events, anchor, item=None):
    _, s, at, lo = anchor
    return [(v, t, i, e) for e, es, t, v, i in events if es is not None and es == s and t is not None and v is not None and at is not None
            and t <= at and (lo is None or t >= lo) and (item is None or i == item)]


@pytest.mark.parametrize("bucket,hot,block", [(6 * HOUR, None, 4096), (1000 * HOUR, 20, 7), (HOUR, 2_000_000, 3)])
def test_intervals_equal_all_candidates(spark, monkeypatch, bucket, hot, block):
    monkeypatch.setattr(LB, "BLOCK", block)
    events, anchors, ev, an = _tables(spark)
    look = LB.Lookback(an, ev, key=["s"], anchor_id=["k"], anchor_time="at", event_time="t", value_col="v", item_col="item", tiebreak="e", lower_bound="lo",
                       bucket_us=bucket, hot_rows=hot)
    got = {r["k"]: r for r in look.intervals.collect()}
    assert sorted(got) == sorted(a[0] for a in anchors)
    rows, ties = look.expand().collect(), look.expand(ties=True).collect()
    for a in anchors:
        want = _candidates(events, a)
        assert got[a[0]]["n"] == len(want)
        assert got[a[0]]["total"] == (pytest.approx(sum(w[0] for w in want)) if want else None)
        assert sorted((r["value"], r["time"], r["item"]) for r in rows if r["k"] == a[0]) == sorted(w[:3] for w in want)
        last = max((w[1] for w in want), default=None)
        assert got[a[0]]["delay"] == (None if last is None else (a[2] - last).total_seconds())
        assert sorted((r["value"], r["time"], r["item"]) for r in ties if r["k"] == a[0]) == sorted(w[:3] for w in want if w[1] == last)


def test_features_have_runs_of_their_own(spark):
    events, anchors, ev, an = _tables(spark, 6, 150)
    look = LB.Lookback(an, ev, key=["s"], anchor_id=["k"], anchor_time="at", event_time="t", value_col="v", item_col="item", tiebreak="e", lower_bound="lo",
                       feature_col="item", features=["a", "b", "none"])
    got = {(r["k"], r["feature"]): r["n"] for r in look.intervals.collect()}
    assert got == {(a[0], f): len(_candidates(events, a, f)) for a in anchors for f in ("a", "b", "none")}
    assert look.expand().count() == sum(got.values())


def test_argmin_keeps_every_tie_of_an_instant(spark):
    t = lambda h: T0 + timedelta(hours=h)
    ev = spark.createDataFrame([(1, 1, t(1), 5.0, "a"), (2, 1, t(1), 6.0, "b"), (3, 2, t(1), 7.0, "a"), (4, 2, t(0), 8.0, "a"), (5, 3, t(0), 9.0, "a")],
                               "e long, s long, t timestamp_ntz, v double, item string")
    # three stays measured at one instant compete (as written); stay 13 has an older event only
    an = spark.createDataFrame([(11, 1, t(2)), (12, 2, t(2)), (13, 3, t(2)), (14, 3, t(5))], "k long, s long, at timestamp_ntz")
    look = LB.Lookback(an, ev, key=["s"], anchor_id=["k", "at"], anchor_time="at", event_time="t", value_col="v", item_col="item", tiebreak="e")
    got = sorted((r["k"], r["value"]) for r in LB.argmin_as_coded(look, "at").collect())
    assert got == [(11, 5.0), (11, 6.0), (12, 7.0), (14, 9.0)]


def test_types_of_text_columns(spark):
    rows = [("1", "1.5", "true", "2024-01-01", "2024-01-01 10:00:00", "x", None, "9223372036854775808", "1"),
            ("-2", "2", "False", " 2024-02-29", "2024-01-02", "", " ", "1", "n/a"), ("+3", "-1e3", "TRUE", "2024-12-31", "2024-01-02T03:04:05.678", "1", None, "2", "2")]
    df = spark.createDataFrame(rows, "i string, f string, b string, d string, t string, s string, n string, big string, mixed string")
    got = {r["column"]: (r["type"], r["n"], r["n_bad"]) for r in IN.infer_types(df).collect()}
    assert got == {"i": ("bigint", 3, 0), "f": ("double", 3, 0), "b": ("boolean", 3, 0), "d": ("date", 3, 0), "t": ("timestamp_ntz", 3, 0), "s": ("string", 2, 0),
                   "n": ("string", 0, 0), "big": ("double", 3, 0), "mixed": ("string", 3, 0)}
    types = IN.infer_types(df, max_bad=0.34)
    out = IN.typed(df, types).collect()
    assert {r["column"]: r["type"] for r in types.collect()}["mixed"] == "bigint"
    assert [(r["mixed"], r["_bad"]) for r in out] == [(1, ["big"] if types.where("column = 'big'").first()["type"] == "bigint" else []), (None, ["mixed"]), (2, [])]
    assert out[1]["d"].isoformat() == "2024-02-29" and out[0]["b"] is True
    assert IN.infer_types(spark.createDataFrame([], "a string")).first()["type"] == "string"


def test_draws_are_poisson_and_repeat(spark):
    df = spark.range(20_000).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("g"))
    w = df.select(*[c.alias(f"w{j}") for j, c in enumerate(RS.draws(["id"], F.col("g"), 7))])
    row = w.agg(*[f(f"w{j}").alias(f"{n}{j}") for j in range(RS.PER_HASH) for n, f in (("m", F.avg), ("v", F.var_pop))], F.corr("w0", "w5").alias("c")).first()
    for j in range(RS.PER_HASH):
        assert abs(row[f"m{j}"] - 1) < 0.02 and abs(row[f"v{j}"] - 1) < 0.03
    assert abs(row["c"]) < 0.02


def test_spread_is_that_of_a_share(spark):
    df = spark.range(4000).select("id", (F.col("id") % 3).cast("int").alias("label"), F.when(F.col("id") % 5 < 4, F.col("id") % 3).otherwise((F.col("id") + 1) % 3).cast("int").alias("prediction"))
    got = {r["metric"]: r for r in RS.metric_spread(df, ["id"], replicates=300).collect()}
    assert got["accuracy"]["mean"] == pytest.approx(0.8, abs=0.002)
    assert got["accuracy"]["std"] == pytest.approx((0.8 * 0.2 / 4000) ** 0.5, rel=0.15)
    assert RS.replicate_scores(df, ["id"], replicates=11).count() == 11


def test_wide_components_equal_numpy(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 40)) * np.linspace(5, 0.2, 40) @ np.linalg.qr(r.normal(size=(40, 40)))[0] + 1000
    cols = [f"c{i}" for i in range(40)]
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"{c} double" for c in cols)).repartition(5)
    df = df.unionByName(spark.createDataFrame([tuple([None] + [1.0] * 39)], df.schema))  # left out
    parts, shares, mean = WP.principal_components(df, cols, 4, iterations=30)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert mean == pytest.approx(x.mean(0))
    assert shares == pytest.approx(values[::-1][:4] / values.sum(), abs=1e-6)
    assert np.abs((parts * vectors[:, ::-1][:, :4]).sum(0)) == pytest.approx(np.ones(4), abs=1e-4)


def test_distinct_counts_without_row_copies(spark, monkeypatch):
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("few"), F.when(F.col("id") % 2 == 0, -0.0).otherwise(0.0).alias("zero"), F.lit(None).cast("string").alias("none"),
                                  F.when(F.col("id") % 3 == 0, float("nan")).otherwise(F.col("id").cast("double")).alias("nan"))
    want = {"id": 3000, "few": 7, "zero": 1, "none": 0, "nan": 2000}
    for most in (10_000, 100, 0):
        monkeypatch.setattr(PR, "SET_VALUES", most)
        assert {r["column"]: r["n_distinct"] for r in PR.profile(df).collect()} == want
    plans = []
    plans.append(PR.profile(df)._jdf.queryExecution().executedPlan().toString())
    assert "Expand" not in plans[0]
