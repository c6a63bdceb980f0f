"""Metamorphic checks: bucketed operators equal brute force, also with one
hot key holding most rows, for any bucket width and partition count."""

import random
from datetime import datetime, timedelta

import pandas as pd

from stayframe.operators import asof as A
from stayframe.operators import offsets as O
from stayframe.operators import split as SP

T0 = datetime(2024, 1, 1)


def _random_events(n, hot_share=0.6, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        subj = 0 if rnd.random() < hot_share else rnd.randint(1, 5)
        t = T0 + timedelta(seconds=rnd.randint(0, 6 * 86400))
        rows.append((i, subj, t, float(rnd.randint(0, 100))))
    return rows


def test_asof_matches_brute_force_with_hot_key(spark):
    rows = _random_events(600)
    ev = spark.createDataFrame(rows, "event_id long, subject_id long, ts timestamp_ntz, value double")
    an = ev.where("event_id % 7 = 0").selectExpr("subject_id", "event_id AS aid", "ts AS at", "ts - INTERVAL 1 DAY AS lo")
    fe = ev.where("event_id % 7 <> 0").withColumn("item", ev.event_id % 3)
    expected = {}
    pdf = pd.DataFrame(rows, columns=["event_id", "subject_id", "ts", "value"])
    feats = pdf[pdf.event_id % 7 != 0]
    for r in pdf[pdf.event_id % 7 == 0].itertuples():
        c = feats[(feats.subject_id == r.subject_id) & (feats.ts <= r.ts) & (feats.ts >= r.ts - timedelta(days=1))]
        if len(c):
            best = c.sort_values(["ts", "event_id"]).iloc[-1]
            expected[r.event_id] = best.value
        else:
            expected[r.event_id] = None
    for bucket in (3_600_000_000, 86_400_000_000 * 3):
        for parts in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = A.asof_latest(an, fe, key=["subject_id"], anchor_id=["aid"], anchor_time="at", event_time="ts",
                                value_col="value", item_col="item", tiebreak="event_id", lower_bound="lo",
                                bucket_us=bucket).collect()
            assert {r.aid: r.value for r in got} == expected
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_range_max_matches_brute_force(spark):
    rows = _random_events(500, seed=3)
    df = spark.createDataFrame(rows, "id long, stay long, t timestamp_ntz, v double")
    pdf = pd.DataFrame(rows, columns=["id", "stay", "t", "v"])
    D = timedelta(days=1)
    got = {r.id: (r.tomorrow, r.yesterday, r.before_yesterday)
           for r in O.range_max(df, ["stay"], "t", "v", ["id"], O.DAY_FRAMES).collect()}
    for r in pdf.itertuples():
        s = pdf[pdf.stay == r.stay]
        dt = s.t - r.t

        def mx(lo, hi):
            m = s[(dt >= lo) & (dt < hi)].v
            return None if m.empty else float(m.max())
        assert got[r.id] == (mx(D, 2 * D), mx(-D, timedelta(0)), mx(-2 * D, -D))


def test_strata_rank_is_exact(spark):
    rows = [(i, "a" if i % 10 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, cls string")
    r = SP.strata_rank(df, ["cls"], ["id"], seed=44).toPandas()
    for cls, g in r.groupby("cls"):
        assert sorted(g._rank) == list(range(1, len(g) + 1))
        assert (g._n == len(g)).all()
    s = SP.stratified_split(df, "cls", ["id"], seed=44).groupBy("cls", "split").count().toPandas()
    a = dict(zip(s[s.cls == "a"].split, s[s.cls == "a"]["count"]))
    assert a == {"hyperopt": 2160, "compare": 270, "test": 270}


def test_exact_quantiles_match_numpy(spark, monkeypatch):
    import numpy as np

    from stayframe.operators import profile as PR
    rnd = random.Random(11)
    vals_a = [float(rnd.randint(0, 50)) for _ in range(997)]             # many duplicates, odd n
    vals_b = [rnd.gauss(0, 1e6) for _ in range(1000)] + [42.0] * 600     # a hot value, even n
    rows = [(i, vals_a[i] if i < len(vals_a) else None, vals_b[i]) for i in range(len(vals_b))]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    for bins in (1024, 4):
        monkeypatch.setattr(PR, "QUANTILE_BINS", bins)
        for q in (0.5, 0.1, 0.9):
            got = PR.exact_quantiles(df, ["a", "b"], q)
            assert abs(got["a"] - float(np.quantile(vals_a, q))) < 1e-9
            assert abs(got["b"] - float(np.quantile(vals_b, q))) < 1e-6


def test_fixed_size_sample_is_smallest_hashes(spark):
    import hashlib

    from stayframe.sources.tables import fixed_size_sample
    df = spark.range(5000).withColumnRenamed("id", "k")
    got = sorted(r.k for r in fixed_size_sample(df, 37, ["k"], seed=42).collect())
    want = sorted(sorted(range(5000), key=lambda k: (hashlib.md5(f"{k}|42".encode()).hexdigest(), k))[:37])
    assert got == want


def test_asof_hot_bucket_split_matches_brute_force(spark):
    rows = _random_events(800, hot_share=0.8, seed=21)
    ev = spark.createDataFrame(rows, "event_id long, subject_id long, ts timestamp_ntz, value double")
    an = ev.where("event_id % 5 = 0").selectExpr("subject_id", "event_id AS aid", "ts AS at")
    fe = ev.where("event_id % 5 <> 0").withColumn("item", ev.event_id % 3)
    pdf = pd.DataFrame(rows, columns=["event_id", "subject_id", "ts", "value"])
    feats = pdf[pdf.event_id % 5 != 0]
    expected = {}
    for r in pdf[pdf.event_id % 5 == 0].itertuples():
        c = feats[(feats.subject_id == r.subject_id) & (feats.ts <= r.ts)]
        expected[r.event_id] = c.sort_values(["ts", "event_id"]).iloc[-1].value if len(c) else None
    # whole 6-day range in one bucket, so the hot subject's bucket must be cut
    got = A.asof_latest(an, fe, key=["subject_id"], anchor_id=["aid"], anchor_time="at", event_time="ts",
                        value_col="value", item_col="item", tiebreak="event_id",
                        bucket_us=8 * 86_400_000_000, hot_rows=40).collect()
    assert {r.aid: r.value for r in got} == expected


def test_range_max_hot_bucket_split_matches_brute_force(spark):
    rows = _random_events(500, hot_share=0.8, seed=5)
    df = spark.createDataFrame(rows, "id long, stay long, t timestamp_ntz, v double")
    pdf = pd.DataFrame(rows, columns=["id", "stay", "t", "v"])
    D = timedelta(days=1)
    got = {r.id: (r.tomorrow, r.yesterday, r.before_yesterday)
           for r in O.range_max(df, ["stay"], "t", "v", ["id"], O.DAY_FRAMES, hot_rows=15).collect()}
    for r in pdf.itertuples():
        s = pdf[pdf.stay == r.stay]
        dt = s.t - r.t

        def mx(lo, hi):
            m = s[(dt >= lo) & (dt < hi)].v
            return None if m.empty else float(m.max())
        assert got[r.id] == (mx(D, 2 * D), mx(-D, timedelta(0)), mx(-2 * D, -D))


def test_split_and_folds_rank_once(spark):
    rows = [(i, "a" if i % 10 else None if i % 20 else "b", float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, cls string, v double")
    both = SP.split_and_folds(df, "cls", ["id"], seed=44, k=3)
    want = SP.kfold(SP.stratified_split(df, "cls", ["id"], seed=44), "cls", ["id"], seed=44, k=3)
    assert both.columns == want.columns and sorted(both.collect(), key=lambda r: r.id) == sorted(want.collect(), key=lambda r: r.id)
    # the rows' values are shuffled once: the offsets join where the window has put the rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = SP.split_and_folds(df, "cls", ["id"], seed=44, k=3)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    join = next(k for k, line in enumerate(lines) if "SortMergeJoin" in line)
    below = lines[join:next(k for k, line in enumerate(lines) if k > join and "Scan" in line)]
    assert sum("Exchange" in line for line in below) == 1
