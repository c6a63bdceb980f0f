"""Plan shape: no Cartesian / nested-loop joins anywhere, filters and column
pruning reach the Parquet scans, and the as-of step scans the events once."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FAST = [k for k in sorted(E.queries()) if k[0] not in "mg" and k not in ("e09_assemble", "e10_pca", "o04_best_of_grid", "pipeline") and k[:2] != "op"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", FAST)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_item_filter_pushed_to_scan(spark):
    from stayframe.plans import registry_cohort as R
    plan = _plan(R.p02_item_filter(spark, SF))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase), IsNotNull(value)]" in plan
    assert "ReadSchema: struct<event_id:bigint,event_type:string,value:double>" in plan


def test_inclusion_filter_below_interval_join(spark):
    from stayframe.plans import registry_cohort as R
    plan = _plan(R.p08_apply_inclusion(spark, SF))
    join_at = plan.index("(creatinine_time")           # the interval join residual
    # the stay-length criterion is applied on the stay side, under the join
    assert plan.index(">= 192.0)", join_at) > join_at


def _passes(monkeypatch, run):
    """Plans of the counts that the as-of step takes, and of the frames that it writes."""
    from stayframe.operators import asof as A
    counts, plans, count, write = [], [], A._few, A._materialize

    def counted(df, n):
        counts.append(_plan(df))
        return count(df, n)

    def record(df):
        plans.append(_plan(df))
        return write(df)

    monkeypatch.setattr(A, "_few", counted)
    monkeypatch.setattr(A, "_materialize", record)
    run()
    return counts, plans


def _events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id AS subject_id", "event_id", "event_type", "ts", "value")


@pytest.mark.parametrize("hot_rows", [2_000_000, 20, 1])
def test_asof_scans_and_shuffles_feature_events_once(spark, monkeypatch, hot_rows):
    from stayframe.operators import asof as A
    ev = _events(spark)
    anchors = spark.range(50).selectExpr("id AS subject_id", "id AS aid", "timestamp_ntz'2024-02-01 00:00:00' AS at")

    def run():
        A.asof_latest(anchors, ev.where("event_type IN ('click', 'view')"), key=["subject_id"], anchor_id=["aid"], anchor_time="at",
                      event_time="ts", value_col="value", item_col="event_type", tiebreak="event_id", hot_rows=hot_rows)

    counts, (passed,) = _passes(monkeypatch, run)
    # one light count without features; only where that finds a hot bucket, one of the rows themselves. They shuffle partial counts only
    assert len(counts) == (2 if hot_rows == 1 else 1)
    for counted in counts:
        assert counted.count("FileScan") == 1 and "partial_count" in counted and counted.count("Exchange hashpartitioning") == 1
    # the pass itself: one scan of the events, one shuffle of events and anchors together
    assert passed.count("FileScan") == 1 and passed.count("Exchange") - passed.count("BroadcastExchange") == 1
    assert "SortMergeJoin" not in passed


def test_day_offsets_join_few_times(spark):
    from stayframe.operators import label as L
    df = _events(spark).selectExpr("subject_id", "ts", "value", "event_id")
    plan = _plan(L.day_offsets(df, "subject_id", "ts", "value", ["event_id"]))
    assert plan.count("Window") <= 4 and plan.count("FileScan") <= 1
