"""Cohort of (stay x anchor measurement) rows with inclusion criteria
(P01-P09, J01-J05, A01, F01-F03, F08).

Plan shape: every inclusion criterion depends on the stay only, so the stay
attributes (age, length of stay, flag table, diagnosis codes) are computed on
the stay table first, and the anchor events are joined last; a filter on the
flags is pushed below the big join by Catalyst. Diagnosis rows are aggregated
per admission *before* joining (1:1), not fanned out and regrouped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from stayframe.functions.time import DAY_US, age_years, epoch_us, hours_between


def item_filter(events: DataFrame, item_col: str, items, value_col: str) -> DataFrame:
    """Rows of the given item(s) whose value is present."""
    items = items if isinstance(items, (list, tuple, set)) else [items]
    cond = F.col(item_col) == items[0] if len(items) == 1 else F.col(item_col).isin(list(items))
    return events.where(cond & F.col(value_col).isNotNull())


#: Buckets over which an interval is repeated without a look at the points.
LONG_SPAN = 400


def interval_join(points: DataFrame, intervals: DataFrame, key: str, point_time: str,
                  start: str, end: str, bucket_us: int = DAY_US, how: str = "inner") -> DataFrame:
    """J01/J06 shape: ``points.key == intervals.key and start <= time <= end``.

    Both sides get a time-bucket column; each interval is repeated once per
    bucket it overlaps, so the equi-join key is (key, bucket) and a point meets
    only the intervals that overlap its own bucket. A subject with a long
    history is spread over many (key, bucket) groups instead of one (a group that is
    still large is split by AQE's skew join, on the side of its points). Where some interval
    spans more than ``LONG_SPAN`` buckets, intervals are repeated only over the span of their
    key's points, found by one more scan of these, so an open-ended one costs no
    more than the points it can meet.
    """
    if how not in ("inner", "left"):
        raise ValueError("interval_join takes how='inner' or 'left'")
    b_pt = F.floor(epoch_us(point_time) / F.lit(bucket_us)).cast("long")
    b_lo = F.floor(epoch_us(start) / F.lit(bucket_us)).cast("long")
    b_hi = F.floor(epoch_us(end) / F.lit(bucket_us)).cast("long")
    if (intervals.agg(F.max(b_hi - b_lo)).first()[0] or 0) > LONG_SPAN:
        reach = points.groupBy(F.col(key).alias("_pk")).agg(F.min(b_pt).alias("_p_lo"), F.max(b_pt).alias("_p_hi"))
        iv = intervals.join(reach, F.col(key) == F.col("_pk")).withColumn("_lo", F.greatest(b_lo, "_p_lo")).withColumn("_hi", F.least(b_hi, "_p_hi"))
        iv = iv.drop("_pk", "_p_lo", "_p_hi")
    else:
        iv = intervals.withColumn("_lo", b_lo).withColumn("_hi", b_hi)
    iv = iv.where("_lo <= _hi").withColumn("_b", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")
    pt = points.withColumn("_b", b_pt)
    cond = [pt[key] == iv[key], pt["_b"] == iv["_b"],
            pt[point_time] >= iv[start], pt[point_time] <= iv[end]]
    out = pt.join(iv, reduce(lambda a, b: a & b, cond), how)
    return out.drop(iv[key]).drop(pt["_b"]).drop(iv["_b"])


def presence_flag(df: DataFrame, flags: DataFrame, key: str, name: str, true_when_absent: bool = True) -> DataFrame:
    """J03 + P05: left join a flag table on ``key``; ``name`` is TRUE when the
    key is absent from it (the original's ``(rrt.key is null) as rrt``)."""
    f = flags.select(key).distinct().withColumn("_hit", F.lit(True))
    out = df.join(f, key, "left")
    hit = F.col("_hit").isNotNull()
    return out.withColumn(name, ~hit if true_when_absent else hit).drop("_hit")


def diagnosis_sets(diagnoses: DataFrame, keys: list[str], code_col: str, excluded: list[str],
                   with_codes: bool = True) -> DataFrame:
    """A01 + P07 per admission: ``has_excluded`` (any code in ``excluded``;
    NULL codes never match) and the sorted distinct code list. The set is
    bounded by the size of the code vocabulary."""
    aggs = [F.coalesce(F.bool_or(F.col(code_col).isin(excluded)), F.lit(False)).alias("has_excluded")]
    if with_codes:
        aggs.append(F.array_sort(F.collect_set(code_col)).alias("diagnoses"))
    return diagnoses.groupBy(*keys).agg(*aggs)


def codes_text(c) -> Column:
    """sorted codes joined with ', '."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(c), ", ")


def inclusion_flags(df: DataFrame, min_age: float, min_stay_hours: float, keep_flagged: bool = False) -> DataFrame:
    """1/0 flags. ``rrt`` is TRUE when the stay has no row in the flag
    table; by default stays with a row are excluded. ``keep_flagged=True``
    reproduces the original code, which keeps only stays *with* a row."""
    rrt_ok = (F.col("rrt") == F.lit(False)) if keep_flagged else (F.col("rrt") == F.lit(True))
    return df.select(
        "*",
        F.when(F.col("age") >= min_age, 1).otherwise(0).alias("inclusion_age"),
        F.when(F.col("length_of_stay") >= min_stay_hours, 1).otherwise(0).alias("inclusion_length_of_stay"),
        F.when(rrt_ok, 1).otherwise(0).alias("inclusion_rrt"),
        F.when(F.col("has_excluded"), 0).otherwise(1).alias("inclusion_diagnoses"),
    )


def stay_attributes(stays: DataFrame, patients: DataFrame, flags: DataFrame, diagnoses: DataFrame, *,
                    excluded_codes: list[str], min_age: float, min_stay_hours: float,
                    keep_flagged: bool = False, with_codes: bool = True) -> DataFrame:
    """Per stay: age, length of stay, flag, excluded-code test and inclusion flags."""
    diag = diagnosis_sets(diagnoses, ["subject_id", "hadm_id"], "icd9_code", excluded_codes, with_codes)
    s = (stays.join(patients.select("subject_id", "dob"), "subject_id")       # J02
         .join(diag, ["subject_id", "hadm_id"]))                              # J04, 1:1 after A01
    s = presence_flag(s, flags, "icustay_id", "rrt")                          # J03, P05
    s = s.select("*", hours_between("intime", "outtime").alias("length_of_stay"),   # F01
                 age_years("dob", "intime").alias("age"))                          # F03
    return inclusion_flags(s, min_age, min_stay_hours, keep_flagged)


def anchor_rows(stays_attr: DataFrame, events: DataFrame, *, anchor_item, item_col: str = "itemid",
                value_col: str = "valuenum", time_col: str = "storetime", id_col: str = "event_id") -> DataFrame:
    """Anchor measurements inside each stay, both ends inclusive."""
    ev = item_filter(events, item_col, anchor_item, value_col).select(
        "subject_id", F.col(value_col).alias("creatinine"), F.col(time_col).alias("creatinine_time"),
        F.col(id_col).alias("anchor_event_id"))
    return interval_join(ev, stays_attr, "subject_id", "creatinine_time", "intime", "outtime")


COHORT_COLUMNS = ["subject_id", "icustay_id", "hadm_id", "intime", "outtime", "creatinine", "creatinine_time",
                  "anchor_event_id", "age", "length_of_stay", "rrt", "diagnoses"]


def cohort(stays: DataFrame, events: DataFrame, patients: DataFrame, flags: DataFrame, diagnoses: DataFrame, *,
           anchor_item, excluded_codes: list[str], min_age: float, min_stay_hours: float,
           keep_flagged: bool = False, with_codes: bool = True) -> DataFrame:
    """All candidate anchor rows with their inclusion flags (before P08)."""
    attrs = stay_attributes(stays, patients, flags, diagnoses, excluded_codes=excluded_codes, min_age=min_age,
                            min_stay_hours=min_stay_hours, keep_flagged=keep_flagged, with_codes=with_codes)
    rows = anchor_rows(attrs, events, anchor_item=anchor_item)
    flags_cols = [c for c in rows.columns if c.startswith("inclusion_")]
    cols = [c for c in COHORT_COLUMNS if c in rows.columns]
    return rows.select(*cols, *flags_cols)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per ``keys``: the row with the smallest ``order``.

    Done as an aggregation (``min_by`` over a struct of the other columns),
    which combines map-side, so a key with very many duplicates is reduced in
    every task before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    best = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(*order_cols)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]) \
             .select(*df.columns)


def apply_inclusion(df: DataFrame, keys: list[str] = ("icustay_id", "creatinine_time"),
                    order: list | None = None, observations: tuple[Observation, ...] = ()) -> DataFrame:
    """Keep rows whose every ``inclusion*`` column is 1, drop those columns,
    and keep one row per (stay, anchor time). The flags are constant per stay,
    so filtering before the de-duplication gives the same rows and lets the
    filter reach the stay table. ``observations`` (up to three) receive the
    counts ``initial``, ``included`` and ``unique`` when the result is computed.
    Without ``anchor_event_id`` an ``order`` is required: the kept row must not be arbitrary."""
    names = ("initial", "included", "unique")

    def observed(d, i):
        return d.observe(observations[i], F.count(F.lit(1)).alias(names[i])) if i < len(observations) else d

    flags = [c for c in df.columns if "inclusion" in c]
    df = observed(df, 0)
    kept = df.where(reduce(lambda a, b: a & b, [F.col(c) == 1 for c in flags])) if flags else df
    kept = observed(kept.drop(*flags), 1)
    if order is None:
        if "anchor_event_id" not in kept.columns:
            raise ValueError("order is required without anchor_event_id")
        order = [-F.col("anchor_event_id")]   # Q4: among duplicates of (stay, time) keep the highest event id
    return observed(keep_first(kept, list(keys), order), 2)


def attach_admission(df: DataFrame, admissions: DataFrame, patients: DataFrame, match: str = "admission") -> DataFrame:
    """J05 + static attributes: ethnicity, diagnosis (admission) and gender
    (patient). ``match='admission'`` joins on (subject, admission); ``'subject'``
    reproduces the original fan-out over every admission of the patient."""
    keys = ["subject_id", "hadm_id"] if match == "admission" else ["subject_id"]
    adm = admissions.select(*keys, "ethnicity", "diagnosis")
    return df.join(adm, keys).join(patients.select("subject_id", "gender"), "subject_id")
