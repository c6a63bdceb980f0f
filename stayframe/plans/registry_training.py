"""Registered checks, part 4: the preparation of training sets (dense, fitted on
the split, and with NULLs kept) and the exploration, on lineitem in the columns
of a labelled dataset. NULLs and NaN are put in on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayframe import presets as P
from stayframe.plans import training as T
from stayframe.plans.explore import explore
from stayframe.sources import tables as IO

ETHNICITIES = list(P.ETHNICITY_GROUPS)[:6] + ["NOT IN THE MAP"]
DIAGNOSES = ["FEVER;COUGH", "DYSPNEA", "PNEUMONIA", "BROKEN LEG", "SEPSIS"]
DELAYS = ["sodium_delay", "ph_blood_delay"]


def labelled(spark, d):
    """lineitem with the names of a labelled dataset."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (F.col(c) % len(values) + 1).cast("int"))
    return IO.read_table(spark, "lineitem", d).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("icustay_id"),
        (F.col("l_quantity") / 2).alias("creatinine"), F.when(F.col("l_linenumber") == 7, F.lit(float("nan"))).otherwise(F.col("l_tax") * 1000 + 20).alias("age"),
        F.when(F.col("l_linenumber") != 6, F.col("l_discount") * 100 + 4.5).alias("ph_blood"),
        F.when(F.col("l_linenumber") <= 2, F.col("l_quantity")).alias("sodium"), F.lit(None).cast("double").alias("albumin"),
        (F.col("l_extendedprice") / 10).alias("sodium_delay"), (F.col("l_quantity") * 60).alias("ph_blood_delay"),
        pick(ETHNICITIES, "l_partkey").alias("ethnicity"), F.when(F.col("l_linenumber") != 5, pick(DIAGNOSES, "l_suppkey")).alias("diagnosis"),
        F.when(F.col("l_partkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"))


def _checked(df):
    """The prepared columns in one order, rounded; the content key left out."""
    scaled = [c for c in df.columns if c in (*P.NUMERIC_SCALED, *DELAYS, "sodium")]
    return df.select(*[F.round(c, 6).alias(c) if c in scaled else F.col(c).alias(c.replace(" ", "_").replace("/", "_").lower()) for c in df.columns if c != T.ROW_KEY])


def n01_prepare_dense(spark, d):
    return _checked(T.prepare_dense(labelled(spark, d)))


def n02_prepare_with_nulls(spark, d):
    return _checked(T.prepare_with_nulls(labelled(spark, d)))


def n03_fit_on_split(spark, d):
    """Mean of the scaled columns on the training part, which the scalers were fitted on."""
    df = T.prepare_dense(labelled(spark, d), fit_on_split=True)
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[
        F.when(F.first("split") == "hyperopt", F.round(F.abs(F.avg(c)), 6)).alias(c) for c in ("creatinine", "age", "ph_blood")])


def n04_explore(spark, d):
    """Histogram of one numeric column of a whole-table exploration."""
    _, tables = explore(labelled(spark, d).select("icustay_id", "creatinine", "gender"), ["icustay_id"], sample_n=None, bins=10)
    return tables["creatinine"].select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "count")


def _case(values, key):
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_LABELLED = f"""x AS (SELECT l_quantity / 2 AS creatinine, CASE WHEN l_linenumber <> 7 THEN l_tax * 1000 + 20 END AS age,
  CASE WHEN l_linenumber <> 6 THEN l_discount * 100 + 4.5 END AS ph_blood, CASE WHEN l_linenumber <= 2 THEN l_quantity END AS sodium,
  l_extendedprice / 10 AS sodium_delay, l_quantity * 60 AS ph_blood_delay, {_case(ETHNICITIES, 'l_partkey')} AS ethnicity,
  CASE WHEN l_linenumber <> 5 THEN {_case(DIAGNOSES, 'l_suppkey')} END AS diagnosis,
  CASE WHEN l_partkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label FROM lineitem)"""
_GROUPS = "CASE ethnicity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.ETHNICITY_GROUPS.items() if k in ETHNICITIES) + " END"
_DIAGNOSIS = """CASE WHEN diagnosis = 'FEVER;COUGH' THEN 'SEPSIS' WHEN diagnosis = 'DYSPNEA' THEN 'RESPIRATORY FAILURE'
  WHEN diagnosis IN ('PNEUMONIA', 'SEPSIS') THEN diagnosis ELSE 'OTHER' END"""


def _dummies_sql(nulls: bool) -> str:
    groups = sorted({P.ETHNICITY_GROUPS[e] for e in ETHNICITIES if e in P.ETHNICITY_GROUPS})
    names = [("ethnicity", g) for g in groups] + [("diagnosis", g) for g in ("OTHER", "PNEUMONIA", "RESPIRATORY FAILURE", "SEPSIS")] + [("gender", g) for g in "FM"]
    return ", ".join(f"CASE WHEN {c} = '{v}' THEN 1 ELSE 0 END AS {(c + '_' + v).replace(' ', '_').replace('/', '_').lower()}" for c, v in names)


def _scaled_sql(columns, shared):
    own = ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in columns)
    pair = ", ".join(f"round(({c} - m) / s, 6) AS {c}" for c in shared)
    return f"{own}, {pair}"


def _prepared_sql(kept: str, columns: list[str], nulls: bool) -> str:
    return f"""WITH {_LABELLED}, r AS (SELECT * EXCLUDE (ethnicity, diagnosis), {_GROUPS} AS ethnicity, {_DIAGNOSIS} AS diagnosis FROM x WHERE {kept}),
      both_ AS (SELECT avg(v) AS m, stddev_pop(v) AS s FROM (SELECT unnest([sodium_delay, ph_blood_delay]) AS v FROM r))
      SELECT {_scaled_sql(columns, DELAYS)}, label, {_dummies_sql(nulls)} FROM r, both_"""


_RANGE = "creatinine > 0 AND creatinine < 20 AND age > 0 AND age < 110 AND ph_blood > 0 AND ph_blood < 14"
_NULL_RANGE = "creatinine > 0 AND creatinine < 20 AND (age IS NULL OR age > 0 AND age < 110) AND (ph_blood IS NULL OR ph_blood > 0 AND ph_blood < 14)"

CHECKS = {
    "n01_prepare_dense": (n01_prepare_dense, _prepared_sql(f"diagnosis IS NOT NULL AND {_RANGE}", ["creatinine", "age", "ph_blood"], False)),
    "n02_prepare_with_nulls": (n02_prepare_with_nulls, _prepared_sql(_NULL_RANGE, ["creatinine", "age", "ph_blood", "sodium"], True)),
    "n03_fit_on_split": (n03_fit_on_split, f"""WITH {_LABELLED}, c AS (SELECT label, count(*) AS n FROM x WHERE diagnosis IS NOT NULL AND {_RANGE} GROUP BY label),
      p AS (SELECT n, round(0.8 * n) AS a, round(0.5 * (n - round(0.8 * n))) AS b FROM c)
      SELECT 'hyperopt' AS split, CAST(sum(a) AS BIGINT) AS n, 0.0::DOUBLE AS creatinine, 0.0::DOUBLE AS age, 0.0::DOUBLE AS ph_blood FROM p
      UNION ALL SELECT 'compare', CAST(sum(b) AS BIGINT), NULL, NULL, NULL FROM p UNION ALL SELECT 'test', CAST(sum(n - a - b) AS BIGINT), NULL, NULL, NULL FROM p"""),
    "n04_explore": (n04_explore, """WITH x AS (SELECT l_quantity / 2 AS v FROM lineitem), r AS (SELECT min(v) AS lo, max(v) AS hi FROM x)
      SELECT bin, round(lo + (bin - 1) * (hi - lo) / 10, 6) AS lo, round(lo + bin * (hi - lo) / 10, 6) AS hi, count(*) AS count
      FROM (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 10)) + 1, 10) AS INTEGER) AS bin, lo, hi FROM x, r) GROUP BY ALL"""),
}
