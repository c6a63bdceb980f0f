"""Registered checks, part 2: cleaning, profiling, recodes, encoding, splits
and metrics on the driver tables (lineitem, part, customer, events). Nulls,
NaN and infinities are injected with CASE on both sides, as the driver tables
hold none in these columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayframe.functions import recode as RC
from stayframe.operators import clean as CL
from stayframe.operators.cohort import codes_text
from stayframe.operators import encode as EN
from stayframe.operators import metrics as K
from stayframe.operators import profile as PR
from stayframe.operators import resample as RS
from stayframe.operators import split as SP
from stayframe.sources import standins as S
from stayframe.sources import tables as IO

R6 = lambda c: F.round(c, 6)
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LI_KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _t(spark, d, name):
    return IO.read_table(spark, name, d)


def _li_nulls(spark, d):
    li = _t(spark, d, "lineitem")
    return li.select(*LI_KEY,
                     F.when(F.col("l_discount") >= 0.04, F.col("l_discount")).alias("disc"),
                     F.when(F.col("l_tax") >= 0.02, F.col("l_tax")).alias("tax"),
                     F.when(F.col("l_quantity") <= 45, F.col("l_quantity")).alias("qty"),
                     "l_extendedprice", F.lit(None).cast("double").alias("empty_col"))


LI_NULLS = f"""li AS (SELECT {LI_KEY_SQL},
  CASE WHEN l_discount >= 0.04 THEN l_discount END AS disc, CASE WHEN l_tax >= 0.02 THEN l_tax END AS tax,
  CASE WHEN l_quantity <= 45 THEN l_quantity END AS qty, l_extendedprice, CAST(NULL AS DOUBLE) AS empty_col
  FROM lineitem)"""


def _labelled(spark, d):
    li = _t(spark, d, "lineitem")
    label = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    pred = F.when(F.col("l_discount") < 0.03, 0).when(F.col("l_discount") < 0.07, 1).otherwise(2)
    return li.select(*LI_KEY, label.alias("label"), pred.alias("prediction"))


SPREAD_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


PRED = """p AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS label,
  CASE WHEN l_discount < 0.03 THEN 0 WHEN l_discount < 0.07 THEN 1 ELSE 2 END AS prediction FROM lineitem),
cm AS (SELECT CAST(g.i AS INTEGER) AS label, CAST(g.j AS INTEGER) AS prediction, count(p.label) AS count
  FROM (SELECT i, j FROM range(3) a(i), range(3) b(j)) g
  LEFT JOIN p ON p.label = g.i AND p.prediction = g.j GROUP BY g.i, g.j)"""


def p09_keep_first(spark, d):
    """One row per (l_orderkey, l_linenumber), which is not unique in
    lineitem; the full key breaks ties."""
    from stayframe.operators.cohort import keep_first
    li = _t(spark, d, "lineitem").select(*LI_KEY, "l_quantity", "l_extendedprice", "l_shipdate")
    return keep_first(li, ["l_orderkey", "l_linenumber"],
                      ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])


def p10_drop_listed(spark, d):
    return CL.drop_columns(_t(spark, d, "lineitem"), ["l_tax", "l_comment", "l_shipdate"])


def p11_drop_pattern(spark, d):
    li = _t(spark, d, "lineitem")
    return CL.drop_matching(li, "ship")


def p14_drop_null_rows(spark, d):
    return CL.drop_null_rows(_li_nulls(spark, d).select(*LI_KEY, "tax", "qty"))


def p15_drop_sparse_columns(spark, d):
    df, _ = CL.drop_sparse_columns(_li_nulls(spark, d).drop("empty_col"), 0.3)
    return df


def p16_drop_empty_columns(spark, d):
    df, _ = CL.drop_empty_columns(_li_nulls(spark, d).select(*LI_KEY, "qty", "empty_col"))
    return df


def p17_outlier_open(spark, d):
    return CL.range_filter(_t(spark, d, "lineitem"), {"l_quantity": (5.0, 45.0), "l_discount": (0.0, 0.1),
                                                      "absent_col": (0.0, 1.0)}).select(*LI_KEY)


def p18_outlier_null_tolerant(spark, d):
    return CL.range_filter(_li_nulls(spark, d), {"qty": (5.0, 40.0), "tax": (0.0, 0.07)}, keep_null=True) \
        .select(*LI_KEY, "qty", "tax")


def p19_one_sided(spark, d):
    return CL.one_sided_filter(_t(spark, d, "lineitem"), [("l_quantity", "<", 40.0), ("l_extendedprice", ">", 2000.0)]) \
        .select(*LI_KEY)


def p20_finite(spark, d):
    li = _t(spark, d, "lineitem")
    x = (F.when(F.col("l_tax") == 0, F.lit(float("nan"))).when(F.col("l_tax") == 0.08, F.lit(float("inf")))
         .when(F.col("l_tax") == 0.07, F.lit(None)).otherwise(F.col("l_tax")))
    flag = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), F.lit(None)) \
        .otherwise(F.col("l_returnflag"))
    df = li.select(*LI_KEY, x.alias("x"), flag.alias("flag"))
    return CL.finite_filter(df, ["x", "flag"])


def p21_type_cast(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", F.col("o_custkey").cast("int").alias("cust"),
                    IO.to_timestamp_ntz(F.col("o_orderdate").cast("string")).alias("order_ts"))


def p22_column_subset(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")


def p23_size_report(spark, d):
    return CL.size_report(_t(spark, d, "lineitem"))


def a05_value_counts(spark, d):
    return PR.value_counts(_t(spark, d, "part"), "p_type")


def a05b_value_counts_with_null(spark, d):
    return PR.value_counts(_li_nulls(spark, d), "qty", dropna=False)


def a06_class_proportions(spark, d):
    return PR.class_proportions(_t(spark, d, "lineitem"), "l_returnflag").withColumn("share", R6(F.col("share")))


def a07_null_counts(spark, d):
    return PR.null_counts(_li_nulls(spark, d).select("disc", "tax", "qty", "empty_col"))


def a08_missing_rate(spark, d):
    return PR.missing_rate_table(_li_nulls(spark, d).select("disc", "tax", "qty", "empty_col")) \
        .withColumn("missing_rate", R6(F.col("missing_rate")))


def a09_distinct_count(spark, d):
    return PR.distinct_count(_t(spark, d, "lineitem"), "l_partkey")


def a10_numeric_summary(spark, d):
    s = PR.numeric_summary(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    return s.select("column", *[R6(F.col(c)).alias(c) for c in ("median", "mean", "min", "max")])


def a11_mode(spark, d):
    return PR.mode(_t(spark, d, "part"), "p_type")


def a12_histogram(spark, d):
    h = PR.histogram(_t(spark, d, "lineitem"), "l_extendedprice", 50)
    return h.select("bin", R6(F.col("lo")).alias("lo"), R6(F.col("hi")).alias("hi"), "count")


def a13_category_counts(spark, d):
    return PR.category_counts(_t(spark, d, "part"), "p_type")


def a14_mean_std(spark, d):
    m = PR.mean_std(_t(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    return m.select("column", R6(F.col("mean")).alias("mean"), R6(F.col("std")).alias("std"))


def a15_profile(spark, d):
    p = PR.profile(_t(spark, d, "customer"))
    return p.select("column", "type", R6(F.col("missing_pct")).alias("missing_pct"), "n_distinct", "verdict",
                    *[R6(F.col(c)).alias(c) for c in ("median", "mean", "min", "max")], "mode")


def o01_sort_inside_array(spark, d):
    li = _t(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(codes_text(F.collect_set("l_returnflag")).alias("flags"))


def o02_order_by_frequency(spark, d):
    return PR.value_counts(_t(spark, d, "part"), "p_brand")


def o03_top10(spark, d):
    return PR.top_values(_t(spark, d, "part"), "p_name", 10)


def f09_substring_test(spark, d):
    return _t(spark, d, "part").select("p_partkey", RC.contains_any("p_name", ["red"]).alias("is_red"))


def f10_substring_recode(spark, d):
    rules = [(["red"], "RED THING"), (["blue", "green"], "COOL THING")]
    return _t(spark, d, "part").select("p_partkey", RC.substring_recode("p_name", rules).alias("name"))


def f11_keep_list(spark, d):
    return _t(spark, d, "part").select("p_partkey", RC.keep_list("p_type", ["ECONOMY", "SMALL"]).alias("p_type"))


SEGMENT_GROUPS = {"AUTOMOBILE": "VEHICLE", "MACHINERY": "INDUSTRY", "BUILDING": "INDUSTRY", "FURNITURE": "HOME"}


def f12_dict_recode(spark, d):
    return _t(spark, d, "customer").select("c_custkey", RC.dict_recode("c_mktsegment", SEGMENT_GROUPS).alias("grp"))


def f13_dict_recode_text_null(spark, d):
    m = dict(SEGMENT_GROUPS, HOUSEHOLD="NaN")
    return _t(spark, d, "customer").select("c_custkey", RC.dict_recode("c_mktsegment", m).alias("grp"))


def f14_binary_map(spark, d):
    return S.patients(spark, d).select("subject_id", RC.binary_map("gender", {"F": 1, "M": 0}).alias("gender"))


def f15_truncate_int(spark, d):
    return _t(spark, d, "customer").select("c_custkey", RC.truncate_int("c_acctbal").alias("acctbal"))


def f16_stringify_null(spark, d):
    return _li_nulls(spark, d).select(*LI_KEY, RC.stringify_null("qty").alias("qty"))


def p21b_nan_to_null(spark, d):
    li = _t(spark, d, "lineitem")
    x = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return CL.nan_to_null(li.select(*LI_KEY, x.alias("x")))


def e01_dummies(spark, d):
    li = _t(spark, d, "lineitem").select(*LI_KEY, "l_returnflag", "l_linestatus")
    return EN.dummies(li, ["l_returnflag", "l_linestatus"])


def _r6all(df, cols):
    return df.select(*[R6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def e02_standardize(spark, d):
    li = _t(spark, d, "lineitem").select(*LI_KEY, "l_quantity", "l_extendedprice")
    return _r6all(EN.standardize(li, ["l_quantity", "l_extendedprice"]), ["l_quantity", "l_extendedprice"])


def e03_shared_standardize(spark, d):
    li = _t(spark, d, "lineitem").select(*LI_KEY, "l_discount", "l_tax")
    return _r6all(EN.standardize_shared(li, ["l_discount", "l_tax"]), ["l_discount", "l_tax"])


def e04_null_aware_standardize(spark, d):
    li = _li_nulls(spark, d).select(*LI_KEY, "tax", "qty")
    return _r6all(EN.standardize(li, ["tax", "qty"]), ["tax", "qty"])


def e05_mean_range(spark, d):
    li = _t(spark, d, "lineitem").select(*LI_KEY, "l_quantity", "l_extendedprice")
    return _r6all(EN.mean_range_normalize(li, ["l_quantity", "l_extendedprice"]), ["l_quantity", "l_extendedprice"])


def e06_min_max(spark, d):
    li = _t(spark, d, "lineitem").select(*LI_KEY, "l_quantity", "l_discount")
    return _r6all(EN.min_max_scale(li, ["l_quantity", "l_discount"]), ["l_quantity", "l_discount"])


def e07_one_hot_label(spark, d):
    return EN.one_hot_label(_labelled(spark, d).drop("prediction"), "label", 3)


def e08_balanced_weights(spark, d):
    w = EN.balanced_weights(_labelled(spark, d).drop("prediction"), "label")
    return w.withColumn("weight", R6(F.col("weight")))


def _ev(spark, d):
    return _t(spark, d, "events").select("event_id", "event_type")


def t01_stratified_split(spark, d):
    return SP.stratified_split(_ev(spark, d), "event_type", ["event_id"], seed=44)


def t02_random_split(spark, d):
    return SP.random_split(_ev(spark, d), ["event_id"], seed=42, drop_last=True).select("event_id", "split")


def t03_shuffle_folds(spark, d):
    return SP.shuffle_folds(_ev(spark, d), "event_type", ["event_id"], seed=42, n_splits=3, test_size=0.1)


def t04_kfold(spark, d):
    return SP.kfold(_ev(spark, d), "event_type", ["event_id"], seed=44, k=3)


def t05_split_balance(spark, d):
    return SP.split_balance(t01_stratified_split(spark, d), "split", "event_type")


def u01_union_splits(spark, d):
    s = t01_stratified_split(spark, d)
    return s.where(F.col("split") == "hyperopt").unionByName(s.where(F.col("split") == "compare")) \
        .select("event_id", "split")


def k01_confusion_matrix(spark, d):
    return K.confusion_matrix(_labelled(spark, d))


def k02_accuracy(spark, d):
    return K.scores(_labelled(spark, d)).select(R6(F.col("accuracy")).alias("accuracy"), "n")


def k03_sensitivity_increase(spark, d):
    return K.scores(_labelled(spark, d)).select(R6(F.col("sensitivity_increase")).alias("sensitivity_increase"))


def k04_specificity_decrease(spark, d):
    return K.scores(_labelled(spark, d)).select(R6(F.col("specificity_decrease")).alias("specificity_decrease"))


def k05_fbeta_weighted(spark, d):
    return K.fbeta_weighted(_labelled(spark, d), beta=0.5).select(R6(F.col("fbeta_weighted")).alias("fbeta_weighted"))


def k06_classification_report(spark, d):
    r = K.classification_report(_labelled(spark, d))
    return r.select("class", *[R6(F.col(c)).alias(c) for c in ("precision", "recall", "f_score")], "support")


def k08_metric_spread(spark, d):
    """Mean and deviation of the metrics of two predictions over 200 resampled tables."""
    li = _t(spark, d, "lineitem")
    other = F.when(F.col("l_quantity") < 17, 0).when(F.col("l_quantity") < 34, 1).otherwise(2)
    df = li.select(*SPREAD_KEY, F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("label"),
                   F.when(F.col("l_discount") < 0.03, 0).when(F.col("l_discount") < 0.07, 1).otherwise(2).alias("p1"), other.alias("p2"))
    out = RS.metric_spread(df, SPREAD_KEY, replicates=200, seed=42, predictions={"by_discount": "p1", "by_quantity": "p2"})
    return out.select("model", "metric", R6(F.col("mean")).alias("mean"), R6(F.col("std")).alias("std"))


def k07_random_baseline(spark, d):
    b = K.random_baseline(_labelled(spark, d))
    return b.select(*[R6(F.col(c)).alias(c) for c in b.columns])


QUERIES = {k: v for k, v in dict(globals()).items()
           if callable(v) and k[:1] in "paofetuk" and k[1:3].isdigit() and "_" in k}


def _strata_sql(seed: int, label: str = "event_type") -> str:
    part = f"PARTITION BY {label}" if label else ""
    return f"""r AS (SELECT event_id, event_type,
      row_number() OVER ({part} ORDER BY md5(concat_ws('|', CAST(event_id AS VARCHAR), '{seed}')), event_id) AS rk,
      count(*) OVER ({part}) AS n FROM events)"""


T01 = "WITH " + _strata_sql(44) + """, s AS (SELECT *, round(n * 0.8) AS n1 FROM r),
  s2 AS (SELECT *, round((n - n1) * 0.5) AS n2 FROM s)
  SELECT event_id, event_type, CASE WHEN rk <= n1 THEN 'hyperopt' WHEN rk <= n1 + n2 THEN 'compare' ELSE 'test' END
  AS split FROM s2"""

SUMMARY = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(median({c}), 6) AS median, round(avg({c}), 6) AS mean,
       round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM lineitem""" for c in ("l_quantity", "l_extendedprice"))


def _profile_sql():
    cols = [("c_custkey", "bigint", True), ("c_name", "string", False), ("c_nationkey", "int", True),
            ("c_acctbal", "double", True), ("c_mktsegment", "string", False)]
    parts = []
    for c, ty, num in cols:
        if num:
            stats = (f"round(CAST(median({c}) AS DOUBLE), 6) AS median, round(avg({c}), 6) AS mean, "
                     f"round(CAST(min({c}) AS DOUBLE), 6) AS min, round(CAST(max({c}) AS DOUBLE), 6) AS max, "
                     "CAST(NULL AS VARCHAR) AS mode")
        else:
            stats = ("CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS min, "
                     f"CAST(NULL AS DOUBLE) AS max, (SELECT {c} FROM customer GROUP BY {c} "
                     f"ORDER BY count(*) DESC, {c} LIMIT 1) AS mode")
        parts.append(f"""SELECT '{c}' AS "column", '{ty}' AS type,
          round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_pct, count(DISTINCT {c}) AS n_distinct,
          CASE WHEN count({c}) = 0 THEN 'empty' WHEN count(DISTINCT {c}) = 1 THEN 'useless' ELSE 'ok' END AS verdict,
          {stats} FROM customer""")
    return " UNION ALL ".join(parts)


def _nulls_sql(fn: str, alias: str) -> str:
    cols = ["disc", "tax", "qty", "empty_col"]
    body = " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST({fn.format(c=c)} AS {'BIGINT' if alias == 'nulls' else 'DOUBLE'})
        AS {alias} FROM li""" for c in cols)
    return body


SQL = {
    "p09_keep_first": f"""SELECT {LI_KEY_SQL}, l_quantity, l_extendedprice, l_shipdate FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
          ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) = 1""",
    "p10_drop_listed": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
        l_discount, l_returnflag, l_linestatus FROM lineitem""",
    "p11_drop_pattern": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
        l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem""",
    "p14_drop_null_rows": f"WITH {LI_NULLS} SELECT {LI_KEY_SQL}, tax, qty FROM li WHERE tax IS NOT NULL AND qty IS NOT NULL",
    "p15_drop_sparse_columns": f"WITH {LI_NULLS} SELECT {LI_KEY_SQL}, tax, qty, l_extendedprice FROM li",
    "p16_drop_empty_columns": f"WITH {LI_NULLS} SELECT {LI_KEY_SQL}, qty FROM li",
    "p17_outlier_open": f"""SELECT {LI_KEY_SQL} FROM lineitem WHERE l_quantity > 5 AND l_quantity < 45
        AND l_discount > 0 AND l_discount < 0.1""",
    "p18_outlier_null_tolerant": f"""WITH {LI_NULLS} SELECT {LI_KEY_SQL}, qty, tax FROM li
        WHERE (qty > 5 AND qty < 40 OR qty IS NULL) AND (tax > 0 AND tax < 0.07 OR tax IS NULL)""",
    "p19_one_sided": f"SELECT {LI_KEY_SQL} FROM lineitem WHERE l_quantity < 40 AND l_extendedprice > 2000",
    "p20_finite": f"""WITH x AS (SELECT {LI_KEY_SQL},
        CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE WHEN l_tax = 0.08 THEN 'inf'::DOUBLE WHEN l_tax = 0.07 THEN NULL
             ELSE l_tax END AS x,
        CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN NULL ELSE l_returnflag END AS flag FROM lineitem)
        SELECT * FROM x WHERE x IS NOT NULL AND NOT isnan(x) AND abs(x) < 'inf'::DOUBLE AND flag IS NOT NULL""",
    "p21_type_cast": "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS cust, CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) AS order_ts FROM orders",
    "p21b_nan_to_null": f"SELECT {LI_KEY_SQL}, CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS x FROM lineitem",
    "p22_column_subset": "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem",
    "p23_size_report": """SELECT count(*) AS n_rows, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE SELECT * FROM lineitem)) AS n_cols FROM lineitem""",
    "a05_value_counts": "SELECT p_type, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY p_type",
    "a05b_value_counts_with_null": f"WITH {LI_NULLS} SELECT qty, count(*) AS count FROM li GROUP BY qty",
    "a06_class_proportions": """SELECT l_returnflag, count(*) AS count,
        round(count(*) / sum(count(*)) OVER (), 6) AS share FROM lineitem GROUP BY l_returnflag""",
    "a07_null_counts": f"WITH {LI_NULLS} " + _nulls_sql("count_if({c} IS NULL)", "nulls") +
        """ UNION ALL SELECT '__total__', CAST(count_if(disc IS NULL) + count_if(tax IS NULL) + count_if(qty IS NULL)
        + count_if(empty_col IS NULL) AS BIGINT) FROM li""",
    "a08_missing_rate": f"WITH {LI_NULLS} " + _nulls_sql("round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6)",
                                                         "missing_rate"),
    "a09_distinct_count": "SELECT count(DISTINCT l_partkey) AS n_distinct FROM lineitem",
    "a10_numeric_summary": SUMMARY,
    "a11_mode": "SELECT p_type AS mode, count(*) AS count FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1",
    "a12_histogram": """WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
        b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 50)) + 1, 50) AS INTEGER) AS bin,
              lo, (hi - lo) / 50 AS w FROM lineitem, mm)
        SELECT bin, round(any_value(lo) + (bin - 1) * any_value(w), 6) AS lo, round(any_value(lo) + bin * any_value(w), 6) AS hi,
        count(*) AS count FROM b GROUP BY bin""",
    "a13_category_counts": "SELECT p_type, count(*) AS count FROM part GROUP BY p_type",
    "a14_mean_std": " UNION ALL ".join(f"""SELECT '{c}' AS "column", round(avg({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std FROM lineitem""" for c in ("l_quantity", "l_discount")),
    "a15_profile": _profile_sql(),
    "o01_sort_inside_array": """SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), ', ') AS flags
        FROM lineitem GROUP BY l_orderkey""",
    "o02_order_by_frequency": "SELECT p_brand, count(*) AS count FROM part GROUP BY p_brand",
    "o03_top10": "SELECT p_name, count(*) AS count FROM part GROUP BY p_name ORDER BY count(*) DESC, p_name LIMIT 10",
    "f09_substring_test": "SELECT p_partkey, contains(p_name, 'red') AS is_red FROM part",
    "f10_substring_recode": """SELECT p_partkey, CASE WHEN contains(p_name, 'red') THEN 'RED THING'
        WHEN contains(p_name, 'blue') OR contains(p_name, 'green') THEN 'COOL THING' ELSE p_name END AS name FROM part""",
    "f11_keep_list": "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN p_type ELSE 'OTHER' END AS p_type FROM part",
    "f12_dict_recode": """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'VEHICLE' WHEN 'MACHINERY' THEN 'INDUSTRY'
        WHEN 'BUILDING' THEN 'INDUSTRY' WHEN 'FURNITURE' THEN 'HOME' END AS grp FROM customer""",
    "f13_dict_recode_text_null": """SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'VEHICLE'
        WHEN 'MACHINERY' THEN 'INDUSTRY' WHEN 'BUILDING' THEN 'INDUSTRY' WHEN 'FURNITURE' THEN 'HOME'
        WHEN 'HOUSEHOLD' THEN 'NaN' END AS grp FROM customer""",
    "f14_binary_map": """SELECT c_custkey AS subject_id, CASE WHEN c_acctbal < 4500 THEN 1 ELSE 0 END AS gender FROM customer
        WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
    "f15_truncate_int": "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS acctbal FROM customer",
    "f16_stringify_null": f"WITH {LI_NULLS} SELECT {LI_KEY_SQL}, coalesce(CAST(qty AS VARCHAR), 'nan') AS qty FROM li",
    "e01_dummies": f"""SELECT {LI_KEY_SQL}, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS l_returnflag_A,
        CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS l_returnflag_N,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS l_returnflag_R,
        CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS l_linestatus_F,
        CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS l_linestatus_O FROM lineitem""",
    "e02_standardize": f"""WITH s AS (SELECT avg(l_quantity) AS m1, stddev_pop(l_quantity) AS s1,
        avg(l_extendedprice) AS m2, stddev_pop(l_extendedprice) AS s2 FROM lineitem)
        SELECT {LI_KEY_SQL}, round((l_quantity - m1) / s1, 6) AS l_quantity,
        round((l_extendedprice - m2) / s2, 6) AS l_extendedprice FROM lineitem, s""",
    "e03_shared_standardize": f"""WITH u AS (SELECT l_discount AS x FROM lineitem UNION ALL SELECT l_tax FROM lineitem),
        s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM u)
        SELECT {LI_KEY_SQL}, round((l_discount - m) / sd, 6) AS l_discount, round((l_tax - m) / sd, 6) AS l_tax
        FROM lineitem, s""",
    "e04_null_aware_standardize": f"""WITH {LI_NULLS}, s AS (SELECT avg(tax) AS m1, stddev_pop(tax) AS s1,
        avg(qty) AS m2, stddev_pop(qty) AS s2 FROM li)
        SELECT {LI_KEY_SQL}, round((tax - m1) / s1, 6) AS tax, round((qty - m2) / s2, 6) AS qty FROM li, s""",
    "e05_mean_range": f"""WITH s AS (SELECT avg(l_quantity) AS m1, max(l_quantity) - min(l_quantity) AS r1,
        avg(l_extendedprice) AS m2, max(l_extendedprice) - min(l_extendedprice) AS r2 FROM lineitem)
        SELECT {LI_KEY_SQL}, round((l_quantity - m1) / r1, 6) AS l_quantity,
        round((l_extendedprice - m2) / r2, 6) AS l_extendedprice FROM lineitem, s""",
    "e06_min_max": f"""WITH s AS (SELECT min(l_quantity) AS a1, max(l_quantity) - min(l_quantity) AS r1,
        min(l_discount) AS a2, max(l_discount) - min(l_discount) AS r2 FROM lineitem)
        SELECT {LI_KEY_SQL}, round((l_quantity - a1) / r1, 6) AS l_quantity, round((l_discount - a2) / r2, 6) AS l_discount
        FROM lineitem, s""",
    "e07_one_hot_label": f"""WITH l AS (SELECT {LI_KEY_SQL}, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
        AS label FROM lineitem) SELECT *, CASE WHEN label = 0 THEN 1 ELSE 0 END AS label_0,
        CASE WHEN label = 1 THEN 1 ELSE 0 END AS label_1, CASE WHEN label = 2 THEN 1 ELSE 0 END AS label_2 FROM l""",
    "e08_balanced_weights": f"""WITH l AS (SELECT {LI_KEY_SQL}, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
        AS label FROM lineitem), c AS (SELECT label, count(*) AS c FROM l GROUP BY label)
        SELECT l.*, round((SELECT sum(c) FROM c) / ((SELECT count(*) FROM c) * c.c), 6) AS weight
        FROM l JOIN c USING (label)""",
    "t01_stratified_split": T01,
    "t02_random_split": "WITH " + _strata_sql(42, label="") + """, s AS (SELECT *, ceil(n * 0.2) AS nt FROM r)
        SELECT event_id, CASE WHEN rk <= n - nt THEN 'train' WHEN rk <= n - nt + floor(nt / 2) THEN 'validation'
        ELSE 'test' END AS split FROM s WHERE rk < n""",
    "t03_shuffle_folds": " UNION ALL ".join(
        "SELECT * FROM (WITH " + _strata_sql(42 + i) + f""" SELECT {i} AS fold, event_id, event_type,
        CASE WHEN rk > n - ceil(n * 0.1) THEN 'test' ELSE 'train' END AS role FROM r)""" for i in range(3)),
    "t04_kfold": "WITH " + _strata_sql(44) + " SELECT event_id, event_type, CAST((rk - 1) % 3 AS INTEGER) AS fold FROM r",
    "t05_split_balance": "WITH t AS (" + T01 + ") SELECT split, event_type, count(*) AS count FROM t GROUP BY ALL",
    "u01_union_splits": "WITH t AS (" + T01 + ") SELECT event_id, split FROM t WHERE split IN ('hyperopt', 'compare')",
    "k08_metric_spread": """WITH p AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y,
          CASE WHEN l_discount < 0.03 THEN 0 WHEN l_discount < 0.07 THEN 1 ELSE 2 END AS p1,
          CASE WHEN l_quantity < 17 THEN 0 WHEN l_quantity < 34 THEN 1 ELSE 2 END AS p2 FROM lineitem),
        h AS (SELECT y, p1, p2, g, md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, '42', g)) AS h FROM p, range(25) r(g)),
        u AS (SELECT y, p1, p2, 8 * g + j AS replicate, substr(h, CAST(4 * j + 1 AS BIGINT), 4) AS u FROM h, range(8) q(j)),
        w AS (SELECT replicate, y, p1, p2, sum(""" + " + ".join(f"CAST(u >= '{s}' AS BIGINT)" for s in RS.STEPS) + """) AS w FROM u GROUP BY ALL),
        c AS (SELECT 'by_discount' AS model, replicate, y, p1 AS p, w FROM w UNION ALL SELECT 'by_quantity', replicate, y, p2, w FROM w),
        m AS (SELECT model, replicate, sum(w) FILTER (y = p) / sum(w) AS accuracy, sum(w) FILTER (y = 0 AND p = 0) / sum(w) FILTER (y = 0) AS sensitivity_increase,
          sum(w) FILTER (y <> 1 AND p <> 1) / sum(w) FILTER (y <> 1) AS specificity_decrease FROM c GROUP BY ALL),
        l AS (UNPIVOT m ON accuracy, sensitivity_increase, specificity_decrease INTO NAME metric VALUE v)
        SELECT model, metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM l GROUP BY ALL""",
    "k01_confusion_matrix": f"WITH {PRED} SELECT label, prediction, count FROM cm",
    "k02_accuracy": f"""WITH {PRED} SELECT round(sum(CASE WHEN label = prediction THEN count ELSE 0 END) / sum(count), 6)
        AS accuracy, CAST(sum(count) AS BIGINT) AS n FROM cm""",
    "k03_sensitivity_increase": f"""WITH {PRED} SELECT round(sum(CASE WHEN label = 0 AND prediction = 0 THEN count END)
        / sum(CASE WHEN label = 0 THEN count END), 6) AS sensitivity_increase FROM cm""",
    "k04_specificity_decrease": f"""WITH {PRED} SELECT round(sum(CASE WHEN label <> 1 AND prediction <> 1 THEN count END)
        / sum(CASE WHEN label <> 1 THEN count END), 6) AS specificity_decrease FROM cm""",
    "k06_classification_report": f"""WITH {PRED}, r AS (SELECT c.label AS class,
        sum(CASE WHEN c.prediction = c.label THEN count END) AS tp, sum(count) AS support FROM cm c GROUP BY c.label),
        pr AS (SELECT prediction AS class, sum(count) AS predicted FROM cm GROUP BY prediction),
        x AS (SELECT class, coalesce(tp / nullif(predicted, 0), 0.0) AS p, coalesce(tp / nullif(support, 0), 0.0) AS r,
              support FROM r JOIN pr USING (class))
        SELECT class, round(p, 6) AS precision, round(r, 6) AS recall,
        round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f_score, CAST(support AS BIGINT) AS support FROM x""",
    "k07_random_baseline": """SELECT round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END), 6) AS sensitivity_increase,
        round(1 - avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END), 6) AS specificity_decrease FROM lineitem""",
}
SQL["k05_fbeta_weighted"] = SQL["k06_classification_report"].replace(
    "round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f_score, CAST(support AS BIGINT) AS support FROM x",
    "coalesce(1.25 * p * r / nullif(0.25 * p + r, 0), 0.0) AS f, support FROM x") \
    .replace(f"WITH {PRED}", f"WITH {PRED}", 1)
SQL["k05_fbeta_weighted"] = "WITH y AS (" + SQL["k05_fbeta_weighted"] + \
    ") SELECT round(sum(f * support) / sum(support), 6) AS fbeta_weighted FROM y"

CHECKS = {k: (fn, SQL.get(k)) for k, fn in QUERIES.items()}
