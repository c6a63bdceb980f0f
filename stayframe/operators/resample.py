"""How far a metric moves when the rows it is computed on change (G04 with K02-K04): Poisson resampling.

Every row stands in every replicate a Poisson(1) distributed number of times, drawn from an MD5 hash of its key, the seed
and the replicate, so draws repeat and need no second table. One digest gives ``PER_HASH`` replicates. All replicates are one
aggregation: (replicate group, model, truth, prediction) with a weighted count per replicate, combined map-side, so
the shuffle holds a few cells per replicate and task and no row is copied between machines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_HASH, DIGITS = 8, 4
#: P(X <= k) of the Poisson distribution of mean 1, in units of 1/65536: a draw of four hex digits is at least k + 1 from there on.
STEPS = [format(math.ceil(16 ** DIGITS * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))), "04x") for k in range(7)]
METRICS = ("accuracy", "sensitivity_increase", "specificity_decrease")


def draws(key_cols: list[str], group: Column, seed: int) -> list[Column]:
    """Numbers of times that a row stands in the replicates of a group. Hex digits of equal length sort like numbers."""
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed)), group.cast("string")))
    at = [F.substring(h, DIGITS * j + 1, DIGITS) for j in range(PER_HASH)]
    return [sum((u >= F.lit(s)).cast("long") for s in STEPS) for u in at]


def replicate_scores(df: DataFrame, key_cols: list[str], replicates: int = 200, seed: int = 42, label: str = "label",
                     predictions: dict[str, str] | None = None) -> DataFrame:
    """(model, replicate, accuracy, sensitivity_increase, specificity_decrease) of three-class predictions. ``predictions``
    maps models to their columns; all models are scored on the same draws. Undefined metrics are NULL."""
    predictions = predictions or {"model": "prediction"}
    groups = -(-replicates // PER_HASH)
    drawn = df.select(*key_cols, F.col(label).alias("_y"), F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).alias("p")) for m, c in predictions.items()]).alias("_models"),
                      F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_g"))
    drawn = drawn.select("_g", "_y", "_models", *[w.alias(f"_w{j}") for j, w in enumerate(draws(key_cols, F.col("_g"), seed))])
    cells = drawn.select("*", F.explode("_models").alias("_m")).groupBy("_g", F.col("_m.m").alias("model"), "_y", F.col("_m.p").alias("_p")) \
        .agg(*[F.sum(f"_w{j}").alias(f"_w{j}") for j in range(PER_HASH)])
    long = cells.select("model", "_y", "_p", "_g", F.posexplode(F.array(*[f"_w{j}" for j in range(PER_HASH)])).alias("_j", "_w")) \
        .withColumn("replicate", F.col("_g") * PER_HASH + F.col("_j")).where(F.col("replicate") < replicates)
    part = lambda cond: F.sum(F.when(cond, F.col("_w")).otherwise(0))
    y, p = F.col("_y"), F.col("_p")
    return long.groupBy("model", "replicate").agg(
        F.try_divide(part(y == p), F.sum("_w")).alias("accuracy"),
        F.try_divide(part((y == 0) & (p == 0)), part((y == 0) & p.isin(0, 1, 2))).alias("sensitivity_increase"),
        F.try_divide(part((y != 1) & (p != 1)), part((y != 1) & p.isin(0, 1, 2))).alias("specificity_decrease"))


def metric_spread(df: DataFrame, key_cols: list[str], replicates: int = 200, seed: int = 42, label: str = "label",
                  predictions: dict[str, str] | None = None) -> DataFrame:
    """(model, metric, mean, std) over the replicates; ``std`` is the sample deviation."""
    scores = replicate_scores(df, key_cols, replicates, seed, label, predictions)
    wide = scores.groupBy("model").agg(*[f(m).alias(f"{m}_{n}") for m in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std")) for m in METRICS])
    return wide.select("model", F.explode(rows).alias("r")).select("model", "r.*")
