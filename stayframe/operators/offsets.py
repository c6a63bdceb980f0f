"""Range-frame aggregates split by time bucket.

``range_max`` gives, for every row, the max of ``value`` over the rows of the
same partition whose time lies in ``[t + lo, t + hi)``. It equals
``max(value) OVER (PARTITION BY p ORDER BY t_us RANGE BETWEEN lo AND hi-1)``,
but a partition key is never processed by one task: with bucket width ``h``
(``lo`` and ``hi`` multiples of ``h``) the interval is

    suffix of bucket floor((t+lo)/h)   (events at time >= t+lo)
  + whole buckets strictly between      (from per-bucket maxima)
  + prefix of bucket floor((t+hi)/h)   (events at time <  t+hi)

Suffix and prefix are running maxima inside (partition, bucket) groups, over
the events plus one probe row per (row, frame) placed at ``t+lo`` / ``t+hi``.
The middle part is a RANGE window over the per-bucket maxima (one row per
non-empty bucket). Suffix, prefix and bucket maxima come out of one window
pass; its output (probes + one row per bucket) is checkpointed and read by
the small follow-up steps. A bucket with more than ``hot_rows`` rows is cut
into equal-time sub-buckets first; the suffix / prefix inside it is then
completed from the maxima of the later / earlier sub-buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayframe.functions.time import DAY_US, HOUR_US, epoch_us
from stayframe.operators.asof import DEFAULT_HOT_ROWS, split_hot_buckets

DEFAULT_BUCKET_US = 6 * HOUR_US

# Day-offset frames of the label stage: floor(dt / 1 day) == k.
DAY_FRAMES = {
    "tomorrow": (DAY_US, 2 * DAY_US),
    "yesterday": (-DAY_US, 0),
    "before_yesterday": (-2 * DAY_US, -DAY_US),
}


def range_max(df: DataFrame, partition: list[str], time_col: str, value_col: str, row_id: list[str],
              frames: dict[str, tuple[int, int]], bucket_us: int = DEFAULT_BUCKET_US,
              prefix: str = "", materialize: bool = True,
              hot_rows: int | None = DEFAULT_HOT_ROWS) -> DataFrame:
    """Adds one column ``prefix + name`` per frame. ``row_id`` must be unique."""
    for lo, hi in frames.values():
        if lo % bucket_us or hi % bucket_us or hi <= lo:
            raise ValueError("frame bounds must be increasing multiples of the bucket width")
    t = epoch_us(time_col)
    bucket = lambda c: F.floor(c / F.lit(bucket_us)).cast("long")
    # one scan of the input: each row emits itself as an event (when it has a
    # value) and one probe per (frame, side) at t+lo / t+hi
    rid = F.struct(*[F.col(c) for c in row_id])
    items = [F.struct(F.lit(0).alias("off"), F.lit(1).alias("k"), F.lit(None).cast("string").alias("q"),
                      F.lit(None).cast("int").alias("side"))]
    for name, (lo, hi) in frames.items():
        for side, off in ((0, lo), (1, hi)):
            items.append(F.struct(F.lit(off).cast("long").alias("off"), F.lit(0).alias("k"), F.lit(name).alias("q"),
                                  F.lit(side).alias("side")))
    base = df.select(*partition, rid.alias("_rid"), t.alias("_t0"), F.col(value_col).cast("double").alias("_v0"))
    base = base.withColumn("_v0", F.when(~F.isnan("_v0"), F.col("_v0")))   # NaN is missing
    u = (base.select("*", F.explode(F.array(*items)).alias("_e"))
         .where((F.col("_e.k") == 0) | (F.col("_v0").isNotNull() & F.col("_t0").isNotNull()))
         .select(*partition, (F.col("_t0") + F.col("_e.off")).alias("_t"), F.col("_e.k").alias("_k"),
                 F.when(F.col("_e.k") == 1, F.col("_v0")).alias("_v"), F.col("_e.q").alias("_q"),
                 F.col("_e.side").alias("_side"), F.when(F.col("_e.k") == 0, F.col("_rid")).alias("_rid"))
         .withColumn("_b", bucket(F.col("_t"))))
    # sub-bucket key: equal to the bucket unless the bucket is hot (then cut in time)
    u = u.withColumn("_bs", F.col("_b"))
    if hot_rows:
        u = split_hot_buckets(u, partition, bucket_us, hot_rows, bucket_col="_bs")
    u = u.repartition(*partition, "_bs")

    # one window pass per (partition, sub-bucket): suffix max (side 0, events
    # at or after the probe), prefix max (side 1, strictly before), the
    # sub-bucket max and a first-row mark; only probes and one row per
    # sub-bucket leave it
    w = Window.partitionBy(*partition, "_bs").orderBy("_t", "_k")
    after = F.max("_v").over(w.rowsBetween(0, Window.unboundedFollowing))
    before = F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    s1 = (u.select(*partition, "_b", "_bs", "_k", "_q", "_side", "_rid",
                   F.when(F.col("_side") == 0, after).otherwise(before).alias("_edge"),
                   whole.alias("_smax"), (F.row_number().over(w) == 1).alias("_first"))
          .where((F.col("_k") == 0) | F.col("_first")))
    if materialize:
        from stayframe.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        s1 = s1.checkpoint(eager=True)
    subs = s1.where(F.col("_first")).select(*partition, "_b", "_bs", "_smax")
    # inside a cut bucket: the later sub-buckets complete a suffix, the
    # earlier ones a prefix (windows over one row per sub-bucket)
    wsub = Window.partitionBy(*partition, "_b").orderBy("_bs")
    carry = subs.select(*partition, "_b", "_bs",
                        F.max("_smax").over(wsub.rowsBetween(Window.unboundedPreceding, -1)).alias("_fwd"),
                        F.max("_smax").over(wsub.rowsBetween(1, Window.unboundedFollowing)).alias("_bwd"))
    edge = (s1.where(F.col("_k") == 0).join(carry, [*partition, "_b", "_bs"], "left")
            .withColumn("_edge", F.when(F.col("_side") == 0, F.greatest("_edge", "_bwd"))
                        .otherwise(F.greatest("_edge", "_fwd"))))
    summary = subs.groupBy(*partition, "_b").agg(F.max("_smax").alias("_bmax"))

    # whole buckets strictly inside each frame: all frames in one pass over the
    # summary (equal windows are computed once), joined once
    inner = {}
    for name, (lo, hi) in frames.items():
        n = (hi - lo) // bucket_us
        if n > 1:
            inner[name] = F.max("_bmax").over(Window.partitionBy(*partition).orderBy("_b").rangeBetween(1, n - 1))
    mid = F.lit(None).cast("double")
    if inner:
        edge = edge.join(summary.select(*partition, "_b", *[w.alias(f"_mid_{name}") for name, w in inner.items()]), [*partition, "_b"], "left")
        for name in inner:
            mid = F.when((F.col("_q") == name) & (F.col("_side") == 0), F.col(f"_mid_{name}")).otherwise(mid)
    edge = edge.withColumn("_mid", mid)

    part_max = F.greatest(F.col("_edge"), F.col("_mid"))
    aggs = [F.max(F.when(F.col("_q") == name, part_max)).alias(prefix + name) for name in frames]
    res = edge.groupBy(*[F.col(f"_rid.{c}").alias(c) for c in row_id]).agg(*aggs)
    return df.join(res, row_id, "left")


def drop_singletons(df: DataFrame, key: str) -> DataFrame:
    """Drop groups with exactly one row. The count is an aggregation
    (combined map-side) joined back, not a window over the whole group."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(key)
    return df.join(n, key, "left_semi")
