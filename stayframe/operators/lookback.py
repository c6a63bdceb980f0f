"""Lookback candidates as positional intervals, and latest events with all ties.

The events of a (key, feature) are one run in the order of (time, tie-break); an event's position in it is a number from 0.
The candidates of an anchor (``lower <= time <= anchor time``) are consecutive in the run, so an anchor holds them as an
interval of positions [first, last), whatever their number, together with their count and the sum of their values
(differences of running sums). ``expand`` makes rows of them where rows are wanted. The latest candidates, all that share the
greatest time, are the tail [tie_first, last) of the same interval, so ties are kept without a second search.

Positions come from one shuffle on (key, feature, time bucket), as in ``asof``: events and the anchors' two bounds are one
union; a window inside each bucket counts the events before every row; one row per bucket carries counts, sums and the
latest instant forward. A bucket with more than ``hot_rows`` rows is cut further. Expansion joins on (key, feature, block of
``BLOCK`` positions), so no long run is one task and no pair outside an interval's blocks is ever made.

Events without time, value or key are no candidates; an anchor without time or key has none. Without a lower bound (or
where it is null) an interval starts at the run's first event.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayframe.functions.time import epoch_us
from stayframe.operators.asof import DEFAULT_BUCKET_US, DEFAULT_HOT_ROWS, _materialize, split_hot_buckets

BLOCK = 4096


class Lookback:
    """Anchors with their intervals, and the runs that these refer to."""

    def __init__(self, anchors: DataFrame, events: DataFrame, *, key: list[str], anchor_id: list[str], anchor_time: str, event_time: str,
                 value_col: str, item_col: str, tiebreak: str, lower_bound: str | None = None, feature_col: str | None = None,
                 features: list[str] | None = None, bucket_us: int = DEFAULT_BUCKET_US, hot_rows: int | None = DEFAULT_HOT_ROWS):
        self.part = list(key) + (["feature"] if feature_col else [])
        self.anchor_id, self.tie = anchor_id, dict(events.dtypes)[tiebreak]
        t = epoch_us(event_time)
        ev = events.select(*key, *([F.col(feature_col).alias("feature")] if feature_col else []), t.alias("_t"), F.lit(1).alias("_k"),
                           F.col(tiebreak).alias("_tb"), F.struct(F.col(value_col).alias("value"), F.col(event_time).alias("time"), F.col(item_col).alias("item")).alias("_ev"))
        ev = ev.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key], F.col("_t").isNotNull() & F.col("_ev.value").isNotNull()))
        upper = epoch_us(anchor_time)
        lower = epoch_us(lower_bound) if lower_bound else F.lit(None).cast("long")
        an = anchors.select(*key, F.struct(*anchor_id, upper.alias("t"), lower.alias("lo")).alias("_a"))
        if feature_col:
            an = an.withColumn("feature", F.explode(F.array(*[F.lit(f) for f in features])))
        # a lower bound sorts before the events of its instant, an upper one behind them
        points = an.select("*", F.explode(F.array(F.struct(F.col("_a.t").alias("_t"), F.lit(2).alias("_k")), F.struct(F.col("_a.lo").alias("_t"), F.lit(0).alias("_k")))).alias("_p")) \
            .select("*", "_p.*").drop("_p").where("_k = 2 or _t is not null")
        u = ev.unionByName(points, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_us)).cast("long"))
        if hot_rows:
            u = split_hot_buckets(u, self.part, bucket_us, hot_rows)
        self.rows = self._counted(u.repartition(*self.part, "_b"))
        # what is not an event: the bounds, and one row per bucket
        few = _materialize(self.rows.where("_k <> 1 or _first").drop("_ev"))
        totals = few.where("_first")
        before = Window.partitionBy(*self.part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select(*self.part, "_b", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"), F.coalesce(F.sum("_bs").over(before), F.lit(0.0)).alias("_offs"), "_blast")
        latest = F.struct(F.col("_blast.t").alias("t"), (F.col("_off") + F.col("_blast.before")).alias("before"))
        self.carry = totals.withColumn("_carry", F.max(F.when(F.col("_blast").isNotNull(), latest)).over(before)).drop("_blast")
        self.intervals = self._intervals(few.where("_k <> 1"))

    def _counted(self, u: DataFrame) -> DataFrame:
        """Per row: events of its bucket before it (or with it), their sum and the latest of them; per bucket, the same of all."""
        w = Window.partitionBy(*self.part, "_b").orderBy("_t", "_k", "_tb")
        until, whole = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        event = (F.col("_k") == 1).cast("long")
        value = F.coalesce(F.col("_ev.value").cast("double"), F.lit(0.0))
        out = u.select("*", F.sum(event).over(until).alias("_n"), F.sum(value).over(until).alias("_s"), F.sum(event).over(whole).alias("_bn"),
                       F.sum(value).over(whole).alias("_bs"), (F.row_number().over(w) == 1).alias("_first"))
        earlier = Window.partitionBy(*self.part, "_b").orderBy("_t").rangeBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_before", F.coalesce(F.sum(event).over(earlier), F.lit(0)))
        own = F.when(F.col("_k") == 1, F.struct(F.col("_t").alias("t"), F.col("_before").alias("before")))
        return out.select("*", F.max(own).over(until).alias("_last"), F.max(own).over(whole).alias("_blast"))

    def _intervals(self, points: DataFrame) -> DataFrame:
        p = points.join(self.carry, [*self.part, "_b"], "left")
        off = F.coalesce("_off", F.lit(0))
        own = F.when(F.col("_last").isNotNull(), F.struct(F.col("_last.t").alias("t"), (off + F.col("_last.before")).alias("before")))
        p = p.select(*self.part, "_a", "_k", (off + F.col("_n")).alias("_pn"), (F.coalesce("_offs", F.lit(0.0)) + F.col("_s")).alias("_ps"), F.greatest(own, F.col("_carry")).alias("_pl"))
        at = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
        g = p.groupBy(*self.part, "_a").agg(F.coalesce(at(0, "_pn"), F.lit(0)).alias("first"), F.coalesce(at(0, "_ps"), F.lit(0.0)).alias("_fs"),
                                            at(2, "_pn").alias("last"), at(2, "_ps").alias("_ls"), at(2, "_pl").alias("_latest"))
        g = g.withColumn("last", F.greatest("first", F.when(F.col("_a.t").isNotNull(), F.col("last")).otherwise(0)))
        some = F.col("last") > F.col("first")
        return g.select(*[F.col(f"_a.{c}").alias(c) for c in self.anchor_id], *[c for c in self.part if c not in self.anchor_id], F.col("_a.t").alias("_at"), "first", "last",
                        (F.col("last") - F.col("first")).alias("n"), F.when(some, F.col("_ls") - F.col("_fs")).alias("total"),
                        F.when(some, F.greatest("first", "_latest.before")).otherwise(F.col("last")).alias("tie_first"),
                        F.when(some, (F.col("_at") - F.col("_latest.t")) / F.lit(1e6)).alias("delay"))

    def runs(self) -> DataFrame:
        """Every event with its position in its run."""
        r = self.rows.where("_k = 1").join(self.carry.select(*self.part, "_b", "_off"), [*self.part, "_b"])
        return r.select(*self.part, (F.col("_off") + F.col("_n") - 1).alias("pos"), F.col("_t").alias("_et"), "_ev.*")

    def expand(self, intervals: DataFrame | None = None, ties: bool = False) -> DataFrame:
        """One row per anchor and candidate (``ties``: per anchor and latest candidate): value, delay in seconds, time, item."""
        iv = (self.intervals if intervals is None else intervals).withColumn("_from", F.col("tie_first" if ties else "first")).where("last > _from")
        block = lambda c: F.floor(c / F.lit(BLOCK)).cast("long")
        iv = iv.withColumn("_block", F.explode(F.sequence(block(F.col("_from")), block(F.col("last") - 1))))
        run = self.runs().withColumn("_block", block(F.col("pos")))
        j = iv.select(*self.part, *[F.col(c).alias(f"_id_{c}") for c in self.anchor_id], "_at", "_from", "last", "_block").join(run, [*self.part, "_block"])
        j = j.where("pos >= _from and pos < last")
        return j.select(*[F.col(f"_id_{c}").alias(c) for c in self.anchor_id], *(["feature"] if "feature" in self.part else []),
                        "value", ((F.col("_at") - F.col("_et")) / F.lit(1e6)).alias("delay"), "time", "item")


def argmin_as_coded(look: Lookback, anchor_time: str) -> DataFrame:
    """J07 as written: among the anchors of one time (and feature) those with the smallest delay, with all their latest
    candidates (every tie is kept)."""
    group = [anchor_time] + (["feature"] if "feature" in look.part else [])
    some = look.intervals.where("n > 0")
    least = some.groupBy(*group).agg(F.min("delay").alias("_least"))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_g_{c}") for c in group])
    kept = some.join(least.select(*[F.col(c).alias(f"_g_{c}") for c in group], "_least"), on).where("delay = _least")
    return look.expand(kept.select(*some.columns), ties=True)
