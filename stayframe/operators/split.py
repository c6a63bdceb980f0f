"""Exact, repeatable splits and folds.

Rows are ranked inside each stratum by ``md5(key | seed)``. The rank is exact
but no stratum is ranked by one task: rows are grouped by (stratum, first 4
hex digits of the hash) — 65,536 sub-groups per stratum — ranked there, and
offset by the counts of the earlier sub-groups (a window over one count row
per sub-group). ``split_at_cuts`` needs the ranks next to the cuts only and
moves no rows.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_hash(key_cols: list[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed))))


def strata_rank(df: DataFrame, strata: list[str], key_cols: list[str], seed: int) -> DataFrame:
    """Adds ``_rank`` (1-based, by hash then key inside the stratum) and ``_n``
    (stratum size)."""
    # the sub-group is one column that is never null, so the offsets' join uses the window's own shuffle
    group = F.to_json(F.struct(F.substring("_h", 1, 4).alias("_hb"), *[F.col(c).cast("string") for c in strata]), {"ignoreNullFields": "false"})
    d = df.withColumn("_h", row_hash(key_cols, seed)).withColumn("_g", group)
    rn = F.row_number().over(Window.partitionBy("_g").orderBy("_h", *key_cols))
    counts = d.groupBy("_g", *strata, F.substring("_h", 1, 4).alias("_hb")).agg(F.count(F.lit(1)).alias("_c"))
    ws = Window.partitionBy(*strata)
    offs = counts.select(F.col("_g").alias("_og"),
                         F.coalesce(F.sum("_c").over(ws.orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)),
                                    F.lit(0)).alias("_off"),
                         F.sum("_c").over(ws).alias("_n"))
    return (d.withColumn("_rn", rn).join(offs, F.col("_g") == F.col("_og")).withColumn("_rank", F.col("_off") + F.col("_rn"))
            .drop("_h", "_g", "_rn", "_off", "_og"))


def _strata(label):
    return [label] if label else []


def stratified_split(df: DataFrame, label: str, key_cols: list[str], seed: int = 44,
                     first: float = 0.8, second: float = 0.5,
                     names: tuple[str, str, str] = ("hyperopt", "compare", "test")) -> DataFrame:
    """Per class, the first ``round(first*n)`` ranks go to ``names[0]``;
    of the rest, ``round(second*rest)`` to ``names[1]`` and the others to
    ``names[2]`` (80/10/10 by default). Adds ``split``."""
    return strata_rank(df, _strata(label), key_cols, seed).withColumn("split", _split_name(first, second, names)).drop("_rank", "_n")


#: Strata whose cuts ``split_at_cuts`` writes into one expression.
MOST_STRATA = 100


def split_at_cuts(df: DataFrame, label: str | None, key_cols: list[str], seed: int = 44, first: float = 0.8, second: float = 0.5,
                  names: tuple[str, str, str] = ("hyperopt", "compare", "test")) -> DataFrame:
    """``stratified_split`` of a table that is cheap to read again (it is counted at once, in two scans): no row is shuffled.
    Counts by sub-group tell in which one each cut lies, those by hash in there after which hash; every row then compares its own
    hash with these. Only rows whose hash is that of a cut inside equal hashes (rows of one key) are ranked."""
    strata = _strata(label)
    d = df.withColumn("_h", row_hash(key_cols, seed))
    own = Window.partitionBy(*strata)
    counts = d.groupBy(*strata, F.substring("_h", 1, 4).alias("_hb")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_n", F.sum("_c").over(own)).withColumn("_upto", F.sum("_c").over(own.orderBy("_hb")))
    n1, n2 = _sizes(first, second)
    cuts = counts.withColumn("_cut", F.explode(F.array(F.struct(F.lit(0).alias("k"), n1.alias("at")), F.struct(F.lit(1).alias("k"), (n1 + n2).alias("at")))))
    inside = cuts.where((F.col("_cut.at") > F.col("_upto") - F.col("_c")) & (F.col("_cut.at") <= F.col("_upto")))
    found = inside.select(*strata, "_hb", (F.col("_upto") - F.col("_c")).alias("before"), "_cut.k", "_cut.at").limit(2 * MOST_STRATA + 1).collect()
    if len(found) > 2 * MOST_STRATA:
        return stratified_split(df, label, key_cols, seed, first, second, names)
    same = [F.col(label).eqNullSafe(F.lit(r[label])) if label else F.lit(True) for r in found]
    near = [s & (F.substring("_h", 1, 4) == r["_hb"]) for s, r in zip(same, found)]
    ahead = Window.partitionBy(*strata, F.substring("_h", 1, 4)).orderBy("_h")
    hashes = d.where(_any(near)).groupBy(*strata, "_h").agg(F.count(F.lit(1)).alias("_c")).withColumn("_upto", F.sum("_c").over(ahead))
    hits = [n & (F.col("_upto") - F.col("_c") < r["at"] - r["before"]) & (F.col("_upto") >= r["at"] - r["before"]) for n, r in zip(near, found)]
    last = {i: r for r in hashes.where(_any(hits)).select("_h", "_c", "_upto", F.array(F.lit(False), *hits).alias("hits")).collect() for i, h in enumerate(r["hits"][1:]) if h}
    parts = [_any([s & (F.col("_h") <= last[i]["_h"]) for i, (s, r) in enumerate(zip(same, found)) if r["k"] == k]) for k in (0, 1)]
    split = F.when(parts[0], names[0]).when(parts[1], names[1]).otherwise(names[2])
    apart = [i for i, r in enumerate(found) if last[i]["_upto"] > r["at"] - r["before"]]  # cuts inside equal hashes
    if not apart:
        return d.withColumn("split", split).drop("_h")
    tied = [same[i] & (F.col("_h") == last[i]["_h"]) for i in apart]
    rank = F.row_number().over(Window.partitionBy(*strata, "_h").orderBy(*key_cols))
    ranked = d.where(_any(tied)).withColumn("_rank", rank)
    for k, i in enumerate(apart):
        before = found[i]["before"] + last[i]["_upto"] - last[i]["_c"]
        ranked = ranked.withColumn(f"_in{found[i]['k']}_{k}", F.when(tied[k], F.col("_rank") + before <= found[i]["at"]))
    inside = [F.coalesce(*[F.col(f"_in{c}_{k}") for k, i in enumerate(apart) if found[i]["k"] == c], parts[c]) for c in (0, 1)]
    ranked = ranked.withColumn("split", F.when(inside[0], names[0]).when(inside[1], names[1]).otherwise(names[2]))
    return d.where(~_any(tied)).withColumn("split", split).drop("_h").unionByName(ranked.select(*df.columns, "split"))


def _any(conditions: list[Column]) -> Column:
    """True where a condition is (none is null here)."""
    return functools.reduce(operator.or_, conditions, F.lit(False))


def _sizes(first: float, second: float) -> tuple[Column, Column]:
    """Rows of the first two parts, of ``_n``."""
    n1 = F.round(F.col("_n") * F.lit(first))
    return n1, F.round((F.col("_n") - n1) * F.lit(second))


def _split_name(first: float, second: float, names: tuple[str, str, str]) -> Column:
    n1, n2 = _sizes(first, second)
    return (F.when(F.col("_rank") <= n1, names[0]).when(F.col("_rank") <= n1 + n2, names[1])
            .otherwise(names[2]))


def split_and_folds(df: DataFrame, label: str, key_cols: list[str], seed: int = 44, k: int = 3, first: float = 0.8, second: float = 0.5,
                    names: tuple[str, str, str] = ("hyperopt", "compare", "test")) -> DataFrame:
    """``stratified_split`` and ``kfold`` of one seed: both follow the same ranks, which are computed once."""
    r = strata_rank(df, _strata(label), key_cols, seed).withColumn("split", _split_name(first, second, names))
    return r.withColumn("fold", _fold(k)).drop("_rank", "_n")


def random_split(df: DataFrame, key_cols: list[str], seed: int = 42, test_size: float = 0.2,
                 drop_last: bool = False) -> DataFrame:
    """``ceil(test_size*n)`` rows held out; the first half (floor) of
    them is ``validation``, the rest ``test``; ``drop_last`` drops the last
    test row, as the original slicing ``[k:-1]`` does (Q14)."""
    r = strata_rank(df.withColumn("_all", F.lit(0)), ["_all"], key_cols, seed)
    n_test = F.ceil(F.col("_n") * F.lit(test_size))
    n_train = F.col("_n") - n_test
    n_val = F.floor(n_test / 2)
    split = (F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "validation")
             .otherwise("test"))
    out = r.withColumn("split", split)
    if drop_last:
        out = out.where(F.col("_rank") < F.col("_n"))
    return out.drop("_rank", "_n", "_all")


def shuffle_folds(df: DataFrame, label: str, key_cols: list[str], seed: int = 42, n_splits: int = 3,
                  test_size: float = 0.1) -> DataFrame:
    """``n_splits`` stratified shuffles (seed, seed+1, ...): per class the
    last ``ceil(test_size*n)`` ranks are ``test``. Long form: one row per
    (fold, row) with ``role``."""
    parts = []
    for i in range(n_splits):
        r = strata_rank(df, _strata(label), key_cols, seed + i)
        role = F.when(F.col("_rank") > F.col("_n") - F.ceil(F.col("_n") * F.lit(test_size)), "test").otherwise("train")
        parts.append(r.select(F.lit(i).alias("fold"), *df.columns, role.alias("role")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kfold(df: DataFrame, label: str, key_cols: list[str], seed: int = 44, k: int = 3, col: str = "fold") -> DataFrame:
    """Stratified k-fold assignment ``(rank - 1) mod k`` inside each class;
    feeds ``CrossValidator(foldCol=...)``."""
    r = strata_rank(df, _strata(label), key_cols, seed)
    return r.withColumn(col, _fold(k)).drop("_rank", "_n")


def _fold(k: int) -> Column:
    return ((F.col("_rank") - 1) % k).cast("int")


def split_balance(df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
    """Rows per (split, class)."""
    return df.groupBy(split, label).agg(F.count(F.lit(1)).alias("count"))
