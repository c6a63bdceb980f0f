"""Training data as packed blocks, and sums of arrays over all blocks.

Iterative learners read their input many times. It is packed once: rows are dealt by a hash of their
features, label and parts, put in a fixed order, and written as blocks of at most ``BLOCK`` rows (one binary
matrix each) to the shared checkpoint folder. So a pass is a scan of plain matrices, no shuffle, and a lost
executor repeats its own tasks. A pass adds up one array of fixed shape per task; sums of ``FAN`` tasks are added by
further tasks until those left are small (``COLLECTED`` bytes), always in the same order, so equal inputs give equal bits.

Every row has a part in every fold: 1 it trains, 2 it is scored, 0 neither. ``kfold_parts`` and
``shuffle_parts`` make them of the columns of ``split.kfold`` and ``split.shuffle_folds``; a fold in which
all rows train is a plain fit.
"""

from __future__ import annotations

import contextlib
import dataclasses
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayframe.session import ensure_package, stage_path

#: Rows of a block, task sums that are added in one further task, and bytes and number of those that the driver adds.
BLOCK, FAN, COLLECTED, MOST = 4096, 16, 64 << 20, 256
#: Columns that only some tables of blocks have, and their types.
OPTIONAL = {"times": np.int64, "weight": np.float64}


@dataclasses.dataclass
class Rows:
    """Rows of one block: features, label, parts (rows x folds) and the 64-bit hash that names each row (of ``distinct`` rows:
    how many rows it stands for). ``times``: how many equal rows each one stands for, where these were merged (else one);
    ``weight``: weights of rows, where a learner keeps some."""

    x: np.ndarray
    y: np.ndarray
    part: np.ndarray
    key: np.ndarray
    times: np.ndarray | None = None
    weight: np.ndarray | None = None

    @property
    def count(self) -> np.ndarray:
        return np.ones(len(self.y)) if self.times is None else self.times.astype(np.float64)


@dataclasses.dataclass
class Blocks:
    """Packed training data. ``counts[f, c]`` rows of class c train in fold f. Features are of type ``kind``."""

    table: DataFrame
    dim: int
    folds: int
    counts: np.ndarray
    kind: str = "<f8"

    def only(self, condition: Column) -> "Blocks":
        return dataclasses.replace(self, table=self.table.where(condition))

    @functools.cached_property
    def read(self) -> tuple[DataFrame, int]:
        """The columns of ``Rows``, and the tasks that read them."""
        rows = self.table.select("n", "dim", "x", "y", "part", "key", *[c for c in OPTIONAL if c in self.table.columns])
        return rows, rows.rdd.getNumPartitions()


def kfold_parts(df: DataFrame, fold_col: str = "fold") -> tuple[list, list[Column]]:
    """(fold names, a part for each): every fold is scored once, the others train."""
    names = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    return names, [F.when(F.col(fold_col) == f, 2).otherwise(1) for f in names]


def shuffle_parts(df: DataFrame, fold_col: str = "fold", role_col: str = "role") -> tuple[list, list[Column]]:
    """As ``kfold_parts``, for the long form: a row belongs to one fold and trains there or is scored."""
    names = sorted(r[0] for r in df.select(fold_col).distinct().collect())
    part = F.when(F.col(role_col) == "train", 1).when(F.col(role_col) == "test", 2).otherwise(0)
    return names, [F.when(F.col(fold_col) == f, part).otherwise(0) for f in names]


#: Packed tables by frame and arguments, while ``shared`` is open.
_shared: dict | None = None


@contextlib.contextmanager
def shared() -> Iterator[None]:
    """Plain fits inside pack the same frame the same way only once."""
    global _shared
    before, _shared = _shared, {}
    try:
        yield
    finally:
        _shared = before


def pack(df: DataFrame, parts: list[Column] | None = None, features: str | list[str] = "features", label: str = "label",
         classes=(0, 1, 2), batches: int = 1, seed: int = 0, merged: bool = False) -> Blocks:
    """Packs ``df``: ``features`` is a vector column, or a list of numeric columns (whose nulls become NaN).
    ``batches`` deals the rows to so many parts by hash (column ``batch``). Rows without a label are left out.
    ``merged``: rows equal in features, label and parts are counted by the tasks that read them, before the shuffle, and become
    one row with its number (``times``). Features of few values then give a small table, however many rows there are."""
    asked = (id(df), str(features), label, tuple(classes), batches, seed if batches > 1 else 0, merged)
    if _shared is not None and parts is None and asked in _shared:
        return _shared[asked][1]
    spark = df.sparkSession
    ensure_package(spark)
    plain, parts = parts is None, [F.lit(1)] if parts is None else parts
    if isinstance(features, str):
        x = vector_to_array(F.col(features))
    else:
        x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])
    rows = df.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.array(*[p.cast("int") for p in parts]).alias("part")).where("y is not null")
    if merged:
        rows = rows.groupBy("x", "y", "part").agg(F.count(F.lit(1)).alias("times"))
    rows = rows.withColumn("key", F.xxhash64("x", "y", "part", F.lit(seed))).withColumn("batch", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(batches)).cast("int"))
    columns = ["x", "y", "part", "key", "batch"]
    if merged:  # the counting's own shuffle has dealt them
        ordered = rows.sortWithinPartitions("batch", "key").select(*columns, "times")
    else:
        # copies of a row have one key: their places spread them over tasks
        rows = rows.withColumn("_place", F.monotonically_increasing_id() % 1024)
        tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = rows.repartition(tasks, "key", "_place").sortWithinPartitions("batch", "key").select(*columns)
    folds = len(parts)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            y, key, batch = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 3, 4))
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            part = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int8).reshape(len(y), folds)
            times = b.column(5).to_numpy(zero_copy_only=False) if merged else np.ones(len(y), np.int64)
            arrays = (x, y, part, key, times) if merged else (x, y, part, key)
            edges = np.unique(np.concatenate([np.arange(0, len(y), BLOCK), np.flatnonzero(np.diff(batch)) + 1, [len(y)]]))
            for i, j in zip(edges[:-1], edges[1:]):
                train = [[int(times[i:j][(part[i:j, f] == 1) & (y[i:j] == c)].sum()) for c in classes] for f in range(folds)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(batch[i])], pa.int32()), pa.array([j - i], pa.int32()), pa.array([x.shape[1]], pa.int32()),
                     *[pa.array([np.ascontiguousarray(a[i:j]).tobytes()], pa.binary()) for a in arrays],
                     pa.array([sum(train, [])], pa.list_(pa.int64()))], names=["batch", "n", "dim", "x", "y", "part", "key", *(["times"] if merged else []), "train"])

    path = stage_path(spark, f"blocks-{uuid.uuid4().hex}")
    packed = ordered.mapInArrow(run, "batch int, n int, dim int, x binary, y binary, part binary, key binary, " + ("times binary, " if merged else "") + "train array<bigint>")
    packed.write.partitionBy("batch").parquet(path) if batches > 1 else packed.drop("batch").write.parquet(path)
    table = spark.read.parquet(path)
    width, *sums = table.agg(F.max("dim"), *[F.sum(F.col("train")[k]) for k in range(folds * len(classes))]).first()
    out = Blocks(table, width or 0, folds, np.array([v or 0 for v in sums], np.int64).reshape(folds, len(classes)))
    if _shared is not None and plain:
        _shared[asked] = df, out  # with the frame, whose id stays its own so
    return out


def distinct(blocks: Blocks, code: Callable[[np.ndarray], np.ndarray]) -> Blocks:
    """The rows with ``code(x)`` (bytes, rows x features) for features. Those of equal codes, label and parts become one row whose
    ``key`` is their number: added up by tasks, then over all. There are never more rows than before, and however large the
    table is, never more than combinations of codes, labels and parts."""
    spark, dim, folds = blocks.table.sparkSession, blocks.dim, blocks.folds

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for rows in rows_of(b, folds):
                whole = np.concatenate([code(rows.x), rows.y.view(np.uint8).reshape(-1, 8), rows.part.view(np.uint8)], 1)
                found, at = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_inverse=True)
                times = np.bincount(at, rows.count).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.binary()), pa.array(times, pa.int64())], names=["code", "times"])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            for i in range(0, b.num_rows, BLOCK):
                own = b.slice(i, BLOCK)
                whole = np.frombuffer(b"".join(own.column(0).to_pylist()), np.uint8).reshape(own.num_rows, -1)
                cut = [whole[:, :dim], whole[:, dim:dim + 8], whole[:, dim + 8:], own.column(1).to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.num_rows], pa.int32()), pa.array([dim], pa.int32()), *[pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in cut]],
                    names=["n", "dim", "x", "y", "part", "key"])

    rows, _ = blocks.read
    added = rows.mapInArrow(count, "code binary, times bigint").groupBy("code").agg(F.sum("times").alias("times")).sortWithinPartitions("code")
    path = stage_path(spark, f"distinct-{uuid.uuid4().hex}")
    added.mapInArrow(run, "n int, dim int, x binary, y binary, part binary, key binary").write.parquet(path)
    return dataclasses.replace(blocks, table=spark.read.schema("n int, dim int, x binary, y binary, part binary, key binary").parquet(path), kind="u1")


def rows_of(batch: pa.RecordBatch, folds: int, kind: str = "<f8") -> Iterator[Rows]:
    more = {c: t for c, t in OPTIONAL.items() if c in batch.schema.names}
    for n, dim, x, y, part, key, *rest in zip(*(batch.column(k) for k in range(6)), *(batch.column(c) for c in more)):
        n, dim = n.as_py(), dim.as_py()
        yield Rows(np.frombuffer(x.as_buffer(), kind).reshape(n, dim), np.frombuffer(y.as_buffer(), np.float64),
                   np.frombuffer(part.as_buffer(), np.int8).reshape(n, folds), np.frombuffer(key.as_buffer(), np.int64),
                   **{c: np.frombuffer(v.as_buffer(), t) for (c, t), v in zip(more.items(), rest)})


def summed(blocks: Blocks, each: Callable[[Rows], np.ndarray], size: int, merge: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> np.ndarray:
    """The sum over all blocks of ``each(rows)``, flat arrays of ``size`` doubles (or what ``merge`` makes of two of them, from zeros on)."""
    folds, kind = blocks.folds, blocks.kind

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros(size), False
        for b in source:
            for rows in rows_of(b, folds, kind):
                total = merge(total, each(rows))
                some = True
        if some:
            yield _sum_row(TaskContext.get().partitionId(), total)

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        total = np.zeros(size)
        for s in group.column("sum"):
            total = merge(total, np.frombuffer(s.as_buffer(), np.float64))
        return pa.Table.from_batches([_sum_row(group.column("place")[0].as_py() // FAN, total)])

    schema = "place bigint, sum binary"
    rows, tasks = blocks.read
    out = rows.mapInArrow(run, schema)
    while tasks > 1 and (tasks > MOST or 8 * size * tasks > COLLECTED):
        out = out.groupBy((F.col("place") / FAN).cast("bigint").alias("_group")).applyInArrow(add, schema)
        tasks = -(-tasks // FAN)
    total = np.zeros(size)
    for r in sorted(out.collect()):
        total = merge(total, np.frombuffer(r["sum"], np.float64))
    return total


def _sum_row(place: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["place", "sum"])


def class_weights(counts: np.ndarray) -> np.ndarray:
    """Weights by fold and class that let every class of a fold weigh the same (mean 1): n / (classes * count)."""
    some = counts > 0
    return np.where(some, counts.sum(1, keepdims=True) / np.maximum(some.sum(1, keepdims=True) * counts, 1), 0.0)
