"""Mixing sources to target weights, by blocks.

The words of a source, document after document, are packed into blocks of ``BLOCK_WORDS``
(the last one shorter). Sources in code point order, null last, get the weights in turn;
together they get ``share`` of all words, each at most ``most`` times its own, the excess
shared out again by weight. A source's target in blocks is its number of slots. Every
output shard draws its counts of slots per source from a multinomial distribution with
these proportions (seeded by the shard); draws beyond a source's slots go to the sources
that were drawn too rarely, so the totals are met exactly. Slot ``j`` of a source with
``n`` blocks takes, in epoch ``j // n``, the block that a keyed permutation of 0..n-1
gives for ``j % n``; so no block is taken more often than ``most`` times. Slots and the
documents' pieces of blocks are joined by (source, block).

Running sums are taken in groups of bounded size, then over the groups' totals, so a source
with a third of all rows is no single task's work. The recipe, one row per source, is held by
driver and tasks; more than ``MAX_SOURCES`` raise an error. Null and empty texts have size 0
and are never taken. Repeated rows count for themselves. Empty input: no rows. Same input,
same result: all draws depend on seeds and contents alone. Extra columns are not read by
``mix``; ``mixed_documents`` passes them through (names that begin with ``_mix_`` are reserved).
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import released, staged
from ._text import mix64

BLOCK_WORDS, SLOTS_A_SHARD, SLOTS_A_TASK, GROUP_ROWS, MAX_SOURCES = 128, 4096, 250_000, 10_000, 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclasses.dataclass
class Source:
    number: int
    name: str | None
    size: int
    weight: float
    target: float = 0.0
    blocks: int = 0
    slots: int = 0


def recipe(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, most: float, block_words: int) -> list[Source]:
    """Targets and slots of the sources, given (name, size)."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    out = [Source(k, name, size, weights[k % len(weights)]) for k, (name, size) in enumerate(ordered)]
    left, free = share * sum(s.size for s in out), [s for s in out if s.size]
    while free:
        unit = left / sum(s.weight for s in free)
        full = [s for s in free if unit * s.weight > most * s.size]
        for s in full or free:
            s.target = float(most * s.size) if full else unit * s.weight
            left -= s.target
        if not full:
            break
        names = {s.number for s in full}
        free = [s for s in free if s.number not in names]
    for s in out:
        s.blocks = -(-s.size // block_words)
        s.slots = min(int(most * s.blocks), round(s.target * s.blocks / s.size)) if s.size else 0
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 at ``index``: a Feistel network on the next power of
    four, walked until the value lies below n."""
    if n < 2:
        return index.copy()
    half = np.uint64(max(1, -(-int(n - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(6):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
            left, right = right, left ^ (mix64(right + salt) & mask)
        return left << half | right

    out = once(index.astype(np.uint64))
    while (far := np.flatnonzero(out >= n)).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


def running_sum(df: DataFrame, key: str, group: Column, order: list, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the same key that come before, in the order
    of (group, order): within each group, plus the totals of the groups before it."""
    df = df.withColumn("_grp", group)
    inside = Window.partitionBy(key, "_grp").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_k").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = df.groupBy(F.col(key).alias("_k"), F.col("_grp").alias("_g")).agg(F.sum(value).alias("_s")) \
        .select("_k", "_g", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    df = df.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(groups, (F.col(key) == F.col("_k")) & (F.col("_grp") == F.col("_g"))) \
        .withColumn(out, F.col(out) + F.col("_base")).drop("_k", "_g", "_grp", "_base")


@dataclasses.dataclass
class Mix:
    """documents: (_mix_row, id, size, source_size, target, taken); pieces: (shard, slot, number, epoch,
    block, _mix_row, first_word, n_words), what every slot takes from which document; sources: the recipe."""

    documents: DataFrame
    pieces: DataFrame
    sources: list[Source]


def _slots(spark: SparkSession, sources: list[Source], seed: int) -> DataFrame:
    """(shard, slot, number, epoch, block): what stands in every slot of the mix."""
    total = sum(s.slots for s in sources)
    shards = -(-total // SLOTS_A_SHARD)
    wanted = np.array([s.slots for s in sources], np.int64)
    share = wanted / max(total, 1)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                size = min(SLOTS_A_SHARD, total - shard * SLOTS_A_SHARD)
                n = np.random.default_rng([seed, shard]).multinomial(size, share)
                used = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), shard)), pa.array(used), pa.array(n[used])], names=["shard", "number", "n"])

    counts = spark.range(shards).mapInArrow(released(draw), "shard bigint, number bigint, n bigint")
    counts = staged(running_sum(counts, "number", F.expr(f"shard div {GROUP_ROWS}"), ["shard"], "n", "base"), "mix-counts")
    drawn = np.zeros(len(sources), np.int64)
    for k, n in counts.groupBy("number").agg(F.sum("n")).collect():  # one row per source
        drawn[k] = n
    surplus, lack = np.maximum(drawn - wanted, 0), np.maximum(wanted - drawn, 0)
    surplus_at = np.concatenate([[0], np.cumsum(surplus)])
    lack_at = np.concatenate([[0], np.cumsum(lack)])
    blocks = np.array([s.blocks for s in sources], np.int64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s, n = row["number"], row["n"]
                j = row["base"] + np.arange(n)
                number = np.full(n, s)
                over = np.flatnonzero(j >= wanted[s])
                if len(over):  # the k-th draw too many stands for the k-th one lacking
                    k = surplus_at[s] + j[over] - wanted[s]
                    number[over] = np.searchsorted(lack_at, k, "right") - 1
                    j[over] = drawn[number[over]] + k - lack_at[number[over]]
                epoch, block = j // np.maximum(blocks[number], 1), np.zeros(n, np.int64)
                for t, e in np.unique(np.stack([number, epoch], 1), axis=0).tolist():
                    own = (number == t) & (epoch == e)
                    block[own] = permuted(j[own] % blocks[t], int(blocks[t]), seed << 40 ^ t << 20 ^ e)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, row["shard"])), pa.array(j), pa.array(number), pa.array(epoch), pa.array(block)],
                                                 names=["shard", "slot", "number", "epoch", "block"])

    dealt = counts.select("shard", "number", "n", "base").repartition(max(1, -(-total // SLOTS_A_TASK)), "shard", "number")
    return dealt.mapInArrow(released(fill), "shard bigint, slot bigint, number bigint, epoch bigint, block bigint")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 1,
        block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row: Column | None = None) -> Mix:
    """The mix of ``docs``; ``row`` may name a column that tells its rows apart."""
    spark = docs.sparkSession
    sized = docs.select((F.monotonically_increasing_id() if row is None else row).alias("_mix_row"), F.col(id_col).alias("_mix_id"), F.col(source_col).alias("_mix_source"),
                        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"))
    sized = staged(sized, "mix-sizes")
    sizes = sized.groupBy("_mix_source").agg(F.sum("size"), F.count("*")).take(MAX_SOURCES + 1)
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"a mix takes at most {MAX_SOURCES} sources")
    sources = recipe([(s, n or 0) for s, n, _ in sizes], weights, share, most, block_words)
    rows = {s: n for s, _, n in sizes}
    known = spark.createDataFrame([(s.name, s.number, s.size, s.target, -(-rows[s.name] // GROUP_ROWS)) for s in sources],
                                  "_name string, number bigint, source_size bigint, target double, _groups bigint")
    sized = sized.join(known, F.col("_mix_source").eqNullSafe(F.col("_name"))).drop("_name", "_mix_source")
    placed = running_sum(sized.filter("size > 0").select("_mix_row", "_mix_id", "size", "number", "_groups"), "number",
                         F.pmod(F.xxhash64("_mix_id", "size"), "_groups"), ["_mix_id", "size"], "size", "at")
    b = block_words
    pieces = placed.select("number", "_mix_row", "size", "at", F.explode(F.sequence(F.expr(f"at div {b}"), F.expr(f"(at + size - 1) div {b}"))).alias("block")) \
        .select("number", "block", "_mix_row", F.greatest(F.lit(0), F.col("block") * b - F.col("at")).alias("first_word"),
                (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("at"), F.col("block") * b)).alias("n_words"))
    # both sides grow with the input (a plan sees only the small table that the slots come from): no broadcast
    taken = _slots(spark, sources, seed).hint("merge").join(pieces, ["number", "block"])
    words = taken.groupBy(F.col("_mix_row").alias("_r")).agg(F.sum("n_words").alias("_t"))
    documents = sized.join(words, F.col("_mix_row") == F.col("_r"), "left").select(
        "_mix_row", F.col("_mix_id").alias(id_col), "size", "source_size", "target", F.coalesce("_t", F.lit(0)).alias("taken"))
    return Mix(documents, taken, sources)


def _cut(text: str, runs: list[dict], size: int, words: np.ndarray) -> str:
    """The text of some runs of words; all of them give the text as it is."""
    spans: list[list[int]] = []
    for r in sorted(runs, key=lambda x: x["first_word"]):
        if spans and spans[-1][1] == r["first_word"]:
            spans[-1][1] += r["n_words"]
        else:
            spans.append([r["first_word"], r["first_word"] + r["n_words"]])
    if spans == [[0, size]]:
        return text
    return "\n".join(text[words[a][0]:words[z - 1][1]] for a, z in spans)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: one row per document and epoch in which words of it were taken, with
    the columns of ``docs``; the text holds the words taken (all of them: as it was), ``chars_col`` (where there is
    one) its length. Null and empty texts are in no row. A very long text is cut in the task that holds it, whole."""
    import re

    held = staged(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "mix-documents")
    plan = mix(held, id_col=id_col, text_col=text_col, source_col=source_col, row=F.col("_mix_row"), **options)
    runs = plan.pieces.groupBy(F.col("_mix_row").alias("_r"), F.col("epoch").alias("_mix_epoch")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("_mix_runs"))
    joined = held.join(runs, F.col("_mix_row") == F.col("_r")).drop("_r")
    at, own = docs.columns.index(text_col), len(docs.columns)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None
    pattern = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, taken in zip(b.column(at).to_pylist(), b.column(own).to_pylist()):
                words = [m.span() for m in pattern.finditer(text)]
                texts.append(_cut(text, taken, len(words), words))
            columns = [b.column(k) for k in range(own)]
            columns[at] = pa.array(texts, b.column(at).type)
            if chars is not None:
                columns[chars] = pa.array([len(t) for t in texts], pa.int64()).cast(b.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:own])

    return joined.select(*docs.columns, "_mix_runs").mapInArrow(released(run), docs.schema)
