"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z lower-cased;
shingles are ``size`` consecutive words (all words of a shorter text). A shingle's weight is
``(1 + ln tf) * idf`` with ``idf = min(1, ln(N / df) / ln(1 / RARE))``: shingles in at most a
share ``RARE`` of the documents weigh fully, commoner ones less. Document frequencies are
counted over all documents in ``DF_BUCKETS`` hashed buckets, a table of fixed size. Each text
gives ``BANDS`` keys of ``ROWS`` samples each; texts that share a key are candidates, and
links are verified by the exact weighted Jaccard similarity of the texts.

Texts with the same words are one class before anything else. In a bucket of texts that share
a key, all are compared to its center, the text with the largest buckets. Where texts of a bucket then
stand in different groups, all pairs of different groups are compared: one by one where the bucket has at
most ``SMALL`` texts, else in blocks, the texts outside the largest group with each other and with that group.
No rows of pairs are made of a large bucket, no task holds more than two blocks, and no candidate pair that
could join two groups is left out. Groups are the connected
components of the links.

Texts without words (null, empty, only punctuation) are groups of their own. Rows of the same id are
one document with any of their texts. Empty input: no rows. Extra columns are not read by ``near_duplicates``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import released, staged
from ._text import Rolling, byte_words, mix64, slices, utf8
from .components import components

BANDS, ROWS, DF_BUCKETS, RARE, LEAST_IDF, SMALL, BLOCK, COLUMNS, SALTS = 6, 2, 1 << 16, 0.05, 0.05, 16, 256, 8192, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of the rows, ascending within each row: row, hash, term frequency; and the
    words' hashes with the rows' offsets in them. At most 2**20 rows."""
    _, _, words, at = byte_words(data, offsets)
    n = np.diff(at)
    many = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    row = np.repeat(np.arange(len(n)), many)
    first = at[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    length = np.minimum(n, size)[row]
    h = mix64(Rolling(words)(first, first + length) + length.astype(np.uint64))
    # a shingle's name is 44 bits; the row stands above it, so one plain sort groups and orders them
    key = np.sort(row.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    edge = np.flatnonzero(new)
    key = key[edge]
    return (key >> np.uint64(44)).astype(np.int64), key << np.uint64(20), np.diff(np.append(edge, len(h))), (words, at)


def weights(h: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * idf[h >> np.uint64(64 - DF_BUCKETS.bit_length() + 1)]


def document_frequencies(docs: DataFrame, size: int, text_col: str) -> np.ndarray:
    """idf of every bucket: one pass, partial counts per task, at most ``DF_BUCKETS`` rows to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros(DF_BUCKETS, np.int64), 0
        for b in batches:
            data, offsets = utf8(b.column(0))
            n += b.num_rows
            for i, j in slices(offsets):
                _, h, _, _ = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], size)
                counts += np.bincount((h >> np.uint64(64 - DF_BUCKETS.bit_length() + 1)).astype(np.int64), minlength=DF_BUCKETS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(counts[used], n))], names=["k", "n"])

    df, n = np.ones(DF_BUCKETS), 1
    for k, count in docs.select(text_col).mapInArrow(released(run), "k bigint, n bigint").groupBy("k").agg(F.sum("n")).collect():
        if k < 0:
            n = max(count, 1)
        else:
            df[k] = count
    return np.clip(np.log(n / df) / math.log(1 / RARE), LEAST_IDF, 1.0)


def samples(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, many: int) -> np.ndarray:
    """[many, rows] consistent weighted samples, 32 bits each (0 for rows without shingles)."""
    out = np.zeros((many, rows), np.uint64)
    if not len(h):
        return out
    edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    log_w, unit = np.log(weight).astype(np.float32), np.float32(2.0 ** -24)
    low = (mix64(h) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    for k in range(many):
        x = mix64(h + np.uint64((2 * k + 1) * int(_ODD) & 0xFFFFFFFFFFFFFFFF))
        y = mix64(x ^ _ODD)
        u = lambda bits, shift: ((bits >> np.uint64(shift)) & np.uint64(0xFFFFFF)).astype(np.float32) * unit + unit / 2
        r = -np.log(u(x, 40) * u(x, 16) + np.float32(1e-30))
        log_c = np.log(-np.log(u(y, 40) * u(y, 16) + np.float32(1e-30)))
        beta = ((x ^ y) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0 ** -16)
        t = np.floor(log_w / r + beta)
        log_a = log_c - r * (t - beta + 1)
        bits = log_a.view(np.int32)
        order = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)
        name = low ^ (t.astype(np.int64).astype(np.uint32) * np.uint32(0x9E3779B1))
        best = np.minimum.reduceat(order.astype(np.uint64) << np.uint64(32) | name, edge)
        out[k, row[edge]] = best & np.uint64(0xFFFFFFFF)
    return out


def signatures(docs: DataFrame, idf: np.ndarray, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, k1, k2, bands): the hashes of the words in their order and the band keys."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            n_words, keys, bands = np.zeros(b.num_rows, np.int64), np.zeros((2, b.num_rows), np.int64), np.zeros((b.num_rows, BANDS), np.int64)
            for i, j in slices(offsets):
                part, off = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                row, h, tf, (words, at) = shingles(part, off, size)
                n = n_words[i:j] = np.diff(at)
                place = (np.arange(len(words)) - np.repeat(at[:-1], n)).astype(np.uint64)
                some = np.flatnonzero(n)
                for s in range(2):  # two 64-bit sums over (word, place)
                    if len(some):
                        keys[s, i + some] = np.add.reduceat(mix64(words + (place * np.uint64(2) + np.uint64(s)) * _ODD), at[:-1][some]).view(np.int64)
                got = samples(row, h, weights(h, tf, shared.value), j - i, BANDS * ROWS)
                for k in range(BANDS):
                    key = np.full(j - i, k + 1, np.uint64)
                    for s in got[k * ROWS:(k + 1) * ROWS]:
                        key = mix64(key * _ODD + s)
                    bands[i:j, k] = key.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words), pa.array(keys[0]), pa.array(keys[1]),
                                              pa.ListArray.from_arrays(pa.array(np.arange(0, b.num_rows * BANDS + 1, BANDS), pa.int32()), pa.array(bands.ravel()))],
                                             names=["id", "n_words", "k1", "k2", "bands"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("_text")).mapInArrow(released(run), "id bigint, n_words bigint, k1 bigint, k2 bigint, bands array<bigint>")


def similarities(a: pa.Array, b: pa.Array, idf: np.ndarray, size: int) -> np.ndarray:
    """The exact weighted Jaccard similarity of the texts in each row (0 where neither has words)."""
    sides = [utf8(a), utf8(b)]
    out = np.zeros(len(a))
    for i, j in slices(sides[0][1] + sides[1][1]):
        named, weight, total = [], [], np.zeros(j - i)
        for data, offsets in sides:
            row, h, tf, _ = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], size)
            named.append(row.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
            weight.append(weights(h, tf, idf))
            total += np.bincount(row, weight[-1], j - i)
        at = np.searchsorted(named[1], named[0])
        at[at == len(named[1])] = 0
        both = np.flatnonzero(named[1][at] == named[0]) if len(named[1]) else np.zeros(0, np.int64)
        common = np.bincount((named[0][both] >> np.uint64(44)).astype(np.int64), np.minimum(weight[0][both], weight[1][at[both]]), j - i)
        rest = total - common
        out[i:j] = np.divide(common, rest, out=np.zeros(j - i), where=rest > 0)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, size: int) -> DataFrame:
    """(a, b, sim) of the pairs, by their texts."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(similarities(b.column(2), b.column(3), shared.value, size))], names=["a", "b", "sim"])

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return staged(both.mapInArrow(released(run), "a bigint, b bigint, sim double"), "minhash-tested")


def _linked_in(row: np.ndarray, h: np.ndarray, w: np.ndarray, apart: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u, v) of texts with ``apart[u, v]`` whose weighted Jaccard similarity is at least ``least``, from their
    (row, shingle, weight). The sum of products of square roots bounds what two texts have in common from
    above; pairs that pass it are computed exactly. Shingles are taken in groups of bounded size."""
    n = len(apart)
    total = np.bincount(row, w, n)
    name, column, count = np.unique(h, return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)  # no other text has the rest
    place = np.full(len(name), -1)
    place[common] = np.arange(len(common))
    held = place[column] >= 0
    row, column, w = row[held], place[column[held]], w[held]
    order = np.argsort(column, kind="stable")
    row, column, w = row[order], column[order], w[order]
    edges = np.searchsorted(column, np.arange(0, len(common) + COLUMNS, COLUMNS))

    def parts(values: np.ndarray) -> Iterator[np.ndarray]:
        for k, (a, z) in enumerate(zip(edges[:-1], edges[1:])):
            dense = np.zeros((n, COLUMNS), np.float32)
            dense[row[a:z], column[a:z] - k * COLUMNS] = values[a:z]
            yield dense

    bound = np.zeros((n, n), np.float32)
    for dense in parts(np.sqrt(w)):
        bound += dense @ dense.T
    u, v = np.nonzero(apart & (bound * (1 + least) >= least * (total[:, None] + total[None]) * (1 - 1e-4)))
    same = np.zeros(len(u))
    for dense in parts(w):
        for c in range(0, len(u), 512):
            same[c:c + 512] += np.minimum(dense[u[c:c + 512]], dense[v[c:c + 512]]).sum(1, dtype=np.float64)
    fits = same * (1 + least) >= least * (total[u] + total[v]) * (1 - 1e-6)
    return u[fits], v[fits]


def _compared(open_: DataFrame, texts: DataFrame, idf: np.ndarray, size: int, least: float) -> DataFrame:
    """(a, b): links that unite the texts of large keys. ``open_``: key, rep, grp. The texts outside a key's largest
    group are compared to each other and to the largest group, block by block, each pair of blocks by a task."""
    spark = open_.sparkSession
    shared = spark.sparkContext.broadcast(idf)
    sizes = open_.groupBy("key", "grp").agg(F.count("*").alias("c"))
    most = sizes.groupBy("key").agg(F.max(F.struct("c", "grp")).alias("m"), F.sum("c").alias("all")).select(
        "key", F.col("m.grp").alias("main"), F.ceil(F.col("m.c") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("m.c")) / BLOCK).cast("int").alias("others"))
    # a key may hold many texts: it is dealt with a salt of the text, and its one row of sizes is given to each
    salted = most.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    placed = open_.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")
    placed = placed.withColumn("in_main", F.col("grp") == F.col("main"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))
    task = lambda i, main, j, side: F.struct(i.alias("i"), F.lit(main).alias("main"), j.alias("j"), side.cast("int").alias("side"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    of_main = F.transform(every("others"), lambda x: task(x, True, F.col("block"), F.lit(1)))
    of_other = F.concat(F.transform(every("others"), lambda x: task(F.least(x, F.col("block")), False, F.greatest(x, F.col("block")), x < F.col("block"))),
                        F.transform(every("mains"), lambda x: task(F.col("block"), True, x, F.lit(0))))
    tasks = placed.select("key", "rep", "grp", F.explode(F.when(F.col("in_main"), of_main).otherwise(of_other)).alias("t"))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        data, offsets = utf8(pa.array(df["_text"].tolist(), pa.string()))
        found = [(i, shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], size)) for i, j in slices(offsets)]
        row, h, tf = (np.concatenate([x[k] + i if k == 0 else x[k] for i, x in found]) for k in range(3))
        side, grp, reps = df["side"].to_numpy(), df["grp"].to_numpy(), df["rep"].to_numpy()
        apart = grp[:, None] != grp[None]
        if (side == 1).any():
            apart &= (side[:, None] == 0) & (side[None] == 1)
        else:
            apart &= np.triu(np.ones_like(apart), 1)
        u, v = _linked_in(row, h, weights(h, tf, shared.value), apart, least)
        root = reps.copy()
        while len(u):  # the smallest text linked with each here
            low = np.minimum(root[u], root[v])
            if (low == root[u]).all() and (low == root[v]).all():
                break
            np.minimum.at(root, u, low)
            np.minimum.at(root, v, low)
        tied = root != reps
        return pd.DataFrame({"a": root[tied], "b": reps[tied]})

    return tasks.select("key", "t.i", "t.main", "t.j", "t.side", "rep", "grp").join(texts.select(F.col("id").alias("rep"), "_text"), "rep") \
        .groupBy("key", "i", "main", "j").applyInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, class_id (smallest id of its group), kept (whether that is its own)."""
    idf = document_frequencies(docs, size, text_col)
    signed = staged(signatures(docs, idf, size, id_col, text_col), "minhash-signatures")
    exact = signed.filter("n_words > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    exact = staged(exact, "minhash-classes")
    members = exact.select("rep", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = staged(members.join(sizes, "key"), "minhash-members")
    rank = members.groupBy("rep").agg(F.sum("n").alias("rank"))
    best = members.join(rank, "rep").groupBy("key").agg(F.min(F.struct((-F.col("rank")).alias("r"), "rep"))["rep"].alias("center"))
    members = staged(members.join(best, "key").select("key", "rep", "center"), "minhash-members")

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("_text")) \
        .join(members.select(F.col("rep").alias("id")).distinct().hint("merge"), "id").dropDuplicates(["id"])  # dealt by id at every size
    texts = staged(texts, "minhash-texts")
    ordered = lambda df, a, b: df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    tested = _verified(ordered(members, "rep", "center"), texts, idf, size)
    linked = F.col("sim") >= least - 1e-12
    groups = components(tested.filter(linked), "a", "b")
    # keys whose texts stand in different groups; groups may still meet there
    placed = members.select("key", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("grp"))
    apart = placed.groupBy("key").agg(F.min("grp").alias("x"), F.max("grp").alias("y"), F.count("*").alias("n")).filter("x <> y").select("key", "n")
    open_ = staged(placed.join(apart, "key"), "minhash-open")
    few = open_.filter(F.col("n") <= SMALL)
    other = few.select("key", F.col("rep").alias("b"), F.col("grp").alias("grp_b"))
    pairs = ordered(few.join(other, "key").filter("grp < grp_b"), "rep", "b").join(tested, ["a", "b"], "left_anti")
    in_pairs = _verified(staged(pairs, "minhash-pairs"), texts, idf, size).filter(linked).select("a", "b")
    in_blocks = staged(_compared(open_.filter(F.col("n") > SMALL).drop("n"), texts, idf, size, least), "minhash-tested")
    groups = components(tested.filter(linked).select("a", "b").unionByName(in_pairs).unionByName(in_blocks), "a", "b")
    classes = exact.select("k1", "k2", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("k1", "k2", F.coalesce("component", "rep").alias("class_id"))
    found = signed.select("id", F.when(F.col("n_words") > 0, F.col("k1")).alias("k1"), "k2").join(classes, ["k1", "k2"], "left")
    return found.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id")) \
        .withColumn("kept", F.col("class_id").eqNullSafe(F.col(id_col)))


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document (the smallest id) of each group, all columns as they are, whatever their names. Null
    ids are one document; rows that share a kept id all stay."""
    name = "_kept"
    while name in docs.columns:
        name += "_"
    kept = near_duplicates(docs, id_col=id_col, **options).filter("kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept[name]), "left_semi")
