"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

Words are runs of ASCII letters and digits and of all non-ASCII characters, A-Z
lower-cased. A window is ``window`` consecutive words of a benchmark item (an item of
fewer, but not none, is one window). A document holds a window only if it holds all its
words, so the join needs just the first element of each window's words in order of
rarity (counted over the whole corpus): the rarest. Every place of that word in a
document fixes where the window would start; places that would reach over the document's
ends are dropped (length and position bounds), the others are compared word by word and
verified on the bytes.

The windows are cut into blocks of at most ``BLOCK_BYTES``; each block goes to the tasks
as a broadcast of that bounded size, and the documents flow through the blocks one after
the other without a shuffle, so neither the benchmark's size nor a common word or passage
sets a limit. Null and empty texts have no words and no hits. Items without words give no
window. Repeated items and documents each count for themselves. An empty benchmark
leaves all documents clean. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import released, staged
from ._text import LOWER_BYTE, byte_words, slices, utf8

#: Windows are taken in blocks of about so many bytes; after so many blocks the documents' state is written.
BLOCK_BYTES, BLOCKS_A_STAGE = 16 << 20, 8

_WINDOWS = "item string, win binary, hashes binary"
_STATE = "n_words bigint, spans array<struct<first:bigint,last:bigint>>, items array<string>"


def _lowered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(LOWER_BYTE[data[s:e]].tobytes() for s, e in zip(starts, ends))


def item_windows(items: DataFrame, window: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, win, hashes): the distinct windows of every item; ids as strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            names = b.column(0).to_pylist()
            for i, j in slices(offsets):
                part = data[offsets[i]:offsets[j]]
                starts, ends, hashes, at = byte_words(part, offsets[i:j + 1] - offsets[i])
                found: dict[tuple, bytes] = {}
                for k in range(j - i):
                    a, n = int(at[k]), int(at[k + 1] - at[k])
                    size = min(window, n)
                    for p in range(a, a + n - size + 1 if n else a):
                        found[names[i + k], _lowered(part, starts[p:p + size], ends[p:p + size])] = hashes[p:p + size].astype("<u8").tobytes()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.binary()),
                                                      pa.array(list(found.values()), pa.binary())], names=["item", "win", "hashes"])

    return items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("_text")).filter("item IS NOT NULL") \
        .mapInArrow(released(run), _WINDOWS).dropDuplicates(["item", "win"])


def _counted(docs: DataFrame, text_col: str, vocabulary) -> np.ndarray:
    """How often each hash of the (broadcast, sorted) vocabulary occurs in the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary.value
        counts, sieve = np.zeros(len(words), np.int64), _sieve(words)
        for b in batches:
            data, offsets = utf8(b.column(0))
            for i, j in slices(offsets):
                hashes = byte_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])[2]
                at, _ = _lookup(words, sieve, hashes)
                counts += np.bincount(at, minlength=len(words))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["k", "n"])

    counts = np.zeros(len(vocabulary.value), np.int64)
    total = docs.select(text_col).mapInArrow(released(run), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    for k, n in total.toLocalIterator():  # at most one row for each word of the block
        counts[k] = n
    return counts


def _sieve(words: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[words >> np.uint64(44)] = True
    return out


def _lookup(words: np.ndarray, sieve: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` and in ``hashes`` of those hashes that are words."""
    where = np.flatnonzero(sieve[hashes >> np.uint64(44)])
    if not len(where) or not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, hashes[where]), len(words) - 1)
    same = words[at] == hashes[where]
    return at[same], where[same]


class _Block:
    """Windows of one block under their rarest word."""

    def __init__(self, rows: list, words: np.ndarray, counts: np.ndarray):
        kept = []
        for item, win, packed in rows:
            hashes = np.frombuffer(packed, "<u8")
            n = counts[np.searchsorted(words, hashes)]
            if n.min() > 0:  # else a word of it occurs nowhere
                kept.append((int(hashes[n.argmin()]), int(n.argmin()), hashes, win, item))
        kept.sort(key=lambda x: (x[0], x[1], x[3], x[4]))
        self.items, self.wins = [x[4] for x in kept], [x[3] for x in kept]
        self.offset = np.array([x[1] for x in kept], np.int64)
        self.size = np.array([len(x[2]) for x in kept], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.hashes = np.concatenate([x[2] for x in kept]) if kept else np.zeros(0, np.uint64)
        keys = np.array([x[0] for x in kept], np.uint64)
        self.keys, self.first = np.unique(keys, return_index=True)
        self.first = np.append(self.first, len(kept))
        self.sieve = _sieve(self.keys)

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each row; verified occurrences as (row, first word in the row, window)."""
        starts, ends, hashes, at = byte_words(data, offsets)
        key, place = _lookup(self.keys, self.sieve, hashes)
        row = np.searchsorted(at, place, "right") - 1
        out = []
        many = self.first[key + 1] - self.first[key]
        total = np.concatenate([[0], np.cumsum(many)])
        i = 0
        while i < len(key):  # candidates in parts of bounded size
            j = max(i + 1, int(np.searchsorted(total, total[i] + (1 << 20), "right")) - 1)
            n = many[i:j]
            win = np.repeat(self.first[key[i:j]] - (total[i:j] - total[i]), n) + np.arange(int(n.sum()))
            r = np.repeat(row[i:j], n)
            begin = np.repeat(place[i:j], n) - self.offset[win]
            fits = (begin >= at[r]) & (begin + self.size[win] <= at[r + 1])
            win, r, begin, k = win[fits], r[fits], begin[fits], 0
            while len(win) and k < int(self.size[win].max()):
                same = (k >= self.size[win]) | (hashes[np.minimum(begin + k, len(hashes) - 1)] == self.hashes[np.minimum(self.at[win] + k, len(self.hashes) - 1)])
                win, r, begin, k = win[same], r[same], begin[same], k + 1
            out += [(r[k], begin[k] - at[r[k]], win[k]) for k in range(len(win))
                    if _lowered(data, starts[begin[k]:begin[k] + self.size[win[k]]], ends[begin[k]:begin[k] + self.size[win[k]]]) == self.wins[win[k]]]
            i = j
        found = np.array(out, np.int64).reshape(-1, 3)
        return np.diff(at), found[:, 0], found[:, 1], found[:, 2]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(docs: DataFrame, items: DataFrame, window: int, text_col: str, item_text: str, item_id: str) -> Iterator:
    """Broadcast blocks of the benchmark's windows."""
    spark = docs.sparkSession
    windows = staged(item_windows(items, window, item_id, item_text), "windows")
    size = windows.agg(F.sum(F.length("win") + F.length("hashes") + F.length("item"))).first()[0]
    n = -(-(size or 0) // BLOCK_BYTES)
    for k in range(n):
        part = windows.filter(F.pmod(F.xxhash64("win", "item"), F.lit(n)) == k)  # a passage of many items is dealt too
        rows = [tuple(r) for r in part.toLocalIterator()]
        if not rows:
            continue
        words = np.unique(np.concatenate([np.frombuffer(r[2], "<u8") for r in rows]))
        counts = _counted(docs, text_col, spark.sparkContext.broadcast(words))
        yield spark.sparkContext.broadcast(_Block(rows, words, counts))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: id, n_words, spans (maximal runs [first, last) of hit words) and items
    (ids, as strings, of the items with occurring windows, sorted)."""
    kind = dict(docs.dtypes)[id_col]
    state = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.lit(0).cast("bigint").alias("n_words"),
                        F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)").alias("spans"),
                        F.expr("cast(array() as array<string>)").alias("items"))
    schema, blocks, held = f"_id {kind}, {_STATE}, _text string", 0, None
    state = state.select("_id", "n_words", "spans", "items", "_text")
    for block in _blocks(docs, items, window, text_col, item_text, item_id):
        if held is not None:
            state, blocks = state.mapInArrow(released(_through(held)), schema), blocks + 1
            state = staged(state, "decontaminate") if blocks % BLOCKS_A_STAGE == 0 else state
        held = block
    if held is None:
        state = state.withColumn("n_words", F.regexp_count(F.coalesce("_text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("bigint"))
    else:  # behind the last block the texts are not needed
        state = state.mapInArrow(released(_through(held, last=True)), f"_id {kind}, {_STATE}")
    return state.select(F.col("_id").alias(id_col), "n_words", "spans", "items")


def _through(block, last: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        for b in batches:
            data, offsets = utf8(b.column(4))
            counts, spans, items = np.zeros(b.num_rows, np.int64), b.column(2).to_pylist(), b.column(3).to_pylist()
            for i, j in slices(offsets):
                n, rows, first, wins = own.hits(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                counts[i:j] = n
                order = np.argsort(rows, kind="stable")
                edge = np.searchsorted(rows[order], np.arange(j - i + 1))
                for r in np.unique(rows).tolist():
                    own_hits = order[edge[r]:edge[r + 1]]
                    found = [(s["first"], s["last"]) for s in spans[i + r]]
                    found += [(int(first[h]), int(first[h] + own.size[wins[h]])) for h in own_hits]
                    spans[i + r] = [{"first": a, "last": z} for a, z in _union(found)]
                    items[i + r] = sorted({*items[i + r], *(own.items[wins[h]] for h in own_hits)})
            columns = [b.column(0), pa.array(counts), pa.array(spans, b.schema.field(2).type), pa.array(items, b.schema.field(3).type), b.column(4)]
            yield pa.RecordBatch.from_arrays(columns[:4] if last else columns, names=["_id", "n_words", "spans", "items", "_text"][:4 if last else 5])

    return run


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and the digest of the item ids: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["last"] - s["first"])
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents without any hit, all columns as they are."""
    out = docs
    blocks = 0
    for block in _blocks(docs, items, window, text_col, item_text, item_id):
        if blocks and blocks % BLOCKS_A_STAGE == 0:
            out = staged(out, "decontaminate")
        out, blocks = out.mapInArrow(released(_clean(block, docs.columns.index(text_col))), docs.schema), blocks + 1
    return out


def _clean(block, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = block.value
        for b in batches:
            data, offsets = utf8(b.column(at))
            keep = np.ones(b.num_rows, bool)
            for i, j in slices(offsets):
                rows = own.hits(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])[1]
                keep[i + rows] = False
            yield b.filter(pa.array(keep))

    return run

