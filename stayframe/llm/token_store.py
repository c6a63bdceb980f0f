"""Token-ID shards compressed by Re-Pair grammars, with random access to every document.

Documents are put in ascending id order by a range partitioning (no partition needs
another's rows), encoded, and each document's ids end with ``end_id``. A partition
writes blocks of about ``block_ids`` ids. In a block, pairs of adjacent ids that occur
often are replaced by new symbols (nonterminals), again and again, until no pair is
frequent enough; a pair never holds the end of a document, so no symbol reaches over two.
A block is one row of a Parquet table:

==============  ==========================================================================
shard, block    place in the order: partition, then block of it
n_ids, n_docs   ids and documents of the block
doc_ids         their ids
doc_at          first symbol of each document in ``symbols`` (plus the end), little-endian int64
symbols         the final sequence, little-endian uint16 or uint32 (``width`` bytes each); the
                symbol ``first_rule - 1`` closes a document and stands for ``end_id``
rules           pairs (left, right) of the nonterminals from ``first_rule`` on, little-endian uint32
lengths         how many ids each nonterminal stands for, little-endian int64
==============  ==========================================================================

Written by Spark's own committer, so a lost executor only repeats its tasks. Null texts
are empty: their one id is ``end_id``. Rows with equal ids are ordered by a hash of the
text; equal rows are interchangeable. Empty input: an empty store. Extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._stage import released
from ._text import Memo, codepoints, slices, span_hash, utf8
from .token_counts import LETTER, NUMBER, OTHER, SPACE, CharClasses, byte_alphabet, contractions

#: A pair is replaced if it occurs so often in its block.
MIN_COUNT, BLOCK_IDS = 24, 1 << 20
#: Bits of a word's number of ids where it is packed with its offset.
LENGTH_BITS = 31
#: Pairs of a block that are looked up at once.
_PART = 1 << 16


class WordEncoder:
    """Ids by the tokenizers library, each distinct word encoded once per worker (bounded memory)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.normal, splitter = self.library.model, self.library.normalizer, self.library.pre_tokenizer
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special_bytes = [s.encode() for s in self.special]

        def probe(c: str) -> int:
            if not splitter.pre_tokenize_str(c):
                return SPACE
            for other, cls in (("a", LETTER), ("!", OTHER)):
                if [at for _, at in splitter.pre_tokenize_str(other + c)] == [(0, 2)]:
                    return cls
            return NUMBER

        self.classes = CharClasses(probe)
        self.lower = np.zeros(0x110000, np.uint32)
        self.lower[:128] = [ord(chr(c).lower()) for c in range(128)]
        self.lower_known = np.zeros(0x110000, bool)
        self.lower_known[:128] = True
        self.bytes = byte_alphabet()
        self.forget()

    def forget(self) -> None:
        self.memo, self.flat, self.used, self.at = Memo(), np.zeros(1 << 16, np.uint32), 0, [0]

    def _row(self, text: str) -> str:
        """A text that the plain path takes as it is: normalised by the library where it must be."""
        odd = not text.isascii() and (not unicodedata.is_normalized("NFC", text) or "İ" in text)
        return self.normal.normalize_str(text) if odd else text

    def _lowered(self, cp: np.ndarray) -> np.ndarray:
        if not self.lower_known[cp].all():
            for c in np.unique(cp[~self.lower_known[cp]]).tolist():
                low = self.normal.normalize_str(chr(c))
                self.lower[c] = ord(low) if len(low) == 1 else c
                self.lower_known[c] = True
        return self.lower[cp]

    def _words(self, cp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words: letter runs, single numbers, runs of others, contractions."""
        n = len(cp)
        cls = self.classes(cp)
        row = np.zeros(n + 1, bool)
        row[rows] = True
        run = row.copy()
        run[1:n] |= cls[1:] != cls[:-1]
        run[n] = True
        first = run.copy()
        first[:n] |= cls == NUMBER
        at, length = contractions(cp, cls, run, row, loose=True)
        first[at + 1] = False
        first[at + length] = True
        starts = np.flatnonzero(first[:n])
        ends = np.append(starts[1:], n)
        keep = cls[starts] != SPACE
        return starts[keep], ends[keep]

    def _compute(self, words: list[str]) -> np.ndarray:
        """Places (offset << LENGTH_BITS | length) in ``flat`` of new words' ids."""
        out, alphabet, found = np.zeros(len(words), np.int64), self.bytes, []
        base = self.used
        for k, w in enumerate(words):
            ids = [t.id for t in self.model.tokenize("".join([alphabet[b] for b in w.encode()]))]
            out[k] = base << LENGTH_BITS | len(ids)
            base += len(ids)
            found += ids
        if base > len(self.flat):
            self.flat = np.concatenate([self.flat[:self.used], np.zeros(max(base - self.used, len(self.flat)), np.uint32)])
        self.flat[self.used:base] = found
        self.used = base
        return out

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of one slice, one after the other, and the offsets of the rows."""
        raw = data.tobytes()
        if any(s in raw for s in self.special_bytes):
            each = [self.library.encode(raw[s:e].decode(), add_special_tokens=False).ids for s, e in zip(offsets[:-1], offsets[1:])]
            return np.array(list(itertools.chain.from_iterable(each)), np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        text = raw.decode()
        if not text.isascii() and (not unicodedata.is_normalized("NFC", text) or "İ" in text):
            fixed = [self._row(raw[s:e].decode()).encode() for s, e in zip(offsets[:-1], offsets[1:])]
            data, offsets = np.frombuffer(b"".join(fixed), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in fixed])])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cp, rows = codepoints(data, offsets)
        cp = self._lowered(cp)
        starts, ends = self._words(cp, rows)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.memo.keys) > 1_000_000:
            self.forget()
        keys, one, inverse = np.unique(span_hash(cp, starts, ends), return_index=True, return_inverse=True)
        place = self.memo.get(keys, lambda new: self._compute([cp[starts[k]:ends[k]].tobytes().decode("utf-32-le") for k in one[new]]))
        where, lens = (place >> LENGTH_BITS)[inverse], (place & ((1 << LENGTH_BITS) - 1))[inverse]
        total = np.concatenate([[0], np.cumsum(lens)])
        ids = self.flat[np.repeat(where - total[:-1], lens) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, rows)]

    def rows(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each slice of rows [i, j): their ids with ``end_id`` behind each, and the rows' offsets."""
        data, offsets = utf8(column)
        for i, j in slices(offsets):
            ids, at = self._slice(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
            yield i, j, np.insert(ids, at[1:], end_id), at + np.arange(j - i + 1)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _often(key: np.ndarray, min_count: int) -> np.ndarray:
    """Sorted distinct keys that occur so often."""
    key = np.sort(key)
    edge = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    return key[edge[np.diff(np.append(edge, len(key))) >= min_count]]


def re_pair(ids: np.ndarray, end_id: int, min_count: int = MIN_COUNT, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols, rules, first rule's symbol) of one block. Each round makes every frequent pair a nonterminal and
    replaces its occurrences from the left, until no pair is frequent. An occurrence that stays overlaps one that was
    replaced, so it is none any more: after a round only pairs with a symbol of that round can be frequent, and only
    these are counted in the next one. ``rounds`` ends it earlier."""
    seq = ids.astype(np.int32 if int(ids.max(initial=end_id)) < 1 << 30 and len(ids) < 1 << 30 else np.int64)
    first = top = int(seq.max(initial=end_id)) + 1
    rules: list[np.ndarray] = []
    young = np.ones(len(seq), bool)  # symbols of the last round
    while len(seq) > 1 and (rounds is None or len(rules) < rounds):
        asked = (seq[:-1] != end_id) & (seq[1:] != end_id) & (young[:-1] | young[1:])
        key = seq[:-1][asked].astype(np.int64)
        key <<= 32
        key |= seq[1:][asked]
        pairs = _often(key, min_count)
        if not len(pairs):
            break
        sieve = np.zeros(1 << 20, bool)
        slot = lambda k: (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        sieve[slot(pairs)] = True
        maybe = np.concatenate([i + np.flatnonzero(sieve[slot(key[i:i + _PART])]) for i in range(0, len(key), _PART)])
        key, spot = key[maybe], np.flatnonzero(asked)[maybe]
        rule = np.searchsorted(pairs, key)
        rule[rule == len(pairs)] = 0
        same = pairs[rule] == key
        at, rule = spot[same], rule[same]
        del key, spot, maybe, same, asked
        # of overlapping occurrences every second one is replaced, from the left
        head = np.concatenate([[True], at[1:] != at[:-1] + 1])
        order = np.arange(len(at))
        nth = order - np.maximum.accumulate(np.where(head, order, 0))
        at, rule = at[nth % 2 == 0], rule[nth % 2 == 0]
        seq[at] = top + rule
        young = np.zeros(len(seq), bool)
        young[at] = True
        seq, young = np.delete(seq, at + 1), np.delete(young, at + 1)
        rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1))
        top += len(pairs)
    return seq, np.concatenate(rules).astype(np.uint32) if rules else np.zeros((0, 2), np.uint32), first


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal stands for; rules refer to earlier ones only."""
    out = np.zeros(len(rules), np.int64)
    size = lambda s: np.where(s < first, 1, out[np.maximum(s.astype(np.int64) - first, 0)])
    open_ = np.arange(len(rules))
    while len(open_):  # as often as rules nest
        a, b = size(rules[open_, 0]), size(rules[open_, 1])
        out[open_] = np.where((a > 0) & (b > 0), a + b, 0)
        open_ = open_[out[open_] == 0]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, first: int, end_id: int) -> np.ndarray:
    """The ids that symbols stand for; the symbol below ``first`` closes a document."""
    seq = symbols.astype(np.int64)
    while (inner := np.flatnonzero(seq >= first)).size:
        pair = rules[seq[inner] - first].astype(np.int64)
        seq[inner] = pair[:, 0]
        seq = np.insert(seq, inner + 1, pair[:, 1])
    seq[seq == first - 1] = end_id
    return seq.astype(np.uint32)


_STORE = ("shard int, block int, n_ids bigint, n_docs bigint, doc_ids array<{kind}>, doc_at binary, width int, "
          "symbols binary, end_id bigint, first_rule bigint, rules binary, lengths binary")


def _block(shard: int, number: int, doc_ids: list, ids: np.ndarray, sizes: list[int], end_id: int) -> tuple:
    """A row of the store. The id may also occur inside a text, so the one that closes a
    document is a symbol of its own here: the one below the first rule's."""
    closing = int(max(ids.max(initial=0), end_id)) + 1
    ids = ids.astype(np.int32 if closing < 1 << 30 else np.int64)
    ids[np.cumsum(sizes) - 1] = closing
    symbols, rules, first = re_pair(ids, closing)
    ends = np.flatnonzero(symbols == closing) + 1
    width = 2 if int(symbols.max(initial=0)) < 1 << 16 else 4
    return (shard, number, len(ids), len(doc_ids), doc_ids, np.concatenate([[0], ends]).astype("<i8").tobytes(), width,
            symbols.astype(f"<u{width}").tobytes(), end_id, first, rules.astype("<u4").tobytes(), rule_lengths(rules, first).astype("<i8").tobytes())


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` and write the store to ``path``."""
    kind = dict(docs.dtypes)[id_col]
    schema = _STORE.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        own, shard, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        arrow = to_arrow_schema(out_type)
        names, sizes, held, size = [], [], [], 0

        def flush():
            nonlocal names, sizes, held, size, number
            ids, held = np.concatenate(held), []
            row = _block(shard, number, names, ids, sizes, end_id)
            names, sizes, held, size, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, arrow)], schema=arrow)

        for b in batches:
            all_ids = b.column(0).to_pylist()
            for i, j, ids, at in own.rows(b.column(1), end_id):
                k = 0
                while k < j - i:  # whole documents, until the block is full
                    stop = max(k + 1, int(np.searchsorted(at, at[k] + block_ids - size, "right")) - 1)
                    stop = min(stop, j - i)
                    names += all_ids[i + k:i + stop]
                    held.append(ids[at[k]:at[stop]])
                    sizes += np.diff(at[k:stop + 1]).tolist()
                    size += int(at[stop] - at[k])
                    k = stop
                    if size >= block_ids:
                        yield flush()
        if names:
            yield flush()
        own.forget()  # the worker lives on, and other stages need its memory

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    tie = F.xxhash64("_text")
    ordered = picked.repartitionByRange(F.col("_id").asc_nulls_first(), tie).sortWithinPartitions(F.col("_id").asc_nulls_first(), tie)
    out_type = docs.sparkSession.createDataFrame([], schema).schema
    ordered.mapInArrow(released(run), schema).write.mode("errorifexists").option("parquet.block.size", 16 << 20).parquet(path)


def block_starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, first): ids of all blocks before each. Only the counts are read; the
    running sum is taken within shards, then over one row per shard."""
    blocks = spark.read.parquet(path).select("shard", "block", "n_ids")
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy(F.col("shard").alias("_shard")).agg(F.sum("n_ids").alias("_n")) \
        .select("_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return blocks.join(shards, F.col("shard") == F.col("_shard")).select(
        "shard", "block", (F.col("_base") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).alias("first"))


def _decode(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block and the offsets of its documents."""
    symbols = np.frombuffer(row["symbols"], f"<u{row['width']}")
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
    first, at = row["first_rule"], np.frombuffer(row["doc_at"], "<i8")
    lengths = np.frombuffer(row["lengths"], "<i8")
    size = np.ones(len(symbols), np.int64)
    inner = symbols >= first
    size[inner] = lengths[symbols[inner].astype(np.int64) - first]
    return expand(symbols, rules, first, row["end_id"]), np.concatenate([[0], np.cumsum(size)])[at]


def read_store(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Every document of a store: id, start (ids before it), n_tokens, ids_crc32 (of its ids as little-endian uint32)."""
    store = spark.read.parquet(path)
    kind = dict(store.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    schema = f"shard int, block int, _id {kind}, _at bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, at = _decode(row)
                raw, n = memoryview(ids.astype("<u4").tobytes()), row["n_docs"]
                crc = [zlib.crc32(raw[4 * s:4 * e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["block"], np.int32)),
                     pa.array(row["doc_ids"], b.schema.field("doc_ids").type.value_type), pa.array(at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    names=["shard", "block", "_id", "_at", "n_tokens", "ids_crc32"])

    docs = store.mapInArrow(released(run), schema)
    return docs.join(block_starts(spark, path), ["shard", "block"]).select(
        F.col("_id").alias(id_col), (F.col("first") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, wanted: list, id_col: str = "doc_id") -> DataFrame:
    """Random access: the ids of the documents named in ``wanted``. Only the symbols of these
    documents are expanded, found through the stored places."""
    store = spark.read.parquet(path).filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(w) for w in wanted])))
    kind = dict(store.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    names = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                symbols, at = np.frombuffer(row["symbols"], f"<u{row['width']}"), np.frombuffer(row["doc_at"], "<i8")
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                hits = [k for k, d in enumerate(row["doc_ids"]) if d in names]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_ids"][k] for k in hits], b.schema.field("doc_ids").type.value_type),
                     pa.array([expand(symbols[at[k]:at[k + 1]], rules, row["first_rule"], row["end_id"]).astype(np.int64) for k in hits], pa.list_(pa.int64()))],
                    names=["_id", "ids"])

    return store.mapInArrow(released(run), f"_id {kind}, ids array<bigint>").withColumnRenamed("_id", id_col)
