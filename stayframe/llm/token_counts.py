"""Exact token counts of every prefix of a text (byte-level BPE) by prefix dynamic programming.

A text falls into pieces by the tokenizer's splitting pattern; merges never cross
them. Within a piece the last token of each prefix is unique: it is the vocabulary
entry ending there that byte-pair encoding keeps apart from the last token of what
stands before it. So ``count[i] = count[i - len(last)] + 1`` gives the exact count
at every prefix in one pass, and counts at any cut, truncation points and budgets
follow without encoding again. Pieces repeat, so each distinct piece is computed
once per worker (bounded memory) and its count reused.

Null and empty texts have 0 bytes and 0 tokens. The strings of special tokens inside
a text count as those tokens, as in the library's default. Very long texts are
handled whole. Repeated rows give repeated results; extra columns of the input are
not read, so their names cannot clash.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import released
from ._text import Memo, codepoints, slices, span_hash, utf8

LETTER, NUMBER, OTHER, SPACE, UNSEEN = 1, 2, 3, 4, 0
#: Pieces of at most so many bytes are computed together.
TOGETHER = 48
#: Bits of a token's id where two are packed; id of no token; multiplier of the rolling hash; bits of it that address the sieve.
PAIR_BITS = 31
NOTHING, BASE, SIEVE_SHIFT = (1 << PAIR_BITS) - 1, np.uint64(0xD6E8FEB86659FD93), np.uint64(42)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class CharClasses:
    """Letter, number, other or white space of every code point, as the tokenizer's
    own splitter sees it: asked once for each code point that occurs."""

    def __init__(self, probe):
        self.probe = probe
        self.table = np.zeros(0x110000, np.uint8)
        ascii_ = [SPACE if c in "\t\n\v\f\r " else LETTER if c.isalpha() else NUMBER if c.isdigit() else OTHER
                  for c in map(chr, range(128))]
        self.table[:128] = ascii_

    def __call__(self, cp: np.ndarray) -> np.ndarray:
        out = self.table[cp]
        if (out == UNSEEN).any():
            for c in np.unique(cp[out == UNSEEN]).tolist():
                self.table[c] = self.probe(chr(c))
            out = self.table[cp]
        return out


def contractions(cp: np.ndarray, cls: np.ndarray, run: np.ndarray, row: np.ndarray, loose: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of an apostrophe that begins 's 't 'm 'd 're 've 'll, and the length
    of each. ``run`` and ``row`` flag first characters of runs and rows (with one more entry,
    true, behind the last); unless ``loose``, a blank in front takes the apostrophe away."""
    n = len(cp)
    at = np.flatnonzero(cp == 39)
    at = at[run[at] & run[at + 1]]
    at = at[(at + 1 < n)]
    at = at[~row[at + 1]]
    if not loose and len(at):
        at = at[(at == 0) | row[at] | (cp[np.maximum(at - 1, 0)] != 32)]
    if not len(at):
        return at, at
    a = cp[at + 1]
    far = np.minimum(at + 2, n - 1)
    b = np.where((at + 2 < n) & ~row[at + 2], cp[far], 0)
    length = np.zeros(len(at), np.int64)
    for c in "stmd":
        length[a == ord(c)] = 2
    for c, d in ("re", "ve", "ll"):
        length[(a == ord(c)) & (b == ord(d))] = 3
    return at[length > 0], length[length > 0]


def split_blank_led(cp: np.ndarray, offsets: np.ndarray, classes: CharClasses) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the pattern whose words take one blank in front: starts, ends and class of the last character."""
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    cls = classes(cp)
    row = np.zeros(n + 1, bool)
    row[offsets] = True
    run = row.copy()
    run[1:n] |= cls[1:] != cls[:-1]
    run[n] = True
    first = run.copy()
    begin = np.flatnonzero(run)
    begin, stop = begin[:-1], begin[1:]
    space = cls[begin] == SPACE
    followed = space & ~row[stop]
    stops = stop[followed]
    first[stops - 1] = True
    first[stops[cp[stops - 1] == 32]] = False
    at, length = contractions(cp, cls, run, row, loose=False)
    first[at + 1] = False
    first[at + length] = True
    starts = np.flatnonzero(first[:n])
    ends = np.append(starts[1:], n)
    return starts, ends, cls[ends - 1]


class PrefixCounter:
    """Exact counts at every prefix for one byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        back = {c: b for b, c in enumerate(byte_alphabet())}
        raw = lambda s: bytes(back[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.longest = max(map(len, self.ids))
        self.ranks = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[raw(a), raw(b)] = r
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        splitter = Tokenizer.from_file(path).pre_tokenizer

        def probe(c: str) -> int:
            if len(splitter.pre_tokenize_str("a" + c)) == 1:
                return LETTER
            if len(splitter.pre_tokenize_str("1" + c)) == 1:
                return NUMBER
            return OTHER if len(splitter.pre_tokenize_str("!" + c)) == 1 else SPACE

        self.classes = CharClasses(probe)
        self.memo = Memo()
        self.names = {i: t for t, i in self.ids.items()} | {NOTHING: b""}
        self.pair_memo, self.known = Memo(bool), {}
        self.powers = np.cumprod(np.full(TOGETHER + 1, BASE, np.uint64)) * pow(int(BASE), -1, 1 << 64)
        value = np.zeros(len(self.ids), np.uint64)
        for k, t in enumerate(self.ids):
            h = 0
            for c in t:
                h = (h * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
            value[k] = h
        by_hash = np.argsort(value)
        self.token_hash, self.token_of = value[by_hash], np.array(list(self.ids.values()))[by_hash]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.token_hash >> SIEVE_SHIFT] = True

    def merged(self, data: bytes) -> list[bytes]:
        """Byte-pair encoding of one short piece."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, a: bytes, b: bytes) -> bool:
        """Whether byte-pair encoding keeps a | b as these two tokens."""
        return self.merged(a + b) == ([a, b] if a else [b])

    def prefixes(self, piece: bytes) -> list[int]:
        """Counts of the len(piece) + 1 prefixes of one piece, by bytes."""
        last, counts, known, names = [NOTHING], [0], self.known, self.names
        for edge, length, token in self._endings(piece):
            place = edge.tolist()
            for k in range(len(place) - 1):
                for c in range(place[k], place[k + 1]):  # the longest first, until one is kept apart from what precedes it
                    before = len(last) - length[c]
                    key = last[before] << PAIR_BITS | token[c]
                    good = known.get(key)
                    if good is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        good = known[key] = self.apart(names[last[before]], names[token[c]])
                    if good:
                        last.append(token[c])
                        counts.append(counts[before] + 1)
                        break
        return counts

    def _endings(self, piece: bytes) -> Iterator[tuple[np.ndarray, list, list]]:
        """For each end 1 .. len(piece), in steps: places of its tokens in (length, token), the longest first."""
        data = np.frombuffer(piece, np.uint8).astype(np.uint64) + np.uint64(1)
        n = len(data)
        power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, BASE, np.uint64))])
        back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, pow(int(BASE), -1, 1 << 64), np.uint64))])
        prefix = np.zeros(n + 1, np.uint64)
        prefix[1:] = np.cumsum(data * back[1:]) * power[1:]
        for a in range(1, n + 1, 1 << 15):
            ends, found = np.arange(a, min(a + (1 << 15), n + 1)), []
            for size in range(min(self.longest, int(ends[-1])), 0, -1):
                i = ends[ends >= size]
                sub = prefix[i] - prefix[i - size] * power[size]
                maybe = np.flatnonzero(self.sieve[sub >> SIEVE_SHIFT])
                at = np.minimum(np.searchsorted(self.token_hash, sub[maybe]), len(self.token_hash) - 1)
                same = self.token_hash[at] == sub[maybe]
                found.append((i[maybe[same]], np.full(int(same.sum()), size), self.token_of[at[same]]))
            end, length, token = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(end, kind="stable")
            yield np.searchsorted(end[order], np.append(ends, ends[-1] + 1)), length[order].tolist(), token[order].tolist()

    def totals(self, pieces: list[bytes]) -> np.ndarray:
        """Counts of many pieces: the same programme for all short ones together, position by position."""
        out = np.zeros(len(pieces), np.int64)
        lens = np.array([len(p) for p in pieces])
        for k in np.flatnonzero(lens > TOGETHER):
            out[k] = self.prefixes(pieces[k])[-1]
        order = np.flatnonzero(lens <= TOGETHER)
        order = order[np.argsort(-lens[order], kind="stable")]
        for at in range(0, len(order), 1 << 15):
            part = order[at:at + (1 << 15)]
            out[part] = self._together([pieces[k] for k in part], lens[part])
        return out

    def _together(self, pieces: list[bytes], lens: np.ndarray) -> np.ndarray:
        """Counts of pieces of descending lengths."""
        n, width = len(pieces), int(lens[0])
        grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        prefix = np.zeros((width + 1, n), np.uint64)
        last = np.full((width + 1, n), NOTHING, np.int64)
        counts = np.zeros((width + 1, n), np.int32)
        for i in range(1, width + 1):
            prefix[i] = prefix[i - 1] * BASE + grid[:, i - 1] + np.uint64(1)
        for i in range(1, width + 1):
            live = int(np.searchsorted(-lens, -i, "right"))
            low = max(0, i - self.longest)
            sub = prefix[i, :live] - prefix[low:i, :live] * self.powers[i - low:0:-1, None]
            maybe = self.sieve[sub >> SIEVE_SHIFT]
            where = np.flatnonzero(maybe)
            found = sub.ravel()[where]
            at = np.minimum(np.searchsorted(self.token_hash, found), len(self.token_hash) - 1)
            where, at = where[self.token_hash[at] == found], at[self.token_hash[at] == found]
            token = np.full(sub.shape, -1, np.int64)
            token.ravel()[where] = self.token_of[at]
            rest = np.arange(live)
            while len(rest):  # the longest candidate first, until one is kept apart from what precedes it
                j = (token[:, rest] >= 0).argmax(0)
                pick = token[j, rest]
                key = (last[low + j, rest] << PAIR_BITS | pick).astype(np.uint64)
                keys, inverse = np.unique(key, return_inverse=True)
                good = self.pair_memo.get(keys, lambda new: self._apart_ids(keys[new]))[inverse]  # noqa: B023
                done = rest[good]
                last[i, done] = pick[good]
                counts[i, done] = counts[low + j[good], done] + 1
                token[j[~good], rest[~good]] = -1
                rest = rest[~good]
        return counts[lens, np.arange(n)]

    def _apart_ids(self, keys: np.ndarray) -> np.ndarray:
        names = self.names
        return np.array([self.apart(names[k >> PAIR_BITS], names[k & NOTHING]) for k in keys.tolist()], bool)

    def count_pieces(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, first, inverse = np.unique(span_hash(cp, starts, ends), return_index=True, return_inverse=True)

        def compute(new: np.ndarray) -> np.ndarray:
            at = first[new]
            return self.totals([cp[s:e].tobytes().decode("utf-32-le").encode() for s, e in zip(starts[at], ends[at])])

        return self.memo.get(keys, compute)[inverse]

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text between special strings, and these (flagged)."""
        out, at = [], 0
        while True:
            hits = [(text.find(s, at), -len(s), s) for s in self.special]
            hits = [h for h in hits if h[0] >= 0]
            if not hits:
                return [*out, (text[at:], False)]
            where, _, s = min(hits)
            out += [(text[at:where], False), (s, True)]
            at = where + len(s)

    def pieces(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points, piece starts, ends and counts of one text without special strings."""
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, ends, _ = split_blank_led(cp, np.array([0, len(cp)]), self.classes)
        return cp, starts, ends, self.count_pieces(cp, starts, ends)

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of the len(text) + 1 prefixes of a text, by characters: entry i is
        the count of ``text[:i]`` encoded alone."""
        out, base, done = [np.zeros(1, np.int64)], 0, 0
        for part, special in self.parts(text):
            if special:
                # unfinished, its string is ordinary text behind the text before it
                head = self._segment_before(text, done)
                inner = self._plain(head + part[:-1])[len(head) + 1:] + (base - self._plain(head)[-1])
                base += 1
                out += [inner, np.array([base])]
            else:
                counts = self._plain(part)
                out.append(counts[1:] + base)
                base += int(counts[-1])
            done += len(part)
        return np.concatenate(out)

    def _segment_before(self, text: str, at: int) -> str:
        """The ordinary text from the last special string up to ``at``."""
        start = max([0, *(p + len(s) for s in self.special if (p := text.rfind(s, 0, at)) >= 0)])
        return text[start:at]

    def _plain(self, text: str) -> np.ndarray:
        cp, starts, ends, counts = self.pieces(text)
        out = np.zeros(len(cp) + 1, np.int64)
        before = np.concatenate([[0], np.cumsum(counts)])
        cls = self.classes(cp) if len(cp) else cp
        for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            chars = cp[s:e].tobytes().decode("utf-32-le")
            by_byte = self.prefixes(chars.encode())
            size = np.cumsum([len(c.encode()) for c in chars])
            out[s + 1:e + 1] = before[k] + np.array(by_byte)[size]
            if e - s == 3 and cp[s] == 39 and cls[s + 1] == LETTER:  # the apostrophe and one letter alone are two pieces
                out[s + 2] = before[k] + 2
        spaces = np.flatnonzero(cls == SPACE) if len(cp) else []
        for i in spaces:  # a prefix that ends in white space ends with the whole run as one piece
            if i and cls[i - 1] == SPACE:
                continue
            j = i
            while j < len(cp) and cls[j] == SPACE:
                j += 1
            run = cp[i:j].tobytes().decode("utf-32-le")
            k = int(np.searchsorted(starts, i, "right")) - 1
            by_byte = self.prefixes(run.encode())
            size = np.cumsum([len(c.encode()) for c in run])
            out[i + 1:j + 1] = before[k] + np.array(by_byte)[size]
        return out

    def cut(self, text: str, budget: int) -> int:
        """Length in characters of the longest prefix of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _batch_counts(own: PrefixCounter, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and tokens of every row."""
    data, offsets = utf8(column)
    n_bytes, n_tokens = np.diff(offsets), np.zeros(len(offsets) - 1, np.int64)
    for i, j in slices(offsets):
        part, off = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        if not len(part):
            continue
        raw = part.tobytes()
        if any(s.encode() in raw for s in own.special):
            for k in range(i, j):
                text = data[offsets[k]:offsets[k + 1]].tobytes().decode()
                n_tokens[k] = sum(1 if special else int(own.pieces(t)[3].sum()) for t, special in own.parts(text))
            continue
        cp, rows = codepoints(part, off)
        starts, ends, _ = split_blank_led(cp, rows, own.classes)
        total = np.concatenate([[0], np.cumsum(own.count_pieces(cp, starts, ends))])
        n_tokens[i:j] = np.diff(total[np.searchsorted(starts, rows)])
    return n_bytes, n_tokens


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, tokens and whether the tokens exceed ``limit``, per row: id, n_bytes, n_tokens, over_limit.

    One pass without a shuffle. Null text: 0 bytes, 0 tokens, not over. Empty input: no rows.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for b in batches:
            n_bytes, n_tokens = _batch_counts(own, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)],
                                             names=["_id", "n_bytes", "n_tokens", "over_limit"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(released(run), f"_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("_id", id_col)


def truncate_to_budget(docs: DataFrame, vocabulary: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The longest prefix of every text that has at most ``budget`` tokens when encoded alone:
    id, text, n_tokens. Null text stays null with 0 tokens."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for b in batches:
            texts, counts = [], []
            for t in b.column(1).to_pylist():
                at = own.prefix_counts(t or "")
                cut = int(np.flatnonzero(at <= budget)[-1])
                texts.append(None if t is None else t[:cut])
                counts.append(int(at[cut]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["_id", "_text", "n_tokens"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(released(run), f"_id {kind}, _text string, n_tokens bigint")
    return out.withColumnsRenamed({"_id": id_col, "_text": text_col})


def prefix_table(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored counts: per text the array of the counts at every prefix (characters 0 to its
    length), for truncation and budget questions without encoding again. Null text: [0]."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for b in batches:
            rows = [own.prefix_counts(t or "").astype(np.int32) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["_id", "counts"])

    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(released(run), f"_id {kind}, counts array<int>")
    return out.withColumnRenamed("_id", id_col)
