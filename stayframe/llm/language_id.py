"""Language identification by a byte convolutional network, trained in numpy.

Bytes (A-Z lower-cased) have learned vectors; filters of several widths run over them, the
largest response of each filter in a window is kept, and a softmax layer gives the
languages' probabilities. A text is cut into windows of ``WINDOW`` filter positions (a filter
sees the next window's first bytes, so no place is skipped); windows are applied in batches,
and a text's log probabilities are the mean over its windows, weighted by their bytes. For
prediction the first layers are tables: the response of a filter is a sum of entries for pairs
of bytes.

Training takes about ``SAMPLE`` windows in all, the same number for each language (up to
``WINDOWS_A_TEXT`` from a text where texts are few), from documents picked by a hash of their
id; that bound is the network's only sample, and nothing else comes from it. Prediction reads
whole texts in one pass without a shuffle. Null texts and texts without a letter give ``und``
with score 0. With no labelled document every text gives ``und``. Null labels are not
learned from; null ids are never learned from and count as not held out. Extra columns are not read.

The softmax must choose some language, so its probability cannot tell a text of none. ``keep_known``
also asks whether a text is like any language: the mean log probability of its letter pairs (a-z,
bytes from 128 on and spaces; digits, signs and what stands beside them do not count) under the
Witten-Bell smoothed byte pairs of the language that fits it best must reach a floor. Floors are by the
number of pairs, since short texts vary more: the ``STRANGE`` quantile of windows of held-out labelled texts (two folds by
document), less ``SLACK``. Pairs and floors are counted by Spark over all windows of all labelled texts. Texts without such a pair have nothing to judge and stay.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import released
from ._text import LOWER_BYTE, slices, utf8

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8
SAMPLE, STEPS, BATCH, RATE, WINDOWS_A_TEXT = 8000, 1000, 64, 4e-3, 16
_REACH = max(WIDTHS) - 1
#: Share of known windows below a floor, what is taken off it, and the numbers of letter pairs that have one (others: the next below).
STRANGE, SLACK, SIZES = 0.001, 0.3, (1, 2, 4, 8, 16, 32, 64, 128, 192)
#: Steps of one unit in which means are counted for the floors.
FINE = 1024
_JUDGED = np.zeros(256, bool)
_JUDGED[[32, *range(97, 123), *range(128, 256)]] = True
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte windows (zero behind a row's end), the row of each and the bytes that begin in it."""
    size = np.diff(offsets)
    many = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = offsets[row] + nth * WINDOW
    at = start[:, None] + np.arange(WINDOW + _REACH)
    out = LOWER_BYTE[data[np.minimum(at, len(data) - 1)]] if len(row) else np.zeros((0, WINDOW + _REACH), np.uint8)
    out[at >= offsets[row + 1][:, None]] = 0
    return out, row, np.minimum(size[row] - nth * WINDOW, WINDOW)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


@dataclasses.dataclass
class Model:
    labels: list[str]
    params: dict[str, np.ndarray]
    pairs: np.ndarray | None = None  # [languages, 65536] log probabilities of byte pairs
    floors: np.ndarray | None = None  # least mean of a known text, by SIZES

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """Per width, (offset, entries) by pairs of bytes; an odd width's last byte alone."""
        p, out = self.params, {}
        for w in WIDTHS:
            single = [p["bytes"] @ p[f"w{w}"][j] for j in range(w)]
            out[w] = [(j, (single[j][:, None] + single[j + 1][None]).reshape(-1, FILTERS)) for j in range(0, w - 1, 2)]
            if w % 2:
                out[w].append((w - 1, single[w - 1]))
        return out

    def log_probs(self, x: np.ndarray, tables: dict) -> np.ndarray:
        p, out = self.params, []
        for i in range(0, len(x), 128):
            part = x[i:i + 128].astype(np.int32)
            pair = part[:, :-1] << 8 | part[:, 1:]
            pooled = []
            for w in WIDTHS:
                r = None
                for j, t in tables[w]:
                    e = np.take(t, (part if len(t) == 256 else pair)[:, j:j + WINDOW], axis=0)
                    r = e if r is None else np.add(r, e, out=r)
                while r.shape[1] > 1:
                    half = r.shape[1] // 2
                    r = np.maximum(r[:, :half], r[:, half:])
                pooled.append(r[:, 0] + p[f"b{w}"])
            z = np.maximum(np.concatenate(pooled, 1), 0) @ p["out"] + p["out_b"]
            out.append(np.log(_softmax(z.astype(np.float64)) + 1e-12))
        return np.concatenate(out) if out else np.zeros((0, len(self.labels)))


def train(x: np.ndarray, y: np.ndarray, labels: list[str], seed: int = 1, steps: int = STEPS) -> Model:
    """Adam on the cross-entropy; gradients pass each pooled filter only where its maximum stands."""
    rng, n = np.random.default_rng(seed), len(x)
    p = {"bytes": rng.normal(0, 0.5, (256, DIM)), "out": rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(labels))), "out_b": np.zeros(len(labels))}
    for w in WIDTHS:
        p |= {f"w{w}": rng.normal(0, 0.4, (w, DIM, FILTERS)), f"b{w}": np.zeros(FILTERS)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    while step < steps:
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            if step >= steps:
                break
            pick = order[i:i + BATCH]
            rate = np.float32(RATE * (1 - step / steps))
            xb, yb = x[pick], y[pick]
            g = {k: np.zeros_like(a) for k, a in p.items()}
            pooled, places = [], []
            for w in WIDTHS:
                r = sum(np.take(p["bytes"] @ p[f"w{w}"][j], xb[:, j:j + WINDOW], axis=0) for j in range(w))
                at = r.argmax(1)
                places.append(at)
                pooled.append(np.take_along_axis(r, at[:, None], 1)[:, 0] + p[f"b{w}"])
            h = np.concatenate(pooled, 1)
            a = np.maximum(h, 0)
            d = _softmax(a @ p["out"] + p["out_b"])
            d[np.arange(len(pick)), yb] -= 1
            d /= len(pick)
            g["out"], g["out_b"] = a.T @ d, d.sum(0)
            dh = (d @ p["out"].T) * (h > 0)
            for k, w in enumerate(WIDTHS):
                dw = dh[:, k * FILTERS:(k + 1) * FILTERS]
                g[f"b{w}"] = dw.sum(0)
                for j in range(w):
                    seen = np.take_along_axis(xb, places[k] + j, 1)
                    g[f"w{w}"][j] = np.einsum("bfd,bf->df", p["bytes"][seen], dw)
                    np.add.at(g["bytes"], seen.ravel(), (dw[:, :, None] * p[f"w{w}"][j].T[None]).reshape(-1, DIM))
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(labels, {k: a.astype(np.float32) for k, a in p.items()})


def _judged(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte pairs of lower-cased bytes (along the last axis) and whether each counts."""
    a, b = x[..., :-1], x[..., 1:]
    return a.astype(np.int32) << 8 | b, _JUDGED[a] & _JUDGED[b] & ((a != 32) | (b != 32))


def _pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that count in lower-cased texts, one after the other, and the text of each."""
    if len(data) < 2:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    pair, counts = _judged(data)
    edges = offsets[1:-1]
    counts[edges[(edges > 0) & (edges < len(data))] - 1] = False  # not from one text to the next
    at = np.flatnonzero(counts)
    return pair[at], np.searchsorted(offsets, at, side="right") - 1


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) of a column: their lower-cased bytes and offsets."""
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        yield i, j, LOWER_BYTE[data[offsets[i]:offsets[j]]], offsets[i:j + 1] - offsets[i]


def _logs(counts: np.ndarray) -> np.ndarray:
    """[languages, 65536]: log probability of each byte given the one before, by language, from the counts of pairs."""
    out = np.zeros(counts.shape, np.float32)
    for k, c in enumerate(counts.reshape(-1, 256, 256).astype(np.float64)):
        alone, kinds = (c.sum(0) + 1) / (c.sum() + 256), (c > 0).sum(1, keepdims=True) + 1
        out[k] = np.log((c + kinds * alone) / (c.sum(1, keepdims=True) + kinds)).ravel()
    return out


def _numbered(batch: pa.RecordBatch, number: dict) -> np.ndarray:
    """2 * language + fold of each row."""
    return np.array([2 * number[x] for x in batch.column(2).to_pylist()], np.int64) + (batch.column(0).to_numpy(zero_copy_only=False) & 1)


def _pair_counts(texts: DataFrame, number: dict) -> np.ndarray:
    """[languages, folds, 65536]: the pairs of all texts (columns h, _text, _lang), added up by Spark; only the sums reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = _numbered(b, number)
            for i, j, data, offsets in _slices(b.column(1)):
                pair, row = _pairs(data, offsets)
                keys, n = np.unique(group[i:j][row] << 16 | pair, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    out = np.zeros(len(number) << 17, np.int64)
    for r in texts.mapInArrow(released(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect():
        out[r["key"]] = r["n"]
    return out.reshape(len(number), 2, 1 << 16)


def _floors(texts: DataFrame, number: dict, counts: np.ndarray) -> np.ndarray:
    """Per number of pairs in SIZES, the floor of a known text's mean: all windows of all texts, each fold judged by the
    other's pairs. Means are counted in steps of 1 / ``FINE`` by Spark; every language weighs the same."""
    many = len(number)
    shared = texts.sparkSession.sparkContext.broadcast([_logs(counts[:, 1 - f]) for f in (0, 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, found = _numbered(b, number), []
            for i, j, data, offsets in _slices(b.column(1)):
                x, text, _ = windows(data, offsets)
                for f in (0, 1):
                    of = np.flatnonzero(group[i:j][text] & 1 == f)
                    for a in range(0, len(of), 256):
                        own = of[a:a + 256]
                        pair, judged = _judged(x[own])
                        nth = np.cumsum(judged, 1)
                        sums = [np.cumsum(np.where(judged, logs[pair], 0), 1, dtype=np.float64) for logs in shared.value[f]]
                        for s, size in enumerate(SIZES):
                            row = np.flatnonzero(nth[:, -1] >= size)
                            at = (nth[row] >= size).argmax(1)
                            mean = np.max([z[row, at] for z in sums], 0) / size
                            place = (group[i:j][text[own[row]]] >> 1) * len(SIZES) + s
                            found.append(place << 32 | np.floor(-mean * FINE).astype(np.int64))
            keys, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    rows = texts.mapInArrow(released(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).collect()
    key, n = np.array([r["key"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.float64)
    lang, size, mean = (key >> 32) // len(SIZES), (key >> 32) % len(SIZES), -((key & 0xFFFFFFFF) + 1) / FINE
    floors = np.full(len(SIZES), -np.inf)
    for s in range(len(SIZES)):
        own = np.flatnonzero(size == s)
        if len(own):
            own = own[np.argsort(mean[own], kind="stable")]
            total = np.bincount(lang[own], n[own], many)
            share = np.cumsum(n[own] / total[lang[own]]) / (total > 0).sum()
            floors[s] = mean[own[min(np.searchsorted(share, STRANGE), len(own) - 1)]] - SLACK
        elif s:  # texts longer than any known window: the floor of the longest
            floors[s] = floors[s - 1]
    return floors


def fit(docs: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, seed: int = 1,
        floors: bool = False) -> Model | None:
    """A model of the languages of the ``learnable`` rows; None if there is none. About
    ``sample`` windows reach the driver, as many for each language. With ``floors``, also what ``keep_known`` judges by."""
    known = docs.filter(learnable).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).filter("_lang IS NOT NULL")
    counts = {r[0]: r[1] for r in known.filter(F.length("_text") > 0).groupBy("_lang").count().collect()}
    if not counts:
        return None
    labels = sorted(counts)
    wanted = sample / len(labels)
    many = {x: 2 * max(1, min(WINDOWS_A_TEXT // 2, int(wanted / 2 / counts[x]))) for x in labels}
    share = F.create_map(*[F.lit(v) for x in labels for v in (x, min(1.0, wanted / many[x] / counts[x]))])
    uniform = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.filter((F.length("_text") > 0) & (uniform < share[F.col("_lang")]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(1))
            langs, out = b.column(2).to_pylist(), []
            for k, h in enumerate(b.column(0).to_pylist()):
                text = data[offsets[k]:offsets[k + 1]]
                rng = np.random.default_rng([seed, h & 0xFFFFFFFF])
                for size in (WINDOW, int(rng.integers(24, WINDOW))) * (many[langs[k]] // 2):  # whole windows and short ones
                    at = int(rng.integers(0, max(1, len(text) - size + 1)))
                    w = np.zeros(WINDOW + _REACH, np.uint8)
                    part = text[at:at + size + (_REACH if size == WINDOW else 0)]
                    w[:len(part)] = LOWER_BYTE[part]
                    out.append((h, langs[k], w.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.binary())], names=["h", "lang", "w"])

    rows = sorted(map(tuple, picked.select(F.xxhash64("_id").alias("h"), "_text", "_lang").mapInArrow(released(cut), "h bigint, lang string, w binary").collect()))
    x = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.uint8).reshape(len(rows), -1)
    number = {x: k for k, x in enumerate(labels)}
    y = np.array([number[r[1]] for r in rows])
    model = train(x, y, labels, seed) if rows else None
    if model and floors:
        texts = known.filter(F.length("_text") > 0).select(F.xxhash64("_id").alias("h"), "_text", "_lang")
        pairs = _pair_counts(texts, number)
        model.pairs, model.floors = _logs(pairs.sum(1)), _floors(texts, number, pairs)
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = own.labels if own else []
        tables = own.tables() if own else {}
        for b in batches:
            best, score = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            if own:
                best, score = _predict(own, tables, b.column(1))
            lettered = b.column(2).to_pylist()
            known = [bool(y) and k >= 0 for y, k in zip(lettered, best.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([names[k] if y else UNKNOWN for y, k in zip(known, best.tolist())], pa.string()),
                                              pa.array(np.where(known, score, 0.0))], names=["_id", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))
    return picked.mapInArrow(released(run), f"_id {kind}, lang_pred string, score double").withColumnRenamed("_id", id_col)


def _predict(model: Model, tables: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of the best language (-1: no bytes) and its probability, per row."""
    data, offsets = utf8(column)
    best, score = np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
    for i, j in slices(offsets):
        x, row, weight = windows(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
        if not len(row):
            continue
        logs = model.log_probs(x, tables)
        total = np.zeros((j - i, logs.shape[1]))
        np.add.at(total, row, logs * weight[:, None])
        size = np.bincount(row, weight, j - i)
        some = size > 0
        mean = total[some] / size[some][:, None]
        probs = _softmax(mean)
        best[i:j][some], score[i:j][some] = probs.argmax(1), probs.max(1)
    return best, score


def _like_known(model: Model, column: pa.Array) -> np.ndarray:
    """Whether each text's letter pairs are as probable in some language as a known text's."""
    out = np.ones(len(column), bool)
    for i, j, data, offsets in _slices(column):
        pair, row = _pairs(data, offsets)
        n = np.bincount(row, minlength=j - i)
        some = np.flatnonzero(n)
        mean = np.max([np.bincount(row, logs[pair], j - i)[some] for logs in model.pairs], 0) / n[some]
        out[i + some] = mean >= model.floors[np.searchsorted(SIZES, n[some], side="right") - 1]
    return out


def keep_known(docs: DataFrame, model: Model | None, min_score: float, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows of unknown language (no text, no letter), of a score below ``min_score`` or,
    where the model has floors, unlike every language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value.tables() if shared.value else {}
        for b in batches:
            if shared.value:
                best, score = _predict(shared.value, tables, b.column(at))
                keep = (best >= 0) & (score >= min_score)
                if shared.value.floors is not None:
                    keep &= _like_known(shared.value, b.column(at))
                b = b.filter(pa.array(keep))
            yield b

    return docs.filter(F.col(text_col).rlike(r"\p{L}")).mapInArrow(released(run), docs.schema)
