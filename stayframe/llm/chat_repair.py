"""Chat formatting with minimum-cost role repair.

Legal conversations are an optional system message, then user and assistant in turn, ending
with the assistant. Every turn keeps its role or is relabelled; it begins a new message or is
merged into the one before; empty messages may be inserted where the order needs them. A
dynamic programme over the automaton of legal turns finds the cheapest repair (on equal costs
the earlier one in the order keep, merge, insert and system, user, assistant).

A turn is a matrix of costs from the role before to the role after it, and turns combine by the
(min, +) product, which is associative. So turns are put in order by a range partitioning that may
cut a conversation anywhere, and go into chunks of at most ``CHUNK`` turns; a conversation
inside one chunk is solved there, for the others only the chunks' 4 x 4 matrices meet, and each
chunk is then solved by itself between its best outer roles. So a conversation with a third of all
turns is no single task's work, and no text is moved more than once.

The result has one row per turn and per inserted message: ``pos`` orders the rows of a
conversation, ``action`` and ``cost`` tell what was done, and the ``fragment`` columns of a conversation,
strung together by ``pos``, are the rendered chat. Unknown and null roles can only be relabelled; null
texts are empty; turns with equal numbers (null first) are ordered by hash of role and text;
equal rows are interchangeable. A null conversation id is a conversation. The markers' strings inside
texts are broken by a blank. Empty input: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import staged

ROLES = ["system", "user", "assistant"]
START, SYSTEM, USER, ASSISTANT = range(4)
#: Messages that have to be inserted between a message of one role (or the start) and one of another.
INSERTED = {
    (START, SYSTEM): [], (START, USER): [], (START, ASSISTANT): [USER],
    (SYSTEM, USER): [], (SYSTEM, ASSISTANT): [USER],
    (USER, ASSISTANT): [], (USER, USER): [ASSISTANT],
    (ASSISTANT, USER): [], (ASSISTANT, ASSISTANT): [USER],
}
CLOSING = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}
MERGE, RELABEL, INSERT, FOREIGN = 1.0, 3.0, 4.0, 0.5
CHUNK, CHUNK_BYTES = 1000, 1 << 20
OPEN, CLOSE, GLUE = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"


def relabel_cost(role: str | None, to: int) -> float:
    if role not in ROLES:
        return FOREIGN
    return 0.0 if ROLES[to - 1] == role else RELABEL


def options(role: str | None, before: int, to: int) -> list[tuple[float, bool]]:
    """(cost, merged) of the ways a turn may bring the role before to ``to``, the preferred first."""
    out = []
    base = relabel_cost(role, to)
    if (before, to) in INSERTED:
        out.append((base + INSERT * len(INSERTED[before, to]), False))
    if before == to:
        out.append((base + MERGE, True))
    return sorted(out, key=lambda x: (x[0], len(INSERTED.get((before, to), [])) if not x[1] else 0))


def turn_matrix(role: str | None) -> np.ndarray:
    out = np.full((4, 4), np.inf)
    for s in range(4):
        for t in (SYSTEM, USER, ASSISTANT):
            if ways := options(role, s, t):
                out[s, t] = ways[0][0]
    return out


_KNOWN = {r: turn_matrix(r) for r in [*ROLES, None]}
END_COST = np.array([INSERT * len(CLOSING[s]) for s in range(4)])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None]).min(1)


def chunk_matrix(roles: list[str | None]) -> np.ndarray:
    out = np.where(np.eye(4, dtype=bool), 0.0, np.inf)
    for r in roles:
        out = product(out, _KNOWN.get(r, _KNOWN[None]))
    return out


def best_cost(roles: list[str | None]) -> float:
    """Cost of the cheapest repair of one conversation."""
    return float((chunk_matrix(roles)[START] + END_COST).min())


def best_path(matrices: list[np.ndarray], entry: int, final: np.ndarray) -> list[int]:
    """Roles before, between and behind the matrices on the cheapest path from ``entry``; ``final`` are the costs at the end."""
    to_go = [final]
    for m in reversed(matrices):
        to_go.append((m + to_go[-1][None]).min(1))
    to_go.reverse()
    path = [entry]
    for m, rest in zip(matrices, to_go[1:]):
        path.append(int(np.argmin(m[path[-1]] + rest)))
    return path


def repaired(turns: list, roles: list[str | None], texts: list[str | None], entry: int, leave: int, base: int, last: bool) -> list[tuple]:
    """Rows (pos, turn, role, out_role, action, cost, fragment) of one chunk, from the role before it
    to the role behind it; ``base`` turns come before it, ``last`` closes the conversation."""
    final = np.where(np.arange(4) == leave, 0.0, np.inf)
    path = best_path([_KNOWN.get(r, _KNOWN[None]) for r in roles], entry, final)
    out = []

    def message(pos: int, before: int, to: int, text: str) -> str:
        return (CLOSE if before != START else "") + OPEN.format(ROLES[to - 1]) + text

    for k, (turn, role, text) in enumerate(zip(turns, roles, texts)):
        before, to = path[k], path[k + 1]
        cost, merged = options(role, before, to)[0]
        plain = (text or "").replace("<|im_", "<| im_")
        named = role if role in ROLES else None
        action = [*(["relabel"] if named != ROLES[to - 1] else []), *(["merge"] if merged else [])]
        pos = 4 * (base + k)
        if not merged:
            for n, x in enumerate(INSERTED[before, to]):
                out.append((pos + n, None, None, ROLES[x - 1], "insert", INSERT, message(pos, before, x, "")))
                before = x
                cost -= INSERT
        out.append((pos + 3, turn, role, ROLES[to - 1], "+".join(action) or "keep", cost, GLUE + plain if merged else message(pos, before, to, plain)))
    if last:
        pos, before = 4 * (base + len(roles)), path[-1]
        for n, x in enumerate(CLOSING[before]):
            out.append((pos + n, None, None, ROLES[x - 1], "insert", INSERT, message(pos, before, x, "")))
            before = x
        out[-1] = (*out[-1][:-1], out[-1][-1] + CLOSE)
    return out


_OUT = "pos bigint, turn {turn}, role string, out_role string, action string, cost double, fragment string"


def _rows(ids: list, many: list[list[tuple]], schema: pa.Schema) -> pa.RecordBatch:
    flat = [(i, *r) for i, rows in zip(ids, many) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], f.type) for k, f in enumerate(schema)], schema=schema)


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per turn and inserted message: id, pos, turn, role, out_role, action, cost, fragment."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = conversations.sparkSession
    kinds = dict(conversations.dtypes)
    picked = conversations.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    tie = F.xxhash64("role", "text")
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), tie]
    chunk_schema = f"id {kinds[id_col]}, part int, seq int, open boolean, turns array<{kinds[turn_col]}>, roles array<string>, texts array<string>, matrix array<double>"
    chunk_type = to_arrow_schema(spark.createDataFrame([], chunk_schema).schema)

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, first, held, size, own = TaskContext.get().partitionId(), 0, True, [], 0, None
        ready: list[tuple] = []

        def close(open_: bool) -> None:
            nonlocal held, size, seq
            roles = [h[1] for h in held]
            ready.append((own, part, seq, open_, [h[0] for h in held], roles, [h[2] for h in held], chunk_matrix(roles).ravel().tolist()))
            held, size, seq = [], 0, seq + 1

        def flush() -> pa.RecordBatch:
            nonlocal ready
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in ready], f.type) for k, f in enumerate(chunk_type)], schema=chunk_type)
            ready = []
            return out

        begun = False
        for b in batches:
            for i, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
                if begun and i != own:
                    close(first or split)
                    first, split = False, False
                elif held and (len(held) >= CHUNK or size >= CHUNK_BYTES):
                    close(True)
                    split = True
                if not begun:
                    begun, split = True, False
                own = i
                held.append((turn, role, text))
                size += len(text or "")
                if len(ready) >= 200:
                    yield flush()
        if begun:
            close(True)  # the partition's last conversation may go on in the next one
        if ready:
            yield flush()

    chunks = picked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunked, chunk_schema)
    chunks = staged(chunks, "chat-chunks")
    schema = f"id {kinds[id_col]}, {_OUT.format(turn=kinds[turn_col])}"
    out_type = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            many = []
            for r in rows:
                m = np.array(r["matrix"]).reshape(4, 4)
                many.append(repaired(r["turns"], r["roles"], r["texts"], START, int(np.argmin(m[START] + END_COST)), 0, True))
            yield _rows([r["id"] for r in rows], many, out_type)

    closed = chunks.filter("NOT open").select("id", "turns", "roles", "texts", "matrix").mapInArrow(whole, schema)

    def bounds(df):
        df = df.sort_values(["part", "seq"])
        path = best_path([np.array(m).reshape(4, 4) for m in df["matrix"]], START, END_COST)
        df["entry"], df["leave"] = path[:-1], path[1:]
        df["base"] = df["n"].cumsum() - df["n"]
        df["last"] = [False] * (len(df) - 1) + [True]
        return df[["part", "seq", "entry", "leave", "base", "last"]]

    # one row of 16 numbers per chunk of the conversations that may be cut
    outer = chunks.filter("open").select("id", "part", "seq", F.size("turns").alias("n"), "matrix").groupBy("id").applyInPandas(
        bounds, "part int, seq int, entry int, leave int, base bigint, last boolean")

    def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            yield _rows([r["id"] for r in rows], [repaired(r["turns"], r["roles"], r["texts"], r["entry"], r["leave"], r["base"], r["last"]) for r in rows], out_type)

    cut = chunks.filter("open").join(outer, ["part", "seq"]).select("id", "turns", "roles", "texts", "entry", "leave", "base", "last").mapInArrow(between, schema)
    return closed.unionByName(cut).withColumnRenamed("id", id_col)


def rendered(repaired_rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation (id, text, cost): its fragments strung together. A conversation has to fit one row."""
    return repaired_rows.groupBy(id_col).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fragment"))), lambda s: s["fragment"]), "").alias("text"), F.sum("cost").alias("cost"))
