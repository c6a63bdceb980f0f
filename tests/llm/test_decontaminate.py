import hashlib
import re

from conftest import prose

from stayframe.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, s in items:
            v = words(s)
            n = min(window, len(v))
            for p in range(len(v) - n + 1 if n else 0):
                for q in range(len(w) - n + 1):
                    if w[q:q + n] == v[p:p + n]:
                        hit |= set(range(q, q + n))
                        found.add(str(i))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def cases():
    items = [(1, prose(1, 25)), (2, prose(2, 6)), (10, prose(1, 25)), (3, "one"), (4, "!!!"), (5, None), (6, "the " * 15), (7, "É é ñandú x" + prose(9, 8))]
    p = words(items[0][1])
    docs = [(1, prose(3, 300)), (2, prose(4, 40) + " " + " ".join(p[3:18]).upper() + "; " + prose(5, 30)), (3, " ".join(p[:9])), (4, items[1][1]),
            (5, "only ONE, here"), (6, None), (7, ""), (8, "the " * 200), (9, items[7][1] + "!" + items[7][1]), (10, "\n".join(p)), (11, "@[one]`{one}")]
    return docs, items


def test_equals_brute_force(spark, documents):
    docs, items = cases()
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, spans string")
    got = dc.digest(dc.contamination(documents(docs), table)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute(docs, items)
    clean = {r.doc_id for r in dc.keep_clean(documents(docs), table).collect()}
    assert clean == {d for d, r in brute(docs, items).items() if not r[4]}


def test_many_blocks_give_the_same(spark, documents, monkeypatch):
    docs, items = cases()
    table = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(dc, "BLOCK_BYTES", 600)
    monkeypatch.setattr(dc, "BLOCKS_A_STAGE", 3)
    assert {r.doc_id: tuple(r)[1:] for r in dc.digest(dc.contamination(documents(docs), table)).collect()} == brute(docs, items)


def test_empty_tables_and_repeated_rows(spark, documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = dc.digest(dc.contamination(documents([(1, "A b-c"), (2, None)]), none)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got) == [(1, 3, 0, False), (2, 0, 0, False)]
    items = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a b")], "item_id bigint, text string")
    assert dc.digest(dc.contamination(documents([]), items)).collect() == []
    got = dc.digest(dc.contamination(documents([(1, "x a b"), (1, "x a b")]), items)).collect()
    assert [(r.n_hit, r.n_items) for r in got] == [(2, 2), (2, 2)]
