import math
import random
import re

import numpy as np
from conftest import prose

import __spark_entry__ as E
from stayframe.llm import minhash_dedup as md

WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def edited(text, seed, every):
    r = random.Random(seed)
    return " ".join(w if r.randrange(every) else "changed" + str(r.randrange(10 ** 6)) for w in text.split())


def shingle_counts(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    out = {}
    for k in range(max(len(w) - 4, 1) if w else 0):
        s = tuple(w[k:k + 5])
        out[s] = out.get(s, 0) + 1
    return out


def brute(docs, least=0.8):
    """Groups by the exact weighted Jaccard similarity of all pairs."""
    sets = {i: shingle_counts(t) for i, t in docs}
    n, df = len(docs), {}
    for s in sets.values():
        for k in s:
            df[k] = df.get(k, 0) + 1
    idf = {k: min(1.0, max(md.LEAST_IDF, math.log(n / v) / math.log(1 / md.RARE))) for k, v in df.items()}
    weight = {i: {k: (1 + math.log(c)) * idf[k] for k, c in s.items()} for i, s in sets.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and weight[a] and weight[b]:
                both = sum(min(weight[a][k], weight[b][k]) for k in weight[a].keys() & weight[b].keys())
                if both / (sum(weight[a].values()) + sum(weight[b].values()) - both) >= least:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: find(i) for i in ids}


def corpus():
    docs = [(k, prose(k, 60 + k % 40)) for k in range(60)]
    docs += [(100 + k, prose(k % 10, 60 + k % 10)) for k in range(40)]  # exact copies
    docs += [(200 + k, edited(prose(k, 60 + k % 40), k, 60)) for k in range(25)]
    docs += [(300 + k, edited(prose(77, 400), k, 90)) for k in range(30)]  # near copies of one text and of each other
    docs += [(400, None), (401, ""), (402, "!! ??"), (403, "!! ??"), (404, "two words"), (405, "Two, WORDS!"), (406, "one"), (407, "x " * 5000), (408, "x " * 5003), (409, "Ünï çode ñ"), (410, "Ünï; çode ñ")]
    return docs


def test_groups_equal_brute_force(spark, documents):
    docs = corpus()
    want = brute(docs)
    got = {r.doc_id: r for r in md.near_duplicates(documents(docs).withColumnRenamed("lang", "rep").withColumnRenamed("source", "class_id")).collect()}
    assert set(got) == set(want)
    wrong = [i for i in want if got[i].class_id != want[i]]
    assert not wrong, [(i, got[i].class_id, want[i]) for i in wrong]
    assert all(r.kept == (r.class_id == i) for i, r in got.items())
    assert {r.doc_id for r in md.keep_first(documents(docs)).collect()} == {i for i in want if want[i] == i}


def test_large_buckets_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(md, "SMALL", 2)
    monkeypatch.setattr(md, "BLOCK", 7)
    monkeypatch.setattr(md, "COLUMNS", 64)
    monkeypatch.setattr(md, "RARE", 0.999)
    docs = [(k, edited(prose(5, 150), k, 12 + k * 3)) for k in range(70)] + [(100 + k, prose(900 + k, 30)) for k in range(5)]
    want = brute(docs)
    got = {r.doc_id: r.class_id for r in md.near_duplicates(documents(docs)).collect()}
    linked = [i for i in want if want[i] != i or list(want.values()).count(i) > 1]
    assert 10 < len(linked) < 70
    # groups are never wrong; a link may be missed only where sampling gave no common key
    assert all(want[got[i]] == want[i] for i in want) and sum(got[i] == want[i] for i in want) >= len(want) - 2


def test_sampling_estimates_the_weighted_similarity():
    r = np.random.default_rng(5)
    h = r.integers(0, 1 << 63, 400).astype(np.uint64)
    wa, wb = r.uniform(0.1, 3, 300), r.uniform(0.1, 3, 300)
    ha, hb = np.sort(h[:300]), np.sort(h[100:])
    row = np.repeat([0, 1], 300)
    s = md.samples(row, np.concatenate([ha, hb]), np.concatenate([wa, wb]), 2, 1500)
    a, b = dict(zip(ha.tolist(), wa)), dict(zip(hb.tolist(), wb))
    both = sum(min(a[k], b[k]) for k in a.keys() & b.keys())
    want = both / (sum(a.values()) + sum(b.values()) - both)
    assert abs((s[:, 0] == s[:, 1]).mean() - want) < 0.04


def test_empty_and_repeated(spark, documents):
    assert md.near_duplicates(documents([])).collect() == []
    rows = md.near_duplicates(documents([(5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f"), (9, "z")])).collect()
    assert sorted(map(tuple, rows)) == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 9, True)]


def test_clashing_columns_and_null_ids_of_keep_first(spark, documents):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (None, "z y x w v"), (9, None)]
    docs = documents(rows).withColumnsRenamed({"lang": "_kept", "source": "kept", "n_chars": "class_id"})
    out = md.keep_first(docs)
    assert out.columns == docs.columns and sorted((r.doc_id for r in out.collect()), key=str) == [3, 9, None]


def test_every_claimed_oracle_is_sql():
    assert "op9_minhash_dedup" in E.queries() and "op9_minhash_dedup" not in E.oracle_sql()
    assert all(isinstance(sql, str) for sql in E.oracle_sql().values())
