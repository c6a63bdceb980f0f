import random
import zlib

import numpy as np
from conftest import prose
from tokenizers import Tokenizer

import corpus_pipeline as P
from stayframe.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, documents, folder):
    item = prose(1000, 14)
    rows = [(k, prose(k, 50 + k % 30), "en", f"s{k % 3}") for k in range(90)]
    rows += [(k, prose(k, 50, "qwrtzpsdfg"), "de", "s0") for k in range(90, 150)]
    rows += [(200 + k, prose(k, 50 + k % 30), "en", "s1") for k in range(10)]  # copies
    rows += [(300, prose(301, 30) + " " + item + " " + prose(302, 30), "en", "s2"), (301, None, "en", "s2"), (302, "12 34", "en", "s2"), (303, "", "de", None)]
    documents(rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_stages_take_effect(spark, documents, tmp_path):
    rows = corpus(spark, documents, tmp_path)
    docs, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids.append({r.doc_id for r in docs.collect()})
        if name != "token_store":
            assert docs.columns == COLUMNS
    every = {r[0] for r in rows}
    assert ids[0] == every - {301, 302, 303}
    assert ids[1] == ids[0] - set(range(200, 210))
    assert ids[2] == ids[1] - {300}
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = sorted((r.doc_id, *(lambda x: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())))(library.encode(r.text, add_special_tokens=False).ids + [2]))
                  for r in spark.read.parquet(f"{tmp_path}/mixing").collect())
    got = docs.orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist() and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    words = {r[0]: len((r[1] or "").split()) for r in rows}
    mixed = spark.read.parquet(f"{tmp_path}/mixing").collect()
    total = sum(len(r.text.split()) for r in mixed)
    assert abs(total - 1.5 * sum(words[i] for i in ids[2])) < 0.03 * total


def test_letter_gibberish_is_rejected_and_short_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    wild = [" ".join("".join(r.choice(letters) for _ in range(r.randint(3, 9))) for _ in range(n)) for n in (4, 8, 20, 60, 200, 2000) for _ in range(20)]
    clean = [t.text for t in docs.filter("length(text) > 300").orderBy("doc_id").limit(40).collect()]
    mixed = ["".join(r.sample(t, len(t))) for t in clean]  # a language's letters in no order
    short = [" ".join(t.split()[5:5 + n]) for t in clean for n in (1, 2, 3, 6)]
    short = [t for t in short if any(c.isalpha() for c in t)]  # "|" and numbers are rejected as ever
    first = 10 ** 9
    added = [(first + k, t, None, "s0", len(t)) for k, t in enumerate(wild + mixed + short)]
    kept = {x.doc_id for x in P.language(spark, docs.unionByName(spark.createDataFrame(added, docs.schema)), "").select("doc_id").collect()}
    lettered = {x.doc_id for x in docs.filter(r"text rlike '\\p{L}'").collect()}
    assert len(docs.select("lang").distinct().collect()) == 4 and len(lettered - kept) <= 0.002 * len(lettered)
    gone = [k for k in range(len(added)) if first + k not in kept]
    n = len(wild) + len(mixed)
    assert sum(k < len(wild) for k in gone) >= 0.97 * len(wild) and sum(len(wild) <= k < n for k in gone) >= 0.9 * len(mixed)
    assert sum(k >= n for k in gone) <= 0.01 * len(short)


def test_run_equals_its_stages_and_takes_empty_tables(spark, documents, tmp_path):
    corpus(spark, documents, tmp_path)
    assert P.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    empty = tmp_path / "empty"
    documents([]).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert P.run(spark, str(empty)).collect() == []
