import zlib

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as E
from stayframe.llm import language_id as li
from stayframe.llm.queries import held_out

SF = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = E.queries()["op3_language_id"](spark, SF).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    tested = [r for r in got if r.held_out and lang[r.doc_id] is not None]
    assert sum(r.lang_pred == lang[r.doc_id] for r in tested) >= 0.9 * len(tested)
    assert all(0 <= r.score <= 1 for r in got)


def test_predictions_do_not_use_labels(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = li.fit(docs, ~held_out())
    some = docs.limit(50)
    plain = sorted(map(tuple, li.predict(some, model).collect()))
    assert plain == sorted(map(tuple, li.predict(some.selectExpr("doc_id", "text", "'xx' AS lang", "1 AS score"), model).collect()))


def test_edge_cases(spark, documents):
    rows = [(1, None, "en", None), (2, "", "en", None), (3, "12 !? 3", "en", None), (4, "the cat and the dog " * 3000, "en", None), (5, "é", None, None),
            (6, "der hund und die katze", "de", None), (6, "der hund und die katze", "de", None), (None, "the dog", "en", None)]
    docs = documents(rows)
    model = li.fit(docs, F.col("doc_id").isNotNull())
    got = [(r.doc_id, r.lang_pred, r.score) for r in li.predict(docs, model).collect()]
    assert {g[1:] for g in got if g[0] in (1, 2, 3)} == {("und", 0.0)}
    assert {g[1] for g in got if g[0] in (4, 5, 6, None)} <= {"en", "de"}
    assert li.fit(documents([]), F.col("doc_id").isNotNull()) is None
    assert [r.lang_pred for r in li.predict(documents([(1, "text")]), None).collect()] == ["und"]
    assert {r.doc_id for r in li.keep_known(docs, model, 0.0).collect()} == {4, 5, 6, None}


def test_windows_cover_every_byte():
    data = np.arange(1, 601, dtype=np.int64).astype(np.uint8)
    x, row, size = li.windows(data, np.array([0, 0, 300, 301, 600]))
    assert row.tolist() == [1, 1, 2, 3, 3] and size.tolist() == [256, 44, 1, 256, 43]
    assert (x[0][:256] == li.LOWER_BYTE[data[:256]]).all() and (x[1][:44] == li.LOWER_BYTE[data[256:300]]).all() and (x[1][44:] == 0).all()


def test_model_tables_equal_the_plain_network():
    r = np.random.default_rng(2)
    x = r.integers(0, 256, (20, li.WINDOW + 3)).astype(np.uint8)
    model = li.train(x, r.integers(0, 3, 20), ["a", "b", "c"], steps=3)
    p, pooled = model.params, []
    for w in li.WIDTHS:
        seen = p["bytes"][x]
        resp = sum(seen[:, j:j + li.WINDOW] @ p[f"w{w}"][j] for j in range(w))
        pooled.append(resp.max(1) + p[f"b{w}"])
    z = np.maximum(np.concatenate(pooled, 1), 0) @ p["out"] + p["out_b"]
    want = z - z.max(1, keepdims=True)
    want = want - np.log(np.exp(want).sum(1, keepdims=True))
    assert np.allclose(model.log_probs(x, model.tables()), want, atol=1e-4)


def test_pairs_and_floors_come_from_all_texts(spark, documents):
    rows = [(k, text, lang, None) for k in range(120) for lang, text in (("en", f"the cat {k} and dog " * (1 + k % 30)), ("de", f"der hund und katze {k} " * (1 + k % 9)))]
    docs = documents([(i, t, lang, s) for i, (_, t, lang, s) in enumerate(rows)] + [(900, "zebra zq", "en", None)]).repartition(5)
    few, more = (li.fit(docs, F.col("doc_id").isNotNull(), sample=n, floors=True) for n in (20, 2000))
    assert (few.pairs == more.pairs).all() and (few.floors == more.floors).all() and (np.diff(few.floors[:4]) > -20).all()
    counts = np.zeros((2, 1 << 16), np.int64)
    for r in docs.collect():
        raw = r.text.encode()
        for a, b in zip(raw, raw[1:]):
            if li._JUDGED[a] and li._JUDGED[b] and (a, b) != (32, 32):
                counts[("de", "en").index(r.lang), a << 8 | b] += 1
    assert (few.pairs == li._logs(counts)).all() and counts[1, ord("z") << 8 | ord("q")] == 1
    assert {r.doc_id for r in li.keep_known(docs, more, 0.0).collect()} >= set(range(240))
