import numpy as np
from conftest import prose

from stayframe.llm.mixing import mix, mixed_documents, permuted, recipe


def tables():
    rows = [(k, prose(k, 40 + k % 90), "en", f"s{k % 5}" if k % 5 else None) for k in range(400)]
    return rows + [(400, None, "en", "s1"), (401, "", "en", "s1"), (402, " \n", "en", "empty"), (403, "a " * 30_000, "en", "s2"), (404, "tiny words", "en", "z")]


def test_permutation():
    for n in (1, 2, 3, 17, 64, 1000, 4097):
        assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))
    assert permuted(np.arange(1000), 1000, 5).tolist() != permuted(np.arange(1000), 1000, 6).tolist()


def test_targets():
    got = {s.name: s.target for s in recipe([("a", 10), ("b", 1000), (None, 1000), ("c", 100)], (5, 2, 1), 1.5, 2.0, 128)}
    # a and c are full at twice their size; a b c None weigh 5 2 1 5
    # first a passes 20, then (left 3145 of weight 8) c passes 200, then b and None share 2945 by 2 : 5, None passes 2000
    assert got == {"a": 20.0, "c": 200.0, None: 2000.0, "b": 1.5 * 2110 - 2220}


def test_mix_meets_targets_and_bounds(spark, documents):
    docs = documents(tables())
    rows = mix(docs, block_words=16).documents.drop("_mix_row").collect()
    assert len(rows) == 405
    size = {i: len((t or "").split()) for i, t, _, _ in tables()}
    source = {i: s for i, _, _, s in tables()}
    taken, target, total = {}, {}, {}
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        total[s] = total.get(s, 0) + r["size"]
        target[s] = r.target
        assert r.target <= 2 * r.source_size + 1e-9
    assert all(r.source_size == total[source[r.doc_id]] for r in rows)
    assert abs(sum(target.values()) - 1.5 * sum(total.values())) < 1e-6
    for s in taken:
        assert abs(taken[s] - target[s]) <= max(16, 0.02 * target[s]), (s, taken[s], target[s])
    again = mix(docs.repartition(3), block_words=16).documents.drop("_mix_row").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_mixed_texts_hold_the_words_taken(spark, documents):
    docs = documents(tables()).withColumnRenamed("lang", "taken")
    plan = {r.doc_id: r.taken for r in mix(docs, block_words=16).documents.collect()}
    out = mixed_documents(docs, block_words=16)
    assert out.columns == docs.columns
    words, texts = {}, {i: (t or "").split() for i, t, _, _ in tables()}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert set(r.text.split()) <= set(texts[r.doc_id]) and r.n_chars == len(r.text)
    assert words == {i: n for i, n in plan.items() if n}


def test_empty_and_repeated(spark, documents):
    assert mix(documents([])).documents.collect() == []
    rows = mix(documents([(1, "a b c", "x", "s"), (1, "a b c", "x", "s")])).documents.collect()
    assert [(r["size"], r.source_size) for r in rows] == [(3, 6), (3, 6)] and sum(r.taken for r in rows) in range(6, 13)


def brute(docs, hashes, weights, share, most, seed, size):
    """Words taken per row, word by word: targets by raising a level, blocks, draws and permutations from their definition.
    ``docs``: (row, id, words, source); ``hashes`` names the group of (id, words)."""
    names = sorted({d[3] for d in docs}, key=lambda n: (n is None, n or ""))
    total = {n: sum(d[2] for d in docs if d[3] == n) for n in names}
    weight = {n: weights[k % len(weights)] for k, n in enumerate(names)}
    low, high = 0.0, 1e12  # targets min(most * size, level * weight) that add up to the share
    want = min(share, most) * sum(total.values())
    for _ in range(300):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * total[n], level * weight[n]) for n in names) < want else (low, level)
    target = {n: min(most * total[n], low * weight[n]) for n in names}
    words = {}  # source -> row of each of its words, in order
    for n in names:
        own = [d for d in docs if d[3] == n and d[2]]
        groups = -(-sum(d[3] == n for d in docs) // 10_000)
        own.sort(key=lambda d: (hashes[d[1], d[2]] % groups, d[1], d[2]))
        words[n] = [d[0] for d in own for _ in range(d[2])]
    blocks = [-(-total[n] // size) for n in names]
    slots = [min(int(most * b), round(target[n] * b / total[n])) if total[n] else 0 for n, b in zip(names, blocks)]
    drawn, order = [0] * len(names), []
    shards = -(-sum(slots) // 4096)
    for shard in range(shards):
        n = np.random.default_rng([seed, shard]).multinomial(min(4096, sum(slots) - shard * 4096), np.array(slots) / max(sum(slots), 1))
        for k, c in enumerate(n.tolist()):
            order += [(k, drawn[k] + j) for j in range(c)]
            drawn[k] += c
    lacking = [(k, j) for k in range(len(names)) for j in range(drawn[k], slots[k])]
    over = sorted((k, j) for k, j in order if j >= slots[k])
    swap = dict(zip(over, lacking))
    taken = {d[0]: 0 for d in docs}
    for k, j in order:
        k, j = swap.get((k, j), (k, j))
        epoch, at = divmod(j, blocks[k])
        block = int(permuted(np.array([at]), blocks[k], seed << 40 ^ k << 20 ^ epoch)[0])
        for row in words[names[k]][block * size:(block + 1) * size]:
            taken[row] += 1
    return taken, target


def test_equals_brute_force(spark, documents):
    from pyspark.sql import functions as F

    docs = documents(tables())
    rows = [(r.doc_id, r.doc_id, len((r.text or "").split()), r.source) for r in docs.collect()]
    keyed = spark.createDataFrame([(i, n) for _, i, n, _ in rows], "i bigint, n bigint")
    hashes = {(r.i, r.n): r.h for r in keyed.select("i", "n", F.xxhash64("i", "n").alias("h")).collect()}
    want, target = brute(rows, hashes, (5.0, 2.0, 1.0), 1.5, 2.0, 1, 16)
    got = mix(docs, block_words=16).documents.collect()
    assert {r.doc_id: r.taken for r in got} == want
    for r in got:
        name = next(x[3] for x in rows if x[0] == r.doc_id)
        assert abs(r.target - target[name]) < 1e-3


def test_other_columns(spark, documents):
    docs = documents(tables()).drop("n_chars").withColumnsRenamed({"lang": "shard", "source": "source"})
    out = mixed_documents(docs, block_words=16)
    assert out.columns == ["doc_id", "text", "shard", "source"] and out.count() > 300
