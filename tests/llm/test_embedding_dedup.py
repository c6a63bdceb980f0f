import numpy as np

from stayframe.llm import embedding_dedup as ed
from stayframe.llm.components import components

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, least):
    ids = [r[0] for r in rows]
    good = {}
    for k, (_, v, label) in enumerate(rows):
        if v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            good[k] = (label, len(v), x / np.linalg.norm(x))
    links = {k: set() for k in range(len(rows))}
    keys = list(good)
    for a in keys:
        for b in keys:
            if a < b and good[a][:2] == good[b][:2] and good[a][2] @ good[b][2] >= least:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[k] = (ids[k], len(links[k]), min(ids[x] for x in seen))
    return [out[k] for k in range(len(rows))]


def cloud(n=900, dim=32, seed=3):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 3, dim))
    rows = []
    for k in range(n):
        v = base[k % len(base)] + r.normal(size=dim) * r.choice([0.02, 0.2, 0.35])
        rows.append((k, [float(x) for x in v.astype(np.float32)], int(r.integers(0, 2))))
    return rows


def odd():
    one = [1.0, 2.0, 3.0]
    return [(1, one, 1), (2, one, 1), (3, [2.0, 4.0, 6.0], 1), (4, one, 2), (5, one, None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [1.0, None, 2.0], 1),
            (10, [float("nan"), 1.0, 1.0], 1), (11, [float("inf"), 1.0, 1.0], 1), (12, [1.0, 2.0], 1), (13, [3e38, 3e38, 3e38], 1), (14, [1e-40, 1e-40, 1e-40], 1), (15, one, 1), (15, one, 1)]


def test_edge_cases_equal_brute_force(spark):
    table = spark.createDataFrame(odd(), VECTORS).selectExpr("*", "1 AS rep", "2 AS dim")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(table).collect())
    assert got == sorted((i, n, c, i == c) for i, n, c in brute(odd(), 0.93))
    assert ed.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []


def test_recall_and_no_wrong_link(spark, monkeypatch):
    monkeypatch.setattr(ed, "LEAF", 60)
    rows = cloud()
    want = {i: (n, c) for i, n, c in brute(rows, 0.93)}
    got = {r.vec_id: r for r in ed.near_duplicates(spark.createDataFrame(rows, VECTORS), trees=4).collect()}
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert all(want[r.component_id][1] == want[i][1] for i, r in got.items())


def test_one_dense_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ed, "LEAF", 50)
    monkeypatch.setattr(ed, "BLOCK", 40)
    r = np.random.default_rng(1)
    rows = [(k, [float(x) for x in (np.ones(16) + r.normal(size=16) * 0.01).astype(np.float32)], 7) for k in range(300)]
    got = ed.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()
    assert {x.component_id for x in got} == {0} and [x.vec_id for x in got if x.kept] == [0]
    assert all(x.n_links <= 299 for x in got) and sum(x.n_links for x in got) >= 0.97 * 300 * 299


def test_links_in_overlaps_count_once(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(2000, 64))  # more than LEAF: several splits, each with an overlap
    x = np.concatenate([base, base + r.normal(size=base.shape) * 0.2])
    rows = [(k, [float(c) for c in v.astype(np.float32)], 1) for k, v in enumerate(x)]
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in ed.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert want.sum() > 3900 and all(got[k] <= n for k, n in enumerate(want)) and sum(got.values()) >= 0.99 * want.sum()


def test_dense_group_of_thousands_loses_no_link(spark):
    r = np.random.default_rng(6)
    center = r.normal(size=64)
    dense = center / np.linalg.norm(center) + r.normal(size=(2500, 64)) * 0.03  # near copies of one vector, but no two equal
    x = np.concatenate([dense, r.normal(size=(2000, 64))])
    rows = [(k, [float(c) for c in v.astype(np.float32)], 1) for k, v in enumerate(x)]
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(1) - 1
    got = {r.vec_id: r.n_links for r in ed.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert want.sum() > 2500 * 2000 and all(got[k] <= n for k, n in enumerate(want)) and sum(got.values()) >= 0.999 * want.sum()


def test_trees_part_no_dense_group_and_count_once_at_depth(spark, monkeypatch):
    monkeypatch.setattr(ed, "LEAF", 60)
    rows = cloud(1500)
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    tree = ed.grow(unit, len(unit), np.random.default_rng(1), 0.93)
    assert len(tree.directions) >= 3 and len(set(tree.leaves(unit)[1].tolist())) >= 8  # LEAF is read when called
    want = {i: n for i, n, _ in brute(rows, 0.93)}
    got = {r.vec_id: r.n_links for r in ed.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.99 * sum(want.values())


def pairs_at(cosine, n, dim, seed):
    """n scattered vectors and a partner of each at just this cosine."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = r.normal(size=base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return np.concatenate([base, cosine * base + np.sqrt(1 - cosine * cosine) * other])


def test_recall_of_planted_pairs_at_the_bound(spark):
    """Production parameters, one label, links that could hardly be weaker."""
    x = pairs_at(0.931, 4000, 64, 5)
    rows = [(k, [float(c) for c in v.astype(np.float32)], 1) for k, v in enumerate(x)]
    got = {r.vec_id: r for r in ed.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert all(r.n_links <= 1 for r in got.values())
    assert sum(got[k].component_id == k - 4000 for k in range(4000, 8000)) >= 0.985 * 4000


def test_expected_recall_and_copies():
    """Trees keep what they promise, and a vector's copies grow by far less than the table."""
    copies = []
    for n in (2500, 20_000):
        x = pairs_at(0.931, n, 64, n)
        trees = ed._trees(x, len(x), 0.93, ed.RECALL, 1, [1, 64])
        found, rows, shares = np.zeros(n, bool), 0, []
        for t in trees:
            row, leaf = t.leaves(x)
            rows += len(row)
            seen, many = np.unique((row % n) * 100_000 + leaf, return_counts=True)
            own = np.zeros(n, bool)
            own[seen[many == 2] // 100_000] = True
            shares.append(own.mean())
            found |= own
        assert abs(np.mean(shares) - np.mean([t.recall for t in trees])) < 0.05
        assert found.mean() > 0.99
        copies.append(rows / len(x))
    assert copies[0] < 5 and copies[1] < 2.5 * copies[0]  # of 8 times the vectors


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(5, 5), (7, 3), (3, 7), (3, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()))
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 500 for k in range(500, 700)}, 3: 3, 7: 3}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").collect() == []
