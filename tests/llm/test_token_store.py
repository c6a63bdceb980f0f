import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from stayframe.llm._stage import new_path
from stayframe.llm.queries import tokenizer_path
from stayframe.llm.token_store import expand, re_pair, read_ids, read_store, rule_lengths, write_store

PATH = tokenizer_path("word_bpe_49k.json")
ALPHABET = list("abcdehtTrmlv'''   \n\t!?.,#019éñÉ　ß٣½中😀-_İǅΣ") + ["'s", "'RE", " the", "é", "<|endoftext|>", "tion"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_grammar_round_trip():
    r = np.random.default_rng(1)
    for ids in (r.integers(0, 5, 20_000), np.zeros(5000, int), r.integers(0, 40_000, 3000), np.array([], int), np.array([9])):
        ids = np.where(r.random(len(ids)) < 0.02, 50, ids).astype(np.uint32)
        symbols, rules, first = re_pair(ids, 50, min_count=4, rounds=50)
        back = expand(symbols, rules, first, int(first) - 1)
        assert (back == ids).all()
        lengths = rule_lengths(rules, first)
        assert lengths.tolist() == [len(expand(np.array([first + k]), rules, first, 0)) for k in range(len(rules))]
        assert not (rules == 50).any()
    assert len(re_pair(np.tile([1, 2, 3], 4000).astype(np.uint32), 9)[0]) < 1000


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_store_equals_the_library(spark, documents, library, block):
    r = random.Random(5)
    rows = [(k * 3, "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 50)))) for k in range(300)] + [(901, None), (902, ""), (903, "# # #"), (904, "a " * 20_000)]
    path = new_path(spark, "test-store")
    write_store(documents(rows).repartition(5), path, PATH, 2, block_ids=block)
    at, want = 0, []
    for i, t in sorted(rows):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, read_store(spark, path).collect())) == want
    some = {x.doc_id: x.ids for x in read_ids(spark, path, [901, 903, 30]).collect()}
    assert some == {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in rows if i in (901, 903, 30)}


def test_grammar_until_no_pair_is_frequent():
    """A passage of 3,000 ids, forty times: some rounds more than doubling it takes, and nothing frequent is left."""
    r = np.random.default_rng(3)
    passage = r.integers(0, 50_000, 3000)
    ids = np.concatenate([np.concatenate([passage, r.integers(0, 50_000, 20), [60_000]]) for _ in range(40)]).astype(np.uint32)
    symbols, rules, first = re_pair(ids, 60_000)
    assert (expand(symbols, rules, first, 60_000) == np.where(ids == first - 1, 60_000, ids)).all()
    assert rule_lengths(rules, first).max() > 64  # deeper than six rounds of pairs reach
    inner = (symbols[:-1] != 60_000) & (symbols[1:] != 60_000)
    pairs, counts = np.unique(np.stack([symbols[:-1], symbols[1:]], 1)[inner], axis=0, return_counts=True)
    # what counts as an occurrence does not overlap another one of the same pair
    assert counts[pairs[:, 0] != pairs[:, 1]].max(initial=0) < 24
    assert len(symbols) < len(ids) / 15


def test_word_of_more_than_a_million_ids(spark, documents, library):
    r = random.Random(11)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(2_000_000))
    rows = [(1, "before"), (2, long), (3, "behind " + long[:5000])]
    path = new_path(spark, "test-store")
    write_store(documents(rows), path, PATH, 2)
    at = 0
    for i, n_start, n, crc in sorted(map(tuple, read_store(spark, path).collect())):
        ids = library.encode(dict(rows)[i], add_special_tokens=False).ids + [2]
        assert (n_start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert at > 1 << 20


def test_many_special_strings(library):
    from stayframe.llm.token_store import encoder
    import pyarrow as pa

    texts = ["<|endoftext|>" * 30_000, "a<|endoftext|>b"]
    (_, _, ids, offsets), = encoder(PATH).rows(pa.array(texts), 2)
    want = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == want[0] + want[1] and offsets.tolist() == [0, len(want[0]), len(want[0]) + len(want[1])]


def test_repeated_rows_and_empty_table(spark, documents):
    path = new_path(spark, "test-store")
    write_store(documents([(7, "same text"), (7, "same text"), (8, "x"), (None, "y")]).withColumnRenamed("lang", "shard"), path, PATH, 2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in read_store(spark, path).collect())
    assert [g[1] for g in got] == [None, 7, 7, 8] and [g[0] for g in got] == [0, 2, 5, 8]
    path = new_path(spark, "test-store")
    write_store(documents([]), path, PATH, 2)
    assert read_store(spark, path).collect() == []
