import random
import time

import pytest
from tokenizers import Tokenizer

from stayframe.llm.queries import tokenizer_path
from stayframe.llm.token_counts import counter, prefix_table, token_counts, truncate_to_budget

PATH = tokenizer_path("byte_bpe_50k.json")
ALPHABET = list("abcdehtTrmlv'''   \n\t!?.,019éñ　 ß٣½中😀-_") + ["'s", "'re", "'ll", " the", "<|endoftext|>", "<|", "tion"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def texts(n, size):
    r = random.Random(3)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_counts_equal_the_library(spark, documents, library):
    rows = [*enumerate(texts(500, 60)), (1000, None), (1001, ""), (1002, "= " * 5000 + "x" * 3000), (1002, "x"), (1003, " \n \n")]
    got = token_counts(documents(rows), PATH, 20).collect()
    want = [(i, len((t or "").encode()), encoded(library, t or ""), encoded(library, t or "") > 20) for i, t in rows]
    assert sorted(map(tuple, got)) == sorted(want)


def test_every_prefix_equals_the_library(library):
    own = counter(PATH)
    for t in texts(120, 30):
        assert own.prefix_counts(t).tolist() == [encoded(library, t[:i]) for i in range(len(t) + 1)], t


def test_truncation_and_stored_counts(spark, documents, library):
    rows = list(enumerate(texts(40, 40))) + [(99, None)]
    cut = {r.doc_id: r for r in truncate_to_budget(documents(rows), PATH, 7).collect()}
    stored = {r.doc_id: r.counts for r in prefix_table(documents(rows), PATH).collect()}
    for i, t in rows:
        best = max(k for k in range(len(t or "") + 1) if encoded(library, (t or "")[:k]) <= 7)
        assert cut[i].text == (None if t is None else t[:best]) and cut[i].n_tokens == encoded(library, (t or "")[:best])
        assert stored[i][-1] == encoded(library, t or "") and len(stored[i]) == len(t or "") + 1


def test_empty_table_and_clashing_columns(spark, documents):
    assert token_counts(documents([]), PATH, 5).collect() == []
    clash = documents([(1, "a b")]).withColumnRenamed("lang", "n_tokens").withColumnRenamed("source", "_text")
    assert [tuple(r) for r in token_counts(clash, PATH, 5).collect()] == [(1, 3, 2, False)]


@pytest.mark.parametrize("text", ["=" * 300_000, "".join(random.Random(4).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)),
                                  "".join(random.Random(5).choice(["the", "é", "ß", "漢", "qu", "ing"]) for _ in range(4000))], ids=["equal", "random", "mixed"])
def test_long_unbroken_runs(text):
    """In seconds, and every prefix as the library counts it (some of them compared)."""
    from tokenizers import Tokenizer

    from stayframe.llm.token_counts import PrefixCounter

    library, raw = Tokenizer.from_file(PATH), text.encode()
    start = time.time()
    counts = PrefixCounter(PATH).prefixes(raw)
    assert time.time() - start < 60
    assert len(counts) == len(raw) + 1
    for cut in (1, 7, 50, 333, 4000, len(text)):
        assert counts[len(text[:cut].encode())] == len(library.encode(text[:cut], add_special_tokens=False).ids)
