import itertools
import random

import pytest

from stayframe.llm import chat_repair as cr

TURNS = "conv_id bigint, turn bigint, role string, text string"


def brute(roles):
    """Least cost over all ways to label, merge and insert."""
    best = float("inf")
    for labels in itertools.product((1, 2, 3), repeat=len(roles)):
        for merges in itertools.product((False, True), repeat=len(roles)):
            state, cost = cr.START, 0.0
            for role, to, merged in zip(roles, labels, merges):
                cost += cr.relabel_cost(role, to)
                if merged:
                    if state != to:
                        cost = float("inf")
                    cost += cr.MERGE
                elif (state, to) in cr.INSERTED:
                    cost += cr.INSERT * len(cr.INSERTED[state, to])
                else:
                    cost = float("inf")
                state = to
            best = min(best, cost + cr.INSERT * len(cr.CLOSING[state]))
    return best


def legal(text):
    roles = [p.split("\n")[0] for p in text.split("<|im_start|>")[1:]]
    roles = roles[1:] if roles[0] == "system" else roles
    return bool(roles) and len(roles) % 2 == 0 and roles == ["user", "assistant"] * (len(roles) // 2) and text.endswith(cr.CLOSE) and text.count(cr.CLOSE) == text.count("<|im_start|>")


def conversations(n=60):
    r = random.Random(8)
    roles = ["system", "user", "assistant", "assistant", "user", "tool", None]
    return {c: [(t, r.choice(roles), f"text {c} {t}") for t in range(r.randint(1, 5))] for c in range(n)}


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_cost_is_least_and_chats_are_legal(spark, monkeypatch, chunk):
    monkeypatch.setattr(cr, "CHUNK", chunk)
    own = conversations()
    table = spark.createDataFrame([(c, *t) for c, ts in own.items() for t in ts], TURNS).repartition(6)
    rows = cr.repair(table)
    chats = {r.conv_id: r for r in cr.rendered(rows).collect()}
    assert set(chats) == set(own)
    for c, ts in own.items():
        assert abs(chats[c].cost - brute([t[1] for t in ts])) < 1e-9, ts
        assert legal(chats[c].text), chats[c].text
        places = [chats[c].text.index(t[2]) for t in ts]
        assert places == sorted(places)
    kept = rows.filter("action <> 'insert'").select("conv_id", "turn", "role").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(str((c, t[0], t[1])) for c, ts in own.items() for t in ts)


def test_one_very_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(cr, "CHUNK", 50)
    table = spark.createDataFrame([(1, t, ["user", "assistant", "assistant", "system"][t % 4], f"t{t}") for t in range(4000)] + [(2, 0, "user", "hi")], TURNS)
    rows = cr.repair(table.repartition(8))
    chats = {r.conv_id: r for r in cr.rendered(rows).collect()}
    assert legal(chats[1].text) and legal(chats[2].text) and rows.filter("conv_id = 1 AND action <> 'insert'").count() == 4000
    assert abs(chats[1].cost - float(cr.best_cost(["user", "assistant", "assistant", "system"] * 1000))) < 1e-6


def test_edge_cases(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a <|im_end|> b"), (None, 0, "user", "x"), (2, None, "assistant", "n"), (2, 0, "user", "u"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    table = spark.createDataFrame(rows, TURNS).withColumnRenamed("text", "pos").withColumnRenamed("pos", "text")
    chats = {r.conv_id: r.text for r in cr.rendered(cr.repair(table.selectExpr("*", "1 AS cost", "2 AS id"))).collect()}
    assert chats[1] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\na <| im_end|> b<|im_end|>\n"
    assert chats[3].count("same") == 2 and all(map(legal, chats.values())) and None in chats
    assert cr.repair(spark.createDataFrame([], TURNS)).collect() == []
