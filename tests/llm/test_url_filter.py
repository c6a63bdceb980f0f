import math
import random
import re
from collections import Counter

from stayframe.llm import url_filter as uf
from stayframe.llm.queries import URL_RULES

PAGES = "page_id bigint, url string, html string"


def split(url):
    url = url or ""
    at = url.find("://")
    if at < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3:], re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule(host, path):
    fits = [(r, v) for r, v in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def brute_scores(urls, ruled, order=uf.ORDER):
    counts = {c: [Counter() for _ in range(order + 1)] for c in ("allow", "block")}
    for u, v in zip(urls, ruled):
        if u and v:
            t = uf.START * order + u.lower()
            for i in range(order, len(t)):
                for k in range(order + 1):
                    counts[v][k][t[i - k:i + 1]] += 1
    context = {c: [Counter() for _ in range(order + 1)] for c in counts}
    kinds = {c: [Counter() for _ in range(order + 1)] for c in counts}
    for c in counts:
        for k in range(order + 1):
            for g, n in counts[c][k].items():
                context[c][k][g[:-1]] += n
                kinds[c][k][g[:-1]] += 1

    def prob(c, g):
        p = 1 / uf.ALPHABET
        for k in range(order + 1):
            s = g[len(g) - k - 1:]
            n, t = context[c][k][s[:-1]], kinds[c][k][s[:-1]]
            if n:
                p = (counts[c][k][s] + t * p) / (n + t)
        return p

    out = []
    for u in urls:
        t = uf.START * order + (u or "").lower()
        grams = [t[i - order:i + 1] for i in range(order, len(t))]
        out.append(sum(math.log(prob("allow", g) / prob("block", g)) for g in grams) / len(grams) if grams else 0.0)
    return out


def urls():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abehnost") for _ in range(r.randint(2, 7)))
    out = [f"{r.choice(['http', 'HTTPS'])}://{r.choice(['www.', '', 'm.'])}{r.choice(['example', word()])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'es', 'fr', 'de'])}/{word()}{r.choice(['', '?a=http://x.com/', '#top'])}"
           for _ in range(150)]
    return out + [None, "", "no scheme", "http://", "http://com", "http://com/", "x://WWW.Example.COM/en/", "http://a.example.com/en", "http://a.example.com/en/", "http://notexample.com/en/x",
                  "http://é.net/es/ñ", "http://x.net/es?/y", "a\nb://h.net/fr/\nz#q", "http://x.com/" + "a" * 5000, "http://net/es/", "http://net.es/fr/", out[0]]


def test_rules_and_scores_equal_brute_force(spark):
    rows = list(enumerate(urls()))
    table = spark.createDataFrame([(i, u, "x") for i, u in rows], PAGES).withColumnRenamed("html", "host")
    got = {r.page_id: r for r in uf.judge(table, URL_RULES).collect()}
    want = {i: (*split(u), *rule(*split(u))) for i, u in rows}
    scores = brute_scores([u for _, u in rows], [want[i][3] for i, _ in rows])
    assert len(got) == len(rows)
    for i, u in rows:
        host, path, name, verdict = want[i]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name), u
        assert abs(got[i].score - scores[i]) < 2e-6, u
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    free = [got[i] for i, _ in rows if not want[i][3]]
    lowest = min((r.score for r in free if r.verdict == "allow"), default=math.inf)
    assert all(r.score < lowest for r in free if r.verdict == "block")
    judged = [(got[i].score, want[i][3]) for i, _ in rows if want[i][3]]
    cut = max((r.score for r in free if r.verdict == "block"), default=-math.inf)
    right = sum((s > cut) == (v == "allow") for s, v in judged)
    assert right > 0.85 * len(judged)


def test_without_one_kind_and_empty(spark):
    table = spark.createDataFrame([(1, "http://a.com/x", ""), (2, "http://b.org/", ""), (2, "http://b.org/", "")], PAGES)
    assert sorted((r.page_id, r.verdict, r.score) for r in uf.judge(table, URL_RULES).collect()) == [(1, "allow", 0.0), (2, "allow", 0.0), (2, "allow", 0.0)]
    assert uf.judge(spark.createDataFrame([], PAGES), URL_RULES).collect() == []


def test_plan_has_no_python(spark):
    table = spark.createDataFrame([(1, "http://a.com/x", ""), (2, "http://b.net/es/", "")], PAGES)
    assert "Python" not in uf.judge(table, URL_RULES)._jdf.queryExecution().toString()
