"""Registered queries of the training-data operators: thin calls with production parameters, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroid_clustering as _cc
from . import chat_repair as _cr
from . import decontaminate as _dc
from . import embedding_dedup as _ed
from . import hard_negatives as _hn
from . import language_id as _li
from . import minhash_dedup as _md
from . import mixing as _mx
from . import substring_dedup as _sd
from . import token_counts as _tc
from . import token_store as _ts
from . import url_filter as _uf
from . import warc as _wa
from ._stage import ensure_package, new_path

#: Files of public tokenizers lie outside the repository; their place is a parameter.
OVER_LIMIT, END_ID, WINDOW = 512, 2, 10


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_package(spark)
        return fn(spark, sf_dir)

    return query


@registered
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tc.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), OVER_LIMIT)


@registered
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sd.without_repeats(table(spark, sf_dir, "documents"), length=100).drop("kept")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


@registered
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = _li.fit(docs, ~held_out() & F.col("doc_id").isNotNull())
    return _li.predict(docs, model).withColumn("held_out", held_out())


#: Host and path rules of the URL filter.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


@registered
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uf.judge(table(spark, sf_dir, "pages"), URL_RULES)


@registered
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mx.mix(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0).documents.drop("_mix_row")


@registered
def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cr.repair(table(spark, sf_dir, "conversations"))


@registered
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ed.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


@registered
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    _ts.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), END_ID)
    return _ts.read_store(spark, path)


@registered
def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _md.near_duplicates(table(spark, sf_dir, "documents"), size=5, least=0.8)


@registered
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dc.digest(_dc.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW))


@registered
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cc.digest(*_cc.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256, salt="2"))


@registered
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return _hn.mine(table(spark, sf_dir, "embeddings"), anchor=F.col("vec_id") % 100 == 0, label=relabelled)


@registered
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    _wa.write_archives(table(spark, sf_dir, "pages"), path)
    return _wa.read_archives(spark, path).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_chat_repair": op6_chat_repair,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_token_store": op8_token_store,
    "op9_minhash_dedup": op9_minhash_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc": op13_warc,
}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _url_filter_sql(order: int = _uf.ORDER) -> str:
    """The URL filter in DuckDB SQL: rules, counts and smoothing from order to order, scores, threshold."""
    by_length = sorted(URL_RULES, key=lambda r: -len(r[0]))
    fits = {r: f"((host = '{r.split('/')[0]}' OR ends_with(host, '.{r.split('/')[0]}')) AND starts_with(path, '{r[r.index('/'):]}'))" for r, _ in by_length}
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r}'" for r, _ in by_length) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{v}'" for r, v in by_length) + " END"
    levels = []
    for k in range(order + 1):
        low = (lambda x: f"l.q{x}") if k else (lambda x: f"{1 / _uf.ALPHABET}")
        smooth = lambda x: f"CASE WHEN n{x} > 0 THEN ({x} + t{x} * {low(x)}) / (n{x} + t{x}) ELSE {low(x)} END AS q{x}"  # noqa: B023, E731
        levels.append(f"""g{k} AS (SELECT substr(gram, {order + 1 - k}, {k + 1}) AS g, sum(a) AS a, sum(b) AS b FROM grams GROUP BY 1),
c{k} AS (SELECT substr(g, 1, {k}) AS c, sum(a) AS na, sum(b) AS nb, sum(CAST(a > 0 AS INTEGER)) AS ta, sum(CAST(b > 0 AS INTEGER)) AS tb FROM g{k} GROUP BY 1),
m{k} AS (SELECT g{k}.g AS g, {smooth('a')}, {smooth('b')} FROM g{k} JOIN c{k} ON substr(g{k}.g, 1, {k}) = c""" + (f" JOIN m{k - 1} l ON l.g = substr(g{k}.g, 2, {k})" if k else "") + ")")
    return f"""
WITH p AS (SELECT page_id, url, coalesce(url, '') AS t, strpos(coalesce(url, ''), '://') AS mark FROM pages),
r AS (SELECT *, CASE WHEN mark > 0 THEN substr(t, mark + 3) ELSE '' END AS rest FROM p),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
b AS (SELECT row_number() OVER () AS rid, page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
v AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM b),
chars AS (SELECT rid, ruled, substr(t, i, {order + 1}) AS gram
  FROM (SELECT rid, ruled, repeat(chr(2), {order}) || lower(url) AS t, unnest(range(1, length(url) + 1)) AS i FROM v WHERE length(url) > 0)),
grams AS (SELECT gram, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM chars GROUP BY gram),
{", ".join(levels)},
s AS (SELECT rid, round(sum(ln(qa / qb)) / count(*), 6) AS s FROM chars JOIN m{order} ON gram = g GROUP BY rid),
n AS (SELECT count(*) FILTER (ruled = 'allow') AS na, count(*) FILTER (ruled = 'block') AS nb FROM v),
scored AS (SELECT v.*, CASE WHEN na > 0 AND nb > 0 THEN coalesce(s, 0.0) ELSE 0.0 END AS score FROM v LEFT JOIN s USING (rid), n),
span AS (SELECT min(score) AS lo, max(score) AS hi, (max(score) - min(score)) / {_uf.BINS} AS step FROM scored WHERE ruled IS NOT NULL),
bins AS (SELECT floor((score - lo) / step) AS bin, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b
  FROM scored, span WHERE ruled IS NOT NULL AND step > 0 GROUP BY 1),
cut AS (SELECT bin, coalesce(sum(a) OVER w, 0) AS a, coalesce(sum(b) OVER w, 0) AS b FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
threshold AS (SELECT lo + bin * step AS x FROM cut, n, span ORDER BY abs(a / na - (nb - b) / nb), bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= coalesce((SELECT x FROM threshold), 0.0) THEN 'allow' ELSE 'block' END) AS verdict, score FROM scored"""


def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Centroid clustering in DuckDB SQL: a pair of subqueries for each round."""
    steps = []
    for r in range(rounds + 1):
        far = "list_sum(list_transform(list_zip(b.v, c.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
        steps.append(f"""a{r} AS (SELECT rid, vec_id, v, n, d FROM (SELECT b.*, c.n, CAST({far} AS BIGINT) AS d FROM b, c{r} c)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, n) = 1)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT n, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM (SELECT n, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY n, i),
m{r} AS (SELECT n, list((s - ((s % m) + m) % m) // m ORDER BY i) AS v FROM s{r} GROUP BY n),
c{r + 1} AS (SELECT c.n, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (n))""")
    return f"""
WITH b AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), v) - 1 AS n, v FROM b QUALIFY n < {k}),
{", ".join(steps)}
SELECT vec_id, CAST(n AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (n)"""


ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clustering": _clustering_sql(),
    "op12_hard_negatives": """
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (SELECT a.rid, a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS alike,
    CAST(coalesce(list_sum(list_transform(list_zip(a.v, o.v), lambda t: coalesce(t[1], 0) * coalesce(t[2], 0))), 0) AS BIGINT) AS score
  FROM e a JOIN e o ON a.rid <> o.rid WHERE a.vec_id % 100 = 0),
positives AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, id) AS place FROM p WHERE alike QUALIFY place <= 5)
SELECT q.anchor_id, q.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.id AS negative_id, q.score AS positive_score, n.score AS negative_score
FROM positives q JOIN p n ON q.rid = n.rid AND NOT n.alike AND 80 * q.score <= 100 * n.score AND n.score <= q.score
WINDOW w AS (PARTITION BY q.rid, q.place ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 5""",
    "op13_warc": """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, n AS payload_bytes,
  digest AS payload_digest, CASE WHEN n >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f""",
    "op4_url_filter": _url_filter_sql(),
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT p.doc_id, p.i, p.n, wins.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM places) p JOIN wins ON p.n = wins.n AND p.win = wins.win),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
}
