"""URL filters: host and path rules, and for the rest a character language-model ratio.

The URLs that a rule allows and those that a rule blocks train two variable-order Markov
models over characters: the counts of every character behind contexts of 0 to ``order``
characters, smoothed from order to order (Witten-Bell: a context with ``n`` characters of
``t`` kinds gives ``t / (n + t)`` of its weight to the next shorter one; the last resort is
uniform). A URL's score is the mean over its characters of the difference of the log
probabilities. The threshold is calibrated on the judged URLs: the score at which the
shares of wrongly judged allowed and blocked ones are closest (both models know these URLs,
so only their separation counts). URLs at or above it are allowed.

Everything is DataFrame functions. All counts cover all URLs; a URL's characters are
grouped as n-grams before anything is shuffled. Scoring joins the n-grams of the URLs to the
table of n-grams: the frequent ones (each more than ``1 / HOT`` of all, so fewer than
``HOT`` of them) by a broadcast of that bounded size, the others by a shuffle, so one
n-gram that every URL holds makes no hot key.

Null URLs and those without ``://`` have empty host and path; no rule fits them and they are
judged by the model on their text (null: score 0). If no URL is allowed or none blocked by a
rule, all scores are 0 and the rest is allowed. Repeated rows are judged alike. Empty input: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._stage import staged

ORDER, ALPHABET, HOT, BINS = 4, 256, 2000, 2000
START = "\u0002"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, empty without ``://``."""
    plain = F.coalesce(url, F.lit(""))
    at = F.instr(plain, "://")
    rest = F.when(at > 0, F.substring(plain, at + 3, F.length(plain))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule of [(rule, allow or block)], as a struct (rule, verdict); else null.
    A rule ``host/path`` fits the host and its subdomains if the path starts with the rule's."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _model(grams: DataFrame, order: int) -> DataFrame:
    """(gram, llr): for every n-gram of ``order`` + 1 characters, the difference of the log probabilities
    of its last character. ``grams`` has its counts in allowed (a) and blocked (b) URLs."""
    below = None
    for k in range(order + 1):
        g = F.substring("gram", order + 1 - k, k + 1)
        level = grams.groupBy(g.alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        level = level.withColumn("ctx", F.substring("g", 1, k)).withColumn("low", F.substring("g", 2, k))
        contexts = level.groupBy(F.col("ctx").alias("c")).agg(
            *(F.sum(x).alias(f"n{x}") for x in "ab"), *(F.sum((F.col(x) > 0).cast("int")).alias(f"t{x}") for x in "ab"))
        level = level.join(contexts, F.col("ctx") == F.col("c"))
        if below is None:
            level = level.withColumns({f"q{x}": F.lit(1.0 / ALPHABET) for x in "ab"})
        else:
            level = level.join(below, "low")
        smooth = lambda x: F.when(F.col(f"n{x}") > 0, (F.col(x) + F.col(f"t{x}") * F.col(f"q{x}")) / (F.col(f"n{x}") + F.col(f"t{x}"))).otherwise(F.col(f"q{x}"))
        below = level.select(F.col("g").alias("low"), smooth("a").alias("qa"), smooth("b").alias("qb"))
    return below.select(F.col("low").alias("gram"), F.log(F.col("qa") / F.col("qb")).alias("llr"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """Per URL: id, host, path, rule, verdict, score."""
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    base = base.withColumn("host", host).withColumn("path", path)
    base = base.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("_row", F.monotonically_increasing_id())
    base = staged(base.select("_row", "_id", "_url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("ruled")), "urls")

    # characters of a URL in its n-grams, counted within the URL; characters are lower-cased
    text = F.concat(F.lit(START * order), F.lower("_url"))
    each = F.transform(F.sequence(F.lit(1), F.length("_url")), lambda i: F.substring(text, i, F.lit(order + 1)))
    chars = base.filter(F.length("_url") > 0).select("_row", "ruled", F.explode(each).alias("gram"))
    grams = chars.groupBy("gram").agg(F.count("*").alias("n"), F.sum((F.col("ruled") == "allow").cast("int")).alias("a"), F.sum((F.col("ruled") == "block").cast("int")).alias("b"))
    grams = staged(grams.withColumns({x: F.coalesce(x, F.lit(0)) for x in "ab"}), "url-grams")
    total, n_a, n_b = grams.agg(F.sum("n"), F.sum("a"), F.sum("b")).first()
    if not n_a or not n_b:
        return base.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))

    model = staged(_model(grams, order).join(grams.select("gram", "n"), "gram"), "url-model")
    often = F.col("n") > total / HOT
    hot = model.filter(often).select("gram", "llr")
    parts = chars.select("_row", "gram")
    first = parts.join(F.broadcast(hot), "gram", "left").groupBy("_row", F.when(F.col("llr").isNull(), F.col("gram")).alias("rest")) \
        .agg(F.sum("llr").alias("s"), F.count("*").alias("n"))
    rest = first.filter("rest IS NOT NULL").join(model.filter(~often).select(F.col("gram").alias("rest"), "llr"), "rest") \
        .select("_row", (F.col("llr") * F.col("n")).alias("s"), "n")
    sums = first.filter("rest IS NULL").select("_row", "s", "n").unionByName(rest).groupBy(F.col("_row").alias("_k")).agg(
        F.round(F.sum("s") / F.sum("n"), 6).alias("_score"))
    scored = staged(base.join(sums, F.col("_row") == F.col("_k"), "left").withColumn("score", F.coalesce("_score", F.lit(0.0))), "url-scores")
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule",
                         F.coalesce("ruled", F.when(F.col("score") >= threshold(scored), "allow").otherwise("block")).alias("verdict"), "score")


def threshold(scored: DataFrame) -> float:
    """The calibrated threshold: of ``BINS`` steps over the range of the judged URLs' scores, the one
    where the shares of allowed URLs below it and blocked ones at or above it are closest."""
    known = scored.filter("ruled IS NOT NULL").select("ruled", "score")
    low, high, n_a, n_b = known.agg(F.min("score"), F.max("score"), F.sum((F.col("ruled") == "allow").cast("int")), F.sum((F.col("ruled") == "block").cast("int"))).first()
    if low is None or math.isclose(low, high):
        return 0.0
    step = (high - low) / BINS
    bins = known.groupBy(F.floor((F.col("score") - low) / step).alias("bin")).agg(
        F.sum((F.col("ruled") == "allow").cast("int")).alias("a"), F.sum((F.col("ruled") == "block").cast("int")).alias("b"))
    below_a, best, at = 0, None, 0.0
    below_b = 0
    for k, a, b in sorted(map(tuple, bins.collect())):  # at most BINS + 1 rows
        gap = abs(below_a / n_a - (n_b - below_b) / n_b)
        if best is None or gap < best:
            best, at = gap, low + k * step
        below_a, below_b = below_a + a, below_b + b
    return at
