"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import staged

#: So many links, and no more, are united by one task at the end.
LAST_LINKS = 100_000


def _united(links: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(u, to): the smallest node of its group for every node of a bounded number of links."""
    parts = list(links)
    if not parts:
        return
    both = pd.concat(parts)
    nodes, ends = np.unique(both[["u", "v"]].to_numpy().ravel(), return_inverse=True)
    u, v = ends.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    yield pd.DataFrame({"u": nodes, "to": nodes[root]})


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected links, for every node
    that a link names (bigint). Each round, every node joins the neighbour (or itself) that comes
    first in a hashed order of that round, and the links between the joined nodes go on; a constant
    share of the nodes vanishes in each round whatever the shape of the groups, so the rounds grow
    with the logarithm of their number; the last ``LAST_LINKS`` links are united by one task. Tables
    only: nothing is collected, and a node with very many links is met by partial aggregation and by
    joins that Spark may split."""
    links = staged(links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).filter("u <> v").distinct(), "links")
    maps, k = [], 0
    while n := links.count():
        if n <= LAST_LINKS:
            maps.append(staged(links.coalesce(1).mapInPandas(_united, "u bigint, to bigint"), "joined"))
            break
        both = links.union(links.select("v", "u")).toDF("u", "v")
        order = lambda c: F.xxhash64(F.lit(k), F.col(c))  # noqa: B023, E731
        first = both.groupBy("u").agg(F.min(F.struct(order("v").alias("h"), F.col("v").alias("x"))).alias("m"))
        own = F.struct(order("u").alias("h"), F.col("u").alias("x"))
        joined = staged(first.select("u", F.least(F.col("m"), own)["x"].alias("to")), "joined")
        maps.append(joined)
        links = links.join(joined, "u").select(F.col("to").alias("s"), "v") \
            .join(joined.select(F.col("u").alias("v"), F.col("to").alias("t")), "v").filter("s <> t") \
            .select(F.least("s", "t").alias("u"), F.greatest("s", "t").alias("v")).distinct()
        links, k = staged(links, "links"), k + 1
    if not maps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = maps[0].withColumnRenamed("u", "node")
    for m in maps[1:]:
        out = out.join(m.select(F.col("u").alias("at"), F.col("to").alias("next")), F.col("to") == F.col("at"), "left").select("node", F.coalesce("next", "to").alias("to"))
    out = staged(out, "roots")
    smallest = out.groupBy("to").agg(F.min("node").alias("component"))
    return out.join(smallest, "to").select("node", "component")
