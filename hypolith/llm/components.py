"""Connected components of a graph of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hypolith.llm.tables import written


def _tied(links: DataFrame) -> DataFrame:
    """Every node and its neighbours, tied to the smallest of them: all stay connected through that one."""
    both = links.select(F.col("low").alias("at"), F.col("high").alias("node")).unionByName(links.select(F.col("high").alias("at"), F.col("low").alias("node")))
    least = both.groupBy("at").agg(F.min("node").alias("m")).select("at", F.least("m", "at").alias("root"))
    near = both.join(least, "at").select("node", "root").unionByName(least.select(F.col("at").alias("node"), "root"))
    return near.filter("node <> root").select(F.col("root").alias("low"), F.col("node").alias("high")).distinct()


def components(links: DataFrame, low: str = "low", high: str = "high", rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link, where root is the smallest node it can reach.

    Each round ties a node and its larger neighbours to the smallest node in its neighbourhood, which keeps what is
    connected, until nothing changes. Minima are taken before the shuffle, and links that coincide are merged in
    every round, so a node with very many links costs no more than they do. Every round is a written table. An
    unlinked or null node doesn't appear; no links give no rows.
    """
    a, b = F.col(low), F.col(high)
    now = written(links.filter(a != b).select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).distinct(), "links")
    sign = lambda d: d.agg(F.count("*"), F.sum(F.hash("low", "high").cast("decimal(38,0)"))).first()
    was = sign(now)
    for _ in range(rounds):
        if not was[0]:
            break
        now = written(_tied(now), "links")
        if (new := sign(now)) == was:
            break
        was = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.unionByName(now.select(F.col("low").alias("node"), F.col("low").alias("root"))).distinct()
