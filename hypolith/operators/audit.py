"""Hashes that say which part of a table, which entry of a log or which file was altered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.operators.order import placed
from hypolith.sources import tables as T

#: Children of a node.
FAN = 16


def row_hash(columns: list[str]) -> Column:
    """A hash of the columns' values in order. Each is preceded by its length, so no two rows are written alike; a null by n."""
    part = lambda c: F.coalesce(F.concat(F.char_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("n"))
    return F.sha2(F.concat_ws(",", *map(part, columns)).cast("binary"), 256)


def tree(df: DataFrame, key: list[str], columns: list[str], fan: int = FAN) -> DataFrame:
    """(level, node, hash): a Merkle tree over the rows in the order of `key`, which must be a total one.

    Level 0 has a node a row; a node above hashes the hashes of its up to `fan` children in order, and the last level has one
    node, the root. Every level is a fan-th of the one below, so the whole is little more than one shuffle of the hashes,
    and no task sees more than a share of a level. An empty table has no nodes.
    """
    level = placed(df.select(*key, row_hash(columns).alias("hash")), *key)[0].select((F.col("position") - 1).alias("node"), "hash")
    levels = [T.written(level, "level")]
    while levels[-1].count() > 1:
        up = levels[-1].groupBy(F.floor(F.col("node") / fan).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("c"))
        levels.append(T.written(up.select("node", F.sha2(F.array_join(F.transform("c", lambda x: x["hash"]), "").cast("binary"), 256).alias("hash")), "level"))
    return reduce(DataFrame.unionByName, [d.select(F.lit(i).alias("level"), "node", "hash") for i, d in enumerate(levels)])


def altered(before: DataFrame, after: DataFrame, fan: int = FAN) -> DataFrame:
    """(level, node) of the nodes of two trees that differ, or that one of them lacks, from the root down. Below a node that is
    equal in both nothing is compared: of a level only the children of what differs above are read."""
    top = max(before.agg(F.max("level")).first()[0] or 0, after.agg(F.max("level")).first()[0] or 0)
    found, above = [], None
    for level in range(top, -1, -1):
        a, b = (d.filter(F.col("level") == level).select("node", F.col("hash").alias(name)) for d, name in ((before, "a"), (after, "b")))
        if above is not None:
            a, b = (d.withColumn("up", F.floor(F.col("node") / fan)).join(above, "up", "left_semi").drop("up") for d in (a, b))
        differ = T.written(a.join(b, "node", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("node"), "differ")
        found.append(differ.select(F.lit(level).alias("level"), "node"))
        above = differ.withColumnRenamed("node", "up")
    return reduce(DataFrame.unionByName, found)


def chain(entries: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """entries with `previous` and `link`: each entry of a log `by` hashes its own values and the link before it, so a later change,
    loss or swap of an entry breaks every link from there on. A log is one array while it is linked: entries are a run's steps."""
    e = entries.withColumn("own", row_hash(columns))
    logs = e.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "own"))).alias("e"))
    link = lambda last, own: F.sha2(F.concat(last, own).cast("binary"), 256)
    start = F.array(F.repeat(F.lit("0"), F.lit(64)))
    links = F.aggregate("e", start, lambda done, x: F.concat(done, F.array(link(F.element_at(done, -1), x["own"]))))
    each = logs.select(*by, "e", links.alias("links")).select(*by, F.posexplode("e").alias("i", "x"), "links")
    each = each.select(*by, F.col("x.at").alias(order), F.element_at("links", F.col("i") + 1).alias("previous"), F.element_at("links", F.col("i") + 2).alias("link"))
    return entries.join(each, [*by, order])


def broken(linked: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """(by, order) of the first entry of each log whose link isn't what its values and the entry before make it."""
    held = linked.select(*by, order, *(c for c in columns if c not in {*by, order}), F.col("link").alias("held"))
    again = chain(held, by, order, columns)
    return again.filter(F.col("held") != F.col("link")).groupBy(*by).agg(F.min(order).alias(order))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file, read by tasks where it lies; a file is one value, so they are reports, not data."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
