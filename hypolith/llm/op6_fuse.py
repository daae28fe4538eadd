"""Exact duplicates: a static binary-fuse filter per immutable snapshot screens the digests of a new batch."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.llm.shingles import mixed
from hypolith.llm.tables import small, table, written

#: White space that doesn't count: U+0020 and U+0009 to U+000D.
BLANK = " \t\n\x0b\x0c\r"
#: Digests of the snapshot, and of the batch, that a shard takes on average; there are as many as the larger side needs.
SHARD = 50_000
_U = np.uint64


class Fuse:
    """A 3-wise binary-fuse filter with 16-bit fingerprints: no false negatives, false positives about 1 in 65,536."""

    def __init__(self, seed: int, segment: int, segments: int, cells: np.ndarray):
        self.seed, self.segment, self.segments, self.cells = seed, segment, segments, cells

    @staticmethod
    def places(keys: np.ndarray, seed: int, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(keys ^ mixed(np.array([seed], np.uint64)))
        first = (((h >> _U(32)) * _U(segment * segments)) >> _U(32)).astype(np.int64)
        second = (first + segment) ^ ((h >> _U(18)) & _U(segment - 1)).astype(np.int64)
        third = (first + 2 * segment) ^ (h & _U(segment - 1)).astype(np.int64)
        return np.stack([first, second, third]), (h ^ (h >> _U(32))).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> Fuse:
        """keys: distinct unsigned 64-bit digests. Rounds of peeling, all singly-held cells of a round at once."""
        n = max(2, len(keys))
        segment = min(1 << 18, 2 ** math.floor(math.log(n) / math.log(3.33) + 2.25))
        cells = math.floor(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n)))
        segments = max(1, -(-cells // segment) - 2)
        size = segment * (segments + 2)
        for seed in range(1, 1000):
            at, mark = cls.places(keys, seed, segment, segments)
            count = np.bincount(at.ravel(), minlength=size)
            owner = np.bincount(at.ravel(), weights=np.tile(np.arange(len(keys), dtype=float), 3), minlength=size)
            order = []
            while len(single := np.flatnonzero(count == 1)):
                key, i = np.unique(owner[single].astype(np.int64), return_index=True)
                order.append((key, single[i]))
                gone = at[:, key].ravel()
                count -= np.bincount(gone, minlength=size)
                owner -= np.bincount(gone, weights=np.tile(key.astype(float), 3), minlength=size)
            if sum(len(k) for k, _ in order) == len(keys):
                out = np.zeros(size, np.uint16)
                for key, cell in reversed(order):
                    a, b, c = at[:, key]
                    out[cell] = mark[key] ^ out[a] ^ out[b] ^ out[c]  # its own cell is still 0
                return cls(seed, segment, segments, out)
        raise RuntimeError("no seed gives a filter; the keys aren't distinct")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        (a, b, c), mark = self.places(keys, self.seed, self.segment, self.segments)
        return (self.cells[a] ^ self.cells[b] ^ self.cells[c]) == mark


FILTER = "shard long, seed long, segment long, segments long, cells binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    f = Fuse.build(np.unique(pdf["key"].to_numpy(np.int64).view(np.uint64)))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "seed": [f.seed], "segment": [f.segment], "segments": [f.segments], "cells": [f.cells.tobytes()]})


def _screen(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    if not len(filters) or not len(batch):
        return batch[["digest"]].iloc[:0]
    row = filters.iloc[0]
    f = Fuse(int(row["seed"]), int(row["segment"]), int(row["segments"]), np.frombuffer(row["cells"], np.uint16))
    return batch.loc[f.holds(batch["key"].to_numpy(np.int64).view(np.uint64)), ["digest"]]


def _sharded(digests: DataFrame, shards: int) -> DataFrame:
    key = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    return digests.select("digest", key.alias("key"), F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard"))


def snapshot_filters(digests: DataFrame, shards: int) -> DataFrame:
    """One filter per shard of distinct hexadecimal digests (a column `digest`): built once, as a snapshot never changes."""
    return _sharded(digests, shards).groupBy("shard").applyInPandas(_build, FILTER)


def screened(digests: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """The digests that the filters may hold: all that they do hold, and about 1 in 65,536 of the others."""
    return _sharded(digests, shards).groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_screen, "digest string")


def _groups(rows: DataFrame) -> DataFrame:
    best = F.max(F.struct("n_code", (-F.col("doc_id")).alias("less"))).alias("best")
    return rows.groupBy("digest").agg(best, F.count("*").alias("n"))


def _normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANK, "")


def exact_duplicates(docs: DataFrame, new: Column | None = None, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Texts are equal when identical without the characters of BLANK (null: empty, and empty texts equal each other).
    Of equal texts the one with most code points stays, of those the smallest id. `new` tells the rows of the
    incoming batch from those of the snapshot; None: ids above the middle of their range. Only the two columns are
    read. Repeated rows of an id each count and get equal results; rows with a null id are grouped too, but stay only
    where no other row does (keep_id is then null and they are kept). Texts of any length are hashed and compared whole; no
    rows give no rows.

    Snapshot and batch are grouped by SHA-256 separately, before any shuffle of rows, so a hot text costs one row a
    task. The snapshot's digests become one binary-fuse filter a shard, and shards are sized by the larger side, so that
    neither a large batch beside a small or empty snapshot nor the opposite fills one task; batch digests that no filter
    holds are new, the others join the snapshot's exact buckets. Rows of groups of two and more are then compared byte for byte with
    the row that stays; should two texts share a digest, their groups are formed by the texts themselves.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if new is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        new = F.col("doc_id") > (0 if low is None else (low + high) // 2)
    rows = rows.withColumn("new", F.coalesce(new, F.lit(False)))
    text = F.coalesce("text", F.lit(""))
    digests = written(rows.select("doc_id", "new", F.char_length(text).alias("n_code"), F.sha2(_normal(F.col("text")).cast("binary"), 256).alias("digest")), "digests", wide=True)
    old, batch = (written(_groups(digests.filter(c)), "buckets") for c in (~F.col("new"), F.col("new")))
    shards = max(1, -(-max(old.count(), batch.count()) // shard))
    filters = written(snapshot_filters(old.select("digest"), shards), "filters")
    maybe = written(screened(batch.select("digest"), filters, shards), "screened")
    # Positives go to the exact buckets; what the filters rule out meets no bucket at all.
    met = maybe.join(old, "digest").select("digest", "best", "n")
    merged = met.unionByName(batch.join(maybe, "digest", "left_semi")).groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    groups = merged.unionByName(batch.join(maybe, "digest", "left_anti")).unionByName(old.join(met.select("digest"), "digest", "left_anti"))
    groups = written(groups.select("digest", (-F.col("best.less")).alias("keep_id"), F.col("n").alias("group_size")), "groups")
    out = digests.join(groups, "digest").select("doc_id", "keep_id", "group_size", F.col("digest").alias("text_sha256"))
    copies = written(groups.filter("group_size > 1"), "copies")
    several = rows.select("doc_id", _normal(F.col("text")).alias("norm")).withColumn("digest", F.sha2(F.col("norm").cast("binary"), 256)).join(small(copies, 200_000), "digest")
    several = written(several.select("digest", "doc_id", "norm", "keep_id"), "copied", wide=True)
    # A row a digest, written, so that the join below has plain sides and a hot digest's rows can be dealt to many tasks.
    stays = written(several.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("norm").alias("stays")), "stays")
    clash = written(several.join(stays, "digest").filter("norm <> stays").select("digest"), "clashes")
    if clash.limit(1).count():
        clash = clash.distinct()
        own = several.join(clash, "digest", "left_semi").join(digests.select("doc_id", "n_code").distinct(), "doc_id").withColumn("text_sha256", F.col("digest"))
        own = own.withColumn("digest", F.concat("digest", "norm"))
        own = own.select("doc_id", "digest", "text_sha256").distinct().join(_groups(own), "digest").select("doc_id", (-F.col("best.less")).alias("keep_id"), F.col("n").alias("group_size"), "text_sha256")
        out = out.join(clash, F.col("text_sha256") == F.col("digest"), "left_anti").unionByName(own)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op6_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


#: DuckDB: the same groups from the texts themselves.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
