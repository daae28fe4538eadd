"""MinHash near-duplicates by min-max hashing: each permutation gives its minimum and its maximum."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hypolith.llm.components import components
from hypolith.llm.shingles import Shingler, mixed
from hypolith.llm.tables import small, table, written

#: Similarity in percent, words a shingle, permutations (each gives two values), values a band.
THRESHOLD, WORDS, PERMUTATIONS, ROWS = 85, 5, 40, 4
#: Buckets that still hold unlinked members are compared pair by pair up to this size, and through rare shingles beyond.
BUCKET = 16


class Signer:
    """Minimum and maximum of a set of hashes under each permutation, cut into bands of `rows` values each."""

    def __init__(self, permutations: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2**63, (permutations, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, (permutations, 1), dtype=np.uint64)
        bands, values = 2 * permutations // rows, 2 * permutations
        # Minima in order, then maxima of the permutations a few places on: a band takes every `bands`th of them, and so
        # never both ends of one permutation.
        order = np.concatenate([np.arange(permutations), permutations + (np.arange(permutations) + 7) % permutations])
        self.at = order[(np.arange(bands)[:, None] + bands * np.arange(rows)) % values]
        self.weight = rng.integers(0, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        low = high = None
        for i in range(0, len(shingles), 2048):
            h = shingles[None, i : i + 2048] * self.a + self.b
            h ^= h >> np.uint64(32)
            least, most = h.min(1), h.max(1)
            low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
        return np.concatenate([low, high])

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        return mixed((mixed(self.signature(shingles))[self.at] * self.weight).sum(1, dtype=np.uint64) + self.salt)


def _signed(words: int, permutations: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(words), Signer(permutations, rows)
        for batch in batches:
            sizes, one, two, bands = [], [], [], []
            for text in batch.column(1):
                s = shingler.shingles(text.as_py())
                sizes.append(len(s))
                one.append(s.sum(dtype=np.uint64).astype(np.int64))
                two.append(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64))
                bands.append(signer.bands(s).astype(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return run


def _compared(words: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held = Shingler(words), {}
        for batch in batches:
            low, high, a, b = batch.columns
            keep = []
            for i in range(len(batch)):
                if low[i].as_py() not in held:
                    held = {low[i].as_py(): shingler.shingles(a[i].as_py())}
                x, y = held[low[i].as_py()], shingler.shingles(b[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([low, high], ["low", "high"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingler.shingles(x.as_py()).astype(np.int64) for x in batch.column(1)], pa.list_(pa.int64()))], ["doc_id", "shingles"])

    return run


def _least(size: Column, threshold: int) -> Column:
    """The least shingles that two sets with so many in all share at the threshold."""
    return F.ceil(size * threshold / (100 + threshold) - 1e-9)


def _rare_pairs(texts: DataFrame, words: int, threshold: int) -> DataFrame:
    """Pairs of different components that can reach the threshold, out of texts (doc_id, text, comp).

    Exact: ordered from rare to common, two such sets share a shingle among their first n - ceil(threshold * n) + 1,
    and where they share one, what follows it must still be long enough in both.
    """
    shingles = texts.select("doc_id", "text").mapInArrow(_sets(words), "doc_id long, shingles array<long>")
    rows = written(shingles.select("doc_id", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")), "sets")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    order = Window.partitionBy("doc_id").orderBy("df", "shingle")
    prefix = rows.join(counts, "shingle").withColumn("at", F.row_number().over(order) - 1).filter((F.col("at") <= F.col("n") - F.ceil(F.col("n") * threshold / 100 - 1e-9)) & (F.col("df") > 1))
    prefix = written(prefix.join(texts.select("doc_id", "comp"), "doc_id"), "prefixes")
    x, y = (prefix.select("shingle", *(F.col(c).alias(f"{c}_{k}") for c in ("doc_id", "n", "at", "comp"))) for k in "xy")
    share = F.least(F.expr("n_x - at_x"), F.expr("n_y - at_y"))
    can = (F.col("doc_id_x") < F.col("doc_id_y")) & (F.col("comp_x") != F.col("comp_y")) & (share >= _least(F.expr("n_x + n_y"), threshold))
    return x.join(y, (x["shingle"] == y["shingle"]) & can).select(F.col("doc_id_x").alias("low"), F.col("doc_id_y").alias("high")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, words: int = WORDS, permutations: int = PERMUTATIONS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked when 100 * intersection >= threshold * union over their sets of `words`-word shingles;
    component_id is the smallest id reachable. Only these two columns are read. Null or wordless texts have no
    shingles and are linked with nothing; texts under `words` words have one shingle, the whole sequence. Rows with a
    null id are returned with a null component and kept. Repeated rows of one id get equal results. An id whose rows
    differ in text is one node of the graph: each of its texts collapses with its equals, and links to others are
    confirmed on the largest of its texts. Ties don't occur. Texts of any length are read whole; no rows give no rows.

    1. One pass over the texts gives each set's size, a 128-bit digest and its bands of min-max values. Equal sets
       collapse to the smallest id before any bucket is formed, so exact copies cost one row.
    2. In every bucket all members are compared with its smallest id, on full sets; links give components.
    3. A link can only be missing between members of one bucket in different components. Those pairs are compared:
       in buckets up to BUCKET members directly, else those that share a rare shingle (an exact prefix filter), so
       no bucket is ever expanded into all its pairs.
    With similarity at the threshold of 85 %, a pair misses all 20 bands of 4 with probability 4e-7.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(docs.mapInArrow(_signed(words, permutations, rows), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"), "signatures", wide=True)
    there = signed.filter("n_shingles > 0 and doc_id is not null")
    keys = ["set_a", "set_b", "n_shingles"]
    classes = there.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands"))
    classes = written(classes, "classes")
    banded = classes.select("rep", F.explode("bands").alias("bucket"))
    centres = banded.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("members")).filter("members > 1")
    members = written(banded.join(centres, "bucket"), "buckets")
    texts = written(docs.join(small(written(members.select(F.col("rep").alias("doc_id")).distinct(), "bucketed")), "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text")), "texts", wide=True)

    def linked(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text")) for c in ("low", "high"))
        both = pairs.join(a, "low").join(b, "high").select("low", "high", "low_text", "high_text")
        return both.mapInArrow(_compared(words, threshold), "low long, high long")

    first = written(members.filter("rep <> centre").select(F.col("centre").alias("low"), F.col("rep").alias("high")).distinct(), "pairs")
    links = written(linked(first), "linked")
    roots = written(components(links), "roots")
    placed = members.join(roots, members["rep"] == roots["node"], "left").select("bucket", "rep", "members", F.coalesce("root", "rep").alias("comp"))
    placed = written(placed, "placed")
    split = placed.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).filter("least <> most and count(*) > 2").select("bucket")
    left = written(placed.join(split, "bucket", "left_semi"), "left")
    some = left.filter(F.col("members") <= BUCKET)
    x, y = some.alias("x"), some.alias("y")
    more = x.join(y, F.expr("x.bucket = y.bucket and x.rep < y.rep and x.comp <> y.comp")).select(F.col("x.rep").alias("low"), F.col("y.rep").alias("high")).distinct()
    crowd = written(left.filter(F.col("members") > BUCKET).select(F.col("rep").alias("doc_id"), "comp").distinct(), "crowd")
    if crowd.limit(1).count():
        more = more.unionByName(_rare_pairs(texts.join(small(crowd), "doc_id"), words, threshold)).distinct()
    more = written(more.join(first, ["low", "high"], "left_anti"), "pairs")
    also = written(linked(more), "linked")
    if also.limit(1).count():
        roots = written(components(links.unionByName(also)), "roots")
    classes = classes.join(roots, classes["rep"] == roots["node"], "left").select(*keys, F.coalesce("root", "rep").alias("root"))
    out = signed.select("doc_id", *keys).join(classes, keys, "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
