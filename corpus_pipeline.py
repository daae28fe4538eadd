"""The corpus pipeline: raw documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
result is written as Parquet, and the next stage works on all of it.

Every stage counts null texts as empty, reads texts whole however long they are, gives no rows for no rows, and passes
columns on that documents doesn't name, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hypolith.llm.op2_quality import classified
from hypolith.llm.op4_minhash import near_duplicates
from hypolith.llm.op5_templates import contaminated
from hypolith.llm.op6_fuse import exact_duplicates
from hypolith.llm.op8_packing import packed, public_files
from hypolith.llm.tables import small, table, written


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(small(written(ids.select("doc_id").distinct(), "dropped")), "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality that aren't toxic, by the co-trained classifier. Repeated rows are judged alike; a chance of
    exactly one half is kept, and without labels of both classes every document is."""
    held = {c.lower() for c in docs.columns}
    name = next(c for c in ("judged", *(f"judged_{i}" for i in range(len(held) + 1))) if c not in held)
    return classified(docs, table(spark, sf_dir, "labels"), name=name).filter(f"{name}.kept").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, and one row of each document. Of equal texts the longest as written stays,
    then the smallest id; rows with a null id stay where no other row of their text does."""
    found = written(exact_duplicates(docs), "exact")
    repeated = small(written(found.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated"))
    kept = _without(docs, found.filter("not kept"))
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest id. Texts without words and rows with a null id stay."""
    return _without(docs, near_duplicates(docs).filter("not kept"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items, verbatim or with other numbers and names. Rows with a null id stay."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null text is its end mark alone."""
    return packed(docs, **public_files())


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("packing", packing)]

#: The classifier, the template windows and the tokenizer can't be said in SQL; tests hold each stage to a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, wide=True)
    return docs
