"""Domain views over the given tables: prices, signals and filings in long form, one row an observation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); in a local one only where Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="hypolith-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor loses none of it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close): the last value of each user's day."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.max_by("value", "ts").alias("close"))


def long_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close, volume): each supplier's mean unit price and quantity by day, over seven years."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date"))
    return rows.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, signal): each customer's largest order of a day."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("signal"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ticker, date, text): documents as filings of their source, one a day."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("ticker"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int")).alias("date"), "text")


def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, ret): the mean monthly change of all suppliers' prices, a series of some eighty rows."""
    month = F.to_date(F.trunc(F.to_date("l_shipdate"), "month"))
    close = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), month.alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"))
    change = close.select("date", F.expr("close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS ret"))
    return change.filter("ret is not null").groupBy("date").agg(F.avg("ret").alias("ret"))
