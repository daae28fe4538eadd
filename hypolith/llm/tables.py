"""Reading inputs, and cutting lineage by tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of up to three longs that may be broadcast (under 50 MB as a hash table); larger sides are shuffled.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where that is unset and Spark is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        local = tempfile.mkdtemp(prefix="hypolith-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and a lost executor loses none of it.

    Written by at most four tasks a core of the cluster, for most of these tables are small and every file costs a
    round trip and a process on the local file system; `wide` keeps df's own partitions, for tables as large as the corpus.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df if wide else df.coalesce(4 * spark.sparkContext.defaultParallelism)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `limit` rows, and as it is (for a shuffled join) beyond them.

    df must be cheap to count (a written table) and narrow (a few numbers or short strings a row).
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
