"""Places in one order over all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypolith.sources import tables as T

#: Within a range of rows in their order: what `placed` adds is enough to walk each range by itself.
RANGE, AT = "_range", "_at"


def placed(df: DataFrame, *order: str | Column, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """df with `position` (from 1 in the given order, which must be a total one), _range and _at, and the ranges (_range, rows, before).

    Rows are dealt to ranges of the order by sampled bounds, as many as there are partitions to shuffle to, so a value that
    most rows share is split by what comes after it in the order. The dealt rows are written, which fixes their places;
    what is left is a row for each range, with the number of rows before it.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = dealt.withColumns({RANGE: F.shiftright("_id", 33), AT: F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    dealt = T.written(dealt, "placed")
    ranges = dealt.groupBy(RANGE).agg(F.count("*").alias("rows"))
    ranges = T.written(ranges.select(RANGE, "rows", (F.sum("rows").over(Window.orderBy(RANGE)) - F.col("rows")).alias("before")), "ranges")  # a row a range
    return dealt.join(F.broadcast(ranges.select(RANGE, "before")), RANGE).withColumn("position", F.col("before") + F.col(AT) + 1).drop("before"), ranges


def walked(df: DataFrame, name: str, value: Column, fold: str = "last", back: bool = False) -> DataFrame:
    """placed rows with `name`: `value` folded over all rows before each (back: after each), in the order of the places.

    fold: last (the nearest that isn't null), sum or min. Each range is walked by a window of its own; what it hands to the
    next ranges is one row, and those few rows are walked the same way.
    """
    pick = {"last": lambda c: F.last(c, ignorenulls=True), "sum": F.sum, "min": F.min}[fold]
    both = {"last": lambda own, far: F.coalesce(own, far), "sum": lambda own, far: F.coalesce(own, F.lit(0)) + F.coalesce(far, F.lit(0)), "min": lambda own, far: F.least(own, far)}[fold]
    order = (lambda c: F.desc(c)) if back else F.col
    w = Window.partitionBy(RANGE).orderBy(order(AT)).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_v", value)
    ends = {"last": (F.min_by if back else F.max_by)("_v", F.when(F.col("_v").isNotNull(), F.col(AT))), "sum": F.sum("_v"), "min": F.min("_v")}[fold]
    far = df.groupBy(RANGE).agg(ends.alias("_e"))
    far = far.select(RANGE, pick("_e").over(Window.orderBy(order(RANGE)).rowsBetween(Window.unboundedPreceding, -1)).alias("_far"))  # a row a range
    out = df.withColumn("_own", pick("_v").over(w)).join(F.broadcast(far), RANGE)
    return out.withColumn(name, both(F.col("_own"), F.col("_far"))).drop("_v", "_own", "_far")
