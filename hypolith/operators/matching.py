"""Pairs of rows of two kinds that lie nearest to each other in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hypolith.operators.order import AT, RANGE, placed, walked
from hypolith.sources import tables as T


def matched(df: DataFrame, key: str, side: str, at: str, partitions: int | None = None) -> DataFrame:
    """(key_a, key_b, gap): rows of one side with a near row of the other, no row used twice, until no partner is left; gap is in days.

    The result is that of taking the closest pair of all again and again; of pairs as far apart in days the one with fewer
    rows between them comes first, then the one that stands first.

    Rows of one side in a row are a run. Where two runs meet, their rows pair from the border outwards as parentheses do,
    the k-th before it with the k-th after it, at growing distances. So a row has at most two partners in question, one
    over each border of its run, and its place in the run says which. Pairs whose rows both prefer each other stand: what lies
    between them pairs closer, and whatever else happens can only move the other partner away. Where the run over a border
    is too short to hold a partner, one may come from beyond it once the rows between are gone, so the next row of the other
    side is what a pair must be closer than. A run of n beside a run of n is one round; otherwise runs that are shortest on
    both sides go in each. Rows without a date or a side are left out.
    """
    spark = df.sparkSession
    free, _ = placed(df.select(F.col(key).alias("key"), F.col(side).alias("side"), F.col(at).alias("at")).filter("at is not null and side is not null"), "at", "key", partitions=partitions)
    free = T.written(free.select("key", "side", "at", F.col("position").alias("place")), "free")
    path = T.shared_path(spark, "matched")
    schema = free.select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(0).alias("gap")).schema
    spark.createDataFrame([], schema).write.parquet(path)
    while True:
        rows, _ = placed(free, "place", partitions=partitions)
        rows = walked(rows, "was", F.col("side"))
        turn = F.col("was").isNotNull() & (F.col("was") != F.col("side"))
        rows = walked(rows, "turns", turn.cast("long"), "sum").withColumn("run", F.coalesce(F.col("turns"), F.lit(0)) + turn.cast("long"))
        rows = T.written(rows.select("key", "side", "at", "place", "run", RANGE, AT), "runs")
        if rows.agg(F.max("run")).first()[0] in (None, 0):
            return spark.read.schema(schema).parquet(path)
        # A run may lie in several ranges: its rows are counted by range, and the parts before and after are added.
        parts = rows.groupBy("run", RANGE).agg(F.count("*").alias("n"))
        over = Window.partitionBy("run").orderBy(RANGE)
        parts = parts.select("run", RANGE, F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("left"), F.coalesce(F.sum("n").over(over.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("right"))
        own = Window.partitionBy(RANGE, "run")
        rows = rows.withColumn("i", F.row_number().over(own.orderBy(AT))).withColumn("j", F.count("*").over(own) - F.col("i") + 1).join(parts, ["run", RANGE])
        row = F.struct("key", "side", "at", "place")
        sides = F.array(
            F.struct(F.col("run").alias("border"), (F.col("j") + F.col("right")).alias("k"), F.lit(True).alias("before")),
            F.struct((F.col("run") - 1).alias("border"), (F.col("i") + F.col("left")).alias("k"), F.lit(False).alias("before")),
        )
        met = rows.select(row.alias("r"), F.explode(sides).alias("x")).groupBy("x.border", "x.k").agg(F.max(F.when(F.col("x.before"), F.col("r"))).alias("a"), F.max(F.when(~F.col("x.before"), F.col("r"))).alias("b"))
        # A row without a partner over a border may get none closer than the end of the run after next.
        ends = rows.groupBy("run").agg(F.min_by(F.struct("at", "place"), "place").alias("first"), F.max_by(F.struct("at", "place"), "place").alias("last"))
        alone = met.filter("a is null or b is null").select(F.coalesce("a", "b").alias("r"), F.col("b").isNull().alias("ahead"), F.when(F.col("b").isNull(), F.col("border") + 3).otherwise(F.col("border") - 2).alias("run"))
        own = F.struct("r.at", "r.place")
        alone = alone.join(ends, "run").select("r", F.when(F.col("ahead"), own).otherwise(F.col("last")).alias("a"), F.when(F.col("ahead"), F.col("first")).otherwise(own).alias("b"))
        far = F.struct(F.datediff("b.at", "a.at").alias("gap"), (F.col("b.place") - F.col("a.place")).alias("rows"), F.col("a.place").alias("first")).alias("far")
        met, beyond = met.filter("a is not null and b is not null").select("a", "b", far), alone.select(F.col("r.place").alias("p"), far)
        each = met.select(F.explode(F.array("a.place", "b.place")).alias("p"), F.struct("a", "b").alias("x"), "far").unionByName(beyond, allowMissingColumns=True)
        both = each.groupBy("p").agg(F.min_by("x", "far").alias("x"), F.min("far").alias("far")).filter("x is not null")
        pairs = both.groupBy("x").agg(F.count("*").alias("asked"), F.any_value("far").alias("far")).filter("asked = 2")
        bad = F.col("x.a.side")
        pairs = T.written(pairs.select(F.when(bad, F.col("x.a.key")).otherwise(F.col("x.b.key")).alias("key_a"), F.when(bad, F.col("x.b.key")).otherwise(F.col("x.a.key")).alias("key_b"), F.col("far.gap").alias("gap"), F.array("x.a.place", "x.b.place").alias("gone")), "pairs")
        pairs.select("key_a", "key_b", "gap").write.mode("append").parquet(path)
        free = T.written(free.join(pairs.select(F.explode("gone").alias("place")), "place", "left_anti").select("key", "side", "at", "place"), "free")
