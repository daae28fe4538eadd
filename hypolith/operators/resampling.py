"""Resampling with draws that any engine can repeat: the first eight hex digits of an MD5 of the draw's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*keys: Column | str | int) -> Column:
    """A whole number below 2**32 from the keys."""
    parts = [k if isinstance(k, Column) else F.lit(k) if isinstance(k, int) else F.col(k) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def seed_of(base: int, uuid: Column) -> Column:
    """(base + the first eight hex digits of the uuid's SHA-256) mod 2**31."""
    return (F.lit(base) + F.conv(F.substring(F.sha2(uuid.cast("binary"), 256), 1, 8), 16, 10).cast("bigint")) % F.lit(2**31)


def block_length(n: int, acf1: float | None) -> int:
    """5, 10 or 21 by the size of the first autocorrelation, at most max(2, n // 5); n // 4 under 20 rows."""
    if n < 20:
        return max(1, n // 4)
    a = abs(acf1 or 0.0)
    return min(5 if a < 0.05 else 10 if a < 0.2 else 21, max(2, n // 5))


def resampled(series: DataFrame, reps: int, length: int, seed: int = 42) -> DataFrame:
    """(rep, at, ret): `reps` resamples by moving blocks of `length` rows, cut to the series' size, in order from 0.

    Every rep draws its blocks' starts from (seed, rep, block); the series, a row a date, is joined on position.
    """
    rows = series.select("ret", (F.row_number().over(Window.orderBy("date")) - 1).cast("long").alias("pos"), F.count("*").over(Window.partitionBy()).alias("n"))
    n = series.count()
    blocks = -(-n // length)
    reps_ = series.sparkSession.range(reps).select(F.col("id").alias("rep"))
    starts = reps_.select("rep", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    starts = starts.select("rep", "block", (draw(seed, "rep", "block") % F.lit(n - length + 1)).alias("start"))
    picks = starts.select("rep", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i"), "block", "start").withColumn("at", F.col("block") * length + F.col("i")).filter(F.col("at") < n)
    return picks.select("rep", "at", (F.col("start") + F.col("i")).alias("pos")).join(F.broadcast(rows.select("pos", "ret")), "pos").select("rep", "at", "ret")  # the series is a row a date


def block_bootstrap(series: DataFrame, reps: int, length: int, seed: int = 42) -> DataFrame:
    """(rep, mean): the means of these resamples."""
    return resampled(series, reps, length, seed).groupBy("rep").agg(F.avg("ret").alias("mean"))


def interval(means: DataFrame, observed: Column, level: float = 0.95) -> DataFrame:
    """One row: percentile bounds, and basic bounds mirrored at the observed mean."""
    a = (1 - level) / 2
    lo, hi = F.percentile("mean", F.lit(a)), F.percentile("mean", F.lit(1 - a))
    return means.agg(lo.alias("low"), hi.alias("high"), (2 * observed - hi).alias("basic_low"), (2 * observed - lo).alias("basic_high"), F.count("*").alias("reps"))


def jackknife(series: DataFrame) -> DataFrame:
    """One row: the acceleration of the mean by leave-one-out means, (sum - x) / (n - 1)."""
    w = Window.partitionBy()
    j = series.select(((F.sum("ret").over(w) - F.col("ret")) / (F.count("*").over(w) - 1)).alias("m"))
    d = j.select((F.avg("m").over(w) - F.col("m")).alias("d"))
    return d.agg((F.sum(F.col("d") ** 3) / (6 * F.pow(F.sum(F.col("d") ** 2), F.lit(1.5)))).alias("acceleration"))


def permuted(panel: DataFrame, reps: int, seed: int = 42) -> DataFrame:
    """(rep, date, ticker, signal): the signals of each date dealt anew among its tickers, once a rep."""
    base = panel.filter("signal is not null").select("date", "ticker", "signal")
    each = base.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    place = F.row_number().over(Window.partitionBy("rep", "date").orderBy("ticker"))
    dealt = F.row_number().over(Window.partitionBy("rep", "date").orderBy(draw(seed, "rep", F.col("date").cast("string"), "ticker"), "ticker"))
    return each.select("rep", "date", "ticker", place.alias("k")).join(each.select("rep", "date", "signal", dealt.alias("k")), ["rep", "date", "k"]).drop("k")


def noisy(panel: DataFrame, scale: float, seed: int = 42) -> DataFrame:
    """The signal plus uniform noise in [-scale, scale) from (seed, date, ticker)."""
    u = draw(seed, F.col("date").cast("string"), "ticker") / F.lit(2.0**32)
    return panel.withColumn("signal", F.col("signal") + scale * (2 * u - 1))
