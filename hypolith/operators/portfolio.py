"""Cross-sectional selection, cohorts and back-tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypolith.operators import joins as J


def top(by: list[str], value: str, q: float, lowest: bool = False, tie: str = "ticker") -> Column:
    """Whether a row is in the top (or lowest) share of its group: max(1, floor(n * q)) rows, ties by `tie`."""
    order = Window.partitionBy(*by).orderBy(F.col(value).asc() if lowest else F.col(value).desc(), tie)
    return F.row_number().over(order) <= F.greatest(F.lit(1), F.floor(F.count(value).over(Window.partitionBy(*by)) * q))


def top_n(by: list[str], value: str, n: int, tie: str = "ticker") -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).desc(), tie)) <= n


def rebalance_dates(dates: DataFrame, every: str) -> DataFrame:
    """The distinct dates: all (daily), Fridays (weekly) or each month's last (monthly)."""
    d = dates.select("date").distinct()
    if every == "daily":
        return d
    if every == "weekly":
        return d.filter(F.dayofweek("date") == 6)
    return d.groupBy(F.trunc("date", "month").alias("m")).agg(F.max("date").alias("date")).select("date")


def legs(signals: DataFrame, value: str, q: float = 0.3) -> DataFrame:
    """(date, ticker, side): +1 for the highest share and -1 for the lowest."""
    s = signals.filter(F.col(value).isNotNull())
    marked = s.select("date", "ticker", F.when(top(["date"], value, q), 1).when(top(["date"], value, q, lowest=True), -1).alias("side"))
    return marked.filter("side is not null")


def leg_returns(sides: DataFrame, returns: DataFrame) -> DataFrame:
    """(date, ret): the mean return of the long leg less that of the short, from returns (date, ticker, fwd)."""
    both = sides.join(returns.filter("fwd is not null"), ["date", "ticker"])
    mean = lambda k: F.avg(F.when(F.col("side") == k, F.col("fwd")))
    return both.groupBy("date").agg((mean(1) - mean(-1)).alias("ret")).filter("ret is not null")


def cohorts(signals: DataFrame, prices: DataFrame, days: int, every: str = "weekly", q: float = 0.2, long_only: bool = True) -> DataFrame:
    """(rebalance_date, n_names, cohort_return): equal-weighted means over filled positions.

    signals: (date, ticker, signal). A position is filled by the first price after the date and left at the last one
    up to `days` business days after it. Without long_only the lowest share is sold short.
    """
    s = signals.filter("signal is not null").join(rebalance_dates(signals, every), "date", "left_semi")
    side = F.when(top(["date"], "signal", q), F.lit(1))
    if not long_only:
        side = side.when(top(["date"], "signal", q, lowest=True), F.lit(-1))
    picked = s.select(F.col("date").alias("signal_date"), "ticker", side.alias("side")).filter("side is not null")
    filled = J.with_return(J.forward_prices(picked, prices, days, from_entry=False))
    return filled.groupBy(F.col("signal_date").alias("rebalance_date")).agg(F.count("*").alias("n_names"), F.avg(F.col("side") * F.col("forward_return")).alias("cohort_return"))


def summary(returns: DataFrame, h: int) -> DataFrame:
    """One row about (date, ret): periods, total and annual return, volatility, Sharpe, hit rate. Years are calendar days over 365.25, at least 0.01."""
    years = F.greatest(F.lit(0.01), F.datediff(F.max("date"), F.min("date")) / 365.25)
    total = F.product(1 + F.col("ret")) - 1
    scale = F.sqrt(F.greatest(F.lit(252.0 / h), F.lit(1.0)))
    row = returns.agg(F.count("*").alias("n"), total.alias("total_return"), years.alias("years"), (F.stddev_samp("ret") * scale).alias("volatility"), F.avg("ret").alias("mean"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hit_rate"))
    annual = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), 1 / F.col("years")) - 1)
    return row.withColumn("annual_return", annual).withColumn("sharpe", F.col("mean") * (252 / h) / F.nullif(F.col("volatility"), F.lit(0.0)))
