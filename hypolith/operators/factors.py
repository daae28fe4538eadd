"""Factor signals by windows over each ticker's rows: (ticker, date, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_W = lambda: Window.partitionBy("ticker").orderBy("date")


def _signal(prices: DataFrame, value: Column) -> DataFrame:
    return prices.select("ticker", "date", value.alias("value"))


def period_return(prices: DataFrame) -> DataFrame:
    return _signal(prices, F.try_divide("close", F.lag("close").over(_W())) - 1)


def momentum(prices: DataFrame) -> DataFrame:
    """The price 21 rows ago over that 252 rows ago; null with less history."""
    return _signal(prices, F.try_divide(F.lag("close", 21).over(_W()), F.lag("close", 252).over(_W())) - 1)


def reversal(prices: DataFrame) -> DataFrame:
    return _signal(prices, 1 - F.try_divide("close", F.lag("close", 21).over(_W())))


def _returns(prices: DataFrame) -> DataFrame:
    return prices.withColumn("ret", F.try_divide("close", F.lag("close").over(_W())) - 1)


def amihud(prices: DataFrame, rows: int = 21) -> DataFrame:
    """The mean of |return| over traded value in the last rows; null until there are so many."""
    w = _W().rowsBetween(1 - rows, 0)
    each = F.abs("ret") / F.greatest(F.col("close") * F.col("volume"), F.lit(1.0))
    r = _returns(prices).withColumn("each", each)
    return _signal(r, F.when(F.count("ret").over(w) == rows, F.avg("each").over(w)))


def low_volatility(prices: DataFrame, rows: int = 252) -> DataFrame:
    w = _W().rowsBetween(1 - rows, 0)
    return _signal(_returns(prices), F.when(F.count("ret").over(w) == rows, -F.stddev_samp("ret").over(w)))


def demeaned(value: Column, by: list[str]) -> Column:
    return value - F.avg(value).over(Window.partitionBy(*by))


def zscore(value: Column, by: list[str]) -> Column:
    """Distance from the group's mean in deviations; a deviation of 0 or null counts as 1."""
    w = Window.partitionBy(*by)
    return (value - F.avg(value).over(w)) / F.coalesce(F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)), F.lit(1.0))
