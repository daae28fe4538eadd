"""Trading costs and position sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_bps(cap: Column) -> Column:
    """Falls with the market cap from 400 to 4; a missing cap counts as 200."""
    fall = F.greatest(F.lit(2.0), 200 * F.exp(-0.55 * F.log10(F.greatest(cap / 1e6, F.lit(1.0)))))
    return F.when(cap.isNull() | (cap <= 0), 200.0).otherwise(2 * fall)


def slippage_bps(value: Column, adv: Column, cap: Column) -> Column:
    """2, 5 or 25 for each percent of the day's volume, more for small caps, 1 at least; 100 without a volume."""
    pct = value / adv * 100
    rate = F.when(pct <= 1, 2.0).when(pct <= 5, 5.0).otherwise(25.0)
    size = F.greatest(F.lit(1.0), 3 - 0.3 * F.log10(F.greatest(cap, F.lit(1e6))))
    return F.when(adv.isNull() | (adv <= 0), 100.0).otherwise(F.greatest(F.lit(1.0), rate * pct * size))


def borrow_rate_daily(cap: Column, short_interest: Column) -> Column:
    year = F.when(cap >= 200e9, 0.0025).when(cap >= 2e9, 0.01).when(short_interest > 30, 0.5).otherwise(0.05)
    return year / 252


def trade_cost(shares: Column, price: Column, adv: Column, cap: Column, short: Column, days: Column | int, interest: Column) -> Column:
    """A struct of commission, spread, slippage, borrow, total and bps of one trade."""
    value = shares * price
    commission = F.least(F.greatest(0.005 * shares, F.lit(0.35)), 0.01 * value)
    spread, slip = value * spread_bps(cap) / 1e4 / 2, value * slippage_bps(value, adv, cap) / 1e4
    borrow = F.when(short, value * borrow_rate_daily(cap, interest) * days).otherwise(0.0)
    total = commission + spread + slip + borrow
    return F.struct(commission.alias("commission"), spread.alias("spread"), slip.alias("slippage"), borrow.alias("borrow"), total.alias("total"), F.when(value > 0, total / value * 1e4).alias("bps"))


MAX_POSITIONS, MAX_WEIGHT = 50, 0.05


def equal_weight(by: list[str], limit: int = MAX_POSITIONS) -> Column:
    return 1 / F.least(F.count("*").over(Window.partitionBy(*by)), F.lit(limit))


def proportional_weight(signal: Column, by: list[str], limit: float = MAX_WEIGHT) -> Column:
    """|s| over the sum of |s|, times the limit of one position."""
    return F.abs(signal) / F.nullif(F.sum(F.abs(signal)).over(Window.partitionBy(*by)), F.lit(0.0)) * limit


def risk_parity_weight(vol: Column, by: list[str], limit: float = MAX_WEIGHT) -> Column:
    inverse = 1 / F.greatest(vol, F.lit(0.05))
    return F.least(inverse / F.sum(inverse).over(Window.partitionBy(*by)), F.lit(limit))


def kelly_weight(signal: Column, vol: Column, by: list[str], fraction: float = 0.25, limit: float = MAX_WEIGHT) -> Column:
    k = fraction * signal / (vol * vol)
    return F.least(F.abs(k) / F.nullif(F.sum(F.abs(k)).over(Window.partitionBy(*by)), F.lit(0.0)), F.lit(limit))


def constrained(df: DataFrame, capital: float, by: list[str], weight: str = "weight", limit: float = MAX_WEIGHT, sector_limit: float = 0.3) -> DataFrame:
    """df with weight capped at the limit, at 5 % of the volume and by sector, and shares rounded down. Reads price, adv and sector."""
    w = F.least(F.col(weight), F.lit(limit), 0.05 * F.col("adv") * F.col("price") / capital)
    df = df.withColumn(weight, w)
    sector = F.sum(weight).over(Window.partitionBy(*by, "sector"))
    df = df.withColumn(weight, F.col(weight) * F.least(F.lit(1.0), sector_limit / F.nullif(sector, F.lit(0.0))))
    return df.withColumn("shares", F.floor(capital * F.col(weight) / F.col("price")))
