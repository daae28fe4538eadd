"""Back-tests in windows of test dates that follow training spans, all windows in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypolith.functions import costs as C
from hypolith.operators import joins as J
from hypolith.operators import portfolio as P

#: Signal dates that a back-test needs, and test dates that each window does.
DATES, TESTS = 252, 10
CAPITAL = 1e6


def windows(dates: DataFrame, train: int, test: int, step: int | None = None) -> DataFrame:
    """(window, train_start, test_start, test_end) over the span of `dates` (date): a window starts every `step` days (test days
    unless given) and ends within the span. Tests begin the day after test_start. Under DATES different dates there is none."""
    step = step or test
    span = dates.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count_distinct("date").alias("n")).filter(F.col("n") >= DATES)
    last = F.floor((F.datediff("hi", "lo") - train - test) / step).cast("int")
    w = span.filter(last >= 0).select("lo", F.explode(F.sequence(F.lit(0), last)).alias("window"))
    at = lambda more: F.date_add("lo", (F.col("window") * step + more).cast("int"))
    return w.select("window", at(0).alias("train_start"), at(train).alias("test_start"), at(train + test).alias("test_end"))


def in_windows(df: DataFrame, start: Column, last: Column, train: int, test: int, step: int) -> DataFrame:
    """df with `window`, a row for each window whose test dates hold its date: which ones follows from the date, without a join."""
    d = F.datediff("date", start) - train
    low, high = F.greatest(F.lit(0), F.ceil((d - test) / step).cast("int")), F.least(last, (F.ceil(d / step) - 1).cast("int"))
    return df.withColumn("window", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))


def walk_forward(signals: DataFrame, prices: DataFrame, days: int, train: int, test: int, step: int | None = None, every: str = "monthly", q: float = 0.2, capital: float = CAPITAL) -> DataFrame:
    """One row a window: (window, test_start, test_end, cohorts, trades, gross, cost_bps, net, net_sharpe, hit_rate, worst).

    signals: (ticker, date, signal, price, adv, cap, sector). On every rebalance date in a window's test span the highest share of names
    is bought at equal weights within the limits of positions, volume and sector, held for `days` business days, and pays
    its trading costs; the cohort earns the weighted mean return of the positions that were filled, less costs. Windows stop at the
    first with fewer than TESTS test dates. An empty table, or one with too few dates, has no window.
    """
    step = step or test
    s = signals.filter("signal is not null")
    w = windows(s, train, test, step)
    span = F.broadcast(w.groupBy().agg(F.min("train_start").alias("_lo"), F.max("window").alias("_last")).filter("_lo is not null"))  # one row
    dates = in_windows(P.rebalance_dates(s, every).crossJoin(span), F.col("_lo"), F.col("_last"), train, test, step).select("date", "window")
    counts = w.join(dates.groupBy("window").agg(F.count("*").alias("dates")), "window", "left")
    open_ = counts.withColumn("least", F.min(F.coalesce("dates", F.lit(0))).over(Window.orderBy("window"))).filter(F.col("least") >= TESTS).drop("least", "dates")  # a row a window
    picked = s.join(dates.select("date").distinct(), "date", "left_semi").withColumn("_top", P.top(["date"], "signal", q)).filter("_top and price > 0")
    sized = C.constrained(picked.withColumn("weight", C.equal_weight(["date"])), capital, ["date"])
    cost = C.trade_cost(F.col("shares").cast("double"), F.col("price"), F.col("adv") * F.col("price"), F.col("cap"), F.lit(False), days, F.lit(0.0))
    points = sized.select("ticker", F.col("date").alias("signal_date"), "weight", (F.col("shares") * F.col("price")).alias("notional"), cost["total"].alias("cost"))
    filled = J.with_return(J.forward_prices(points, prices, days, from_entry=False))
    total = F.sum("weight")
    cohort = filled.groupBy(F.col("signal_date").alias("date")).agg(F.count("*").alias("trades"), F.try_divide(F.sum(F.col("weight") * F.col("forward_return")), total).alias("gross"), (F.coalesce(F.try_divide(F.sum("cost"), F.sum("notional")), F.lit(0.0)) * 1e4).alias("cost_bps"))
    cohort = cohort.withColumn("net", F.col("gross") - F.col("cost_bps") / 1e4).filter("net is not null")
    each = dates.join(open_, "window").join(cohort, "date")
    return each.groupBy("window", "test_start", "test_end").agg(
        F.count("*").alias("cohorts"), F.sum("trades").alias("trades"), F.avg("gross").alias("gross"), F.avg("cost_bps").alias("cost_bps"), F.avg("net").alias("net"),
        F.try_divide(F.avg("net") * (252 / days), F.stddev_samp("net") * F.sqrt(F.greatest(F.lit(252.0 / days), F.lit(1.0)))).alias("net_sharpe"),
        F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"), F.min("net").alias("worst"),
    )
