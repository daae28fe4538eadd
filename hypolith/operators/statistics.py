"""Statistics of return series: each function takes (date, ret) and gives one row, or one row a date.

A series is one row a date, so it is small whatever the data behind it; windows over it without a partition are meant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypolith.operators.order import AT, RANGE, placed, walked

BY_DATE = lambda: Window.orderBy("date")
PERCENTILES = (1, 5, 10, 25, 75, 90, 95, 99)


def autocorrelation(series: DataFrame, lags: tuple[int, ...] = (1, 5, 21)) -> DataFrame:
    """One row: the correlation of the series with itself k rows earlier, acf_k."""
    lagged = series.select("ret", *(F.lag("ret", k).over(BY_DATE()).alias(f"_{k}") for k in lags))
    return lagged.agg(*(F.corr("ret", f"_{k}").alias(f"acf_{k}") for k in lags))


def corrected(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """Sample skewness and excess kurtosis from those of the population."""
    g1 = F.try_divide(skew * F.sqrt(n * (n - 1)), n - 2)
    return g1, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * kurt + 6)


def distribution(series: DataFrame, least: int = 10) -> DataFrame:
    """One row of moments, percentiles, the Jarque-Bera statistic and autocorrelations; none under `least` rows."""
    row = series.agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean"), F.percentile("ret", F.lit(0.5)).alias("median"), F.stddev_samp("ret").alias("std"), F.min("ret").alias("min"), F.max("ret").alias("max"),
        F.skewness("ret").alias("g1"), F.kurtosis("ret").alias("g2"), *(F.percentile("ret", F.lit(p / 100)).alias(f"p{p}") for p in PERCENTILES),
    ).filter(F.col("n") >= least)
    skew, kurt = corrected(F.col("n"), F.col("g1"), F.col("g2"))
    row = row.withColumns({"skew": skew, "kurtosis": kurt, "jarque_bera": F.col("n") / 6 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4)}).drop("g1", "g2")
    return row.crossJoin(autocorrelation(series))  # one row by one row


def equity(series: DataFrame) -> DataFrame:
    """(date, ret, cum, peak, drawdown): the peak starts with the first value, so a first loss is no drawdown. After a
    return of -100 % or less nothing is left: cum is 0 and the drawdown -1 from there on."""
    lost = F.max(F.col("ret") <= -1).over(BY_DATE())
    grown = F.exp(F.sum(F.log1p(F.when(F.col("ret") > -1, F.col("ret")))).over(BY_DATE()))
    cum = series.select("date", "ret", F.when(lost, 0.0).otherwise(F.coalesce(grown, F.lit(1.0))).alias("cum"))
    peak = F.max("cum").over(BY_DATE().rowsBetween(Window.unboundedPreceding, 0))
    return cum.withColumn("peak", peak).withColumn("drawdown", F.when(F.col("peak") > 0, F.col("cum") / F.col("peak") - 1).otherwise(-1.0))


def drawdown_days(curve: DataFrame) -> DataFrame:
    """One row max_days: the longest spell below the peak in calendar days; an open spell ends with the last date."""
    d = curve.select("date", (F.col("drawdown") < 0).alias("under"))
    d = d.withColumn("turn", F.coalesce(F.lag("under").over(BY_DATE()), F.lit(False)) != F.col("under"))
    start = d.filter("turn").select("date", "under", F.lead("date").over(BY_DATE()).alias("end"))
    last = d.agg(F.max("date").alias("last"))
    return start.filter("under").crossJoin(last).agg(F.coalesce(F.max(F.datediff(F.coalesce("end", "last"), "date")), F.lit(0)).alias("max_days"))


def performance(series: DataFrame, periods: int = 12, threshold: float = 0.0) -> DataFrame:
    """One row of ratios: Sharpe, Sortino, hit rate, profit factor, omega, tail ratio, drawdowns and Calmar."""
    r = F.col("ret")
    gain, loss = F.sum(F.when(r > threshold, r - threshold)), F.sum(F.when(r < threshold, threshold - r))
    row = series.agg(
        (F.avg("ret") * periods).alias("ann_return"), (F.stddev_samp("ret") * F.sqrt(F.lit(periods))).alias("ann_vol"), F.stddev_samp(F.when(r < 0, r)).alias("downside"), F.avg((r > 0).cast("double")).alias("hit_rate"),
        (F.sum(F.when(r > 0, r)) / F.nullif(-F.sum(F.when(r < 0, r)), F.lit(0.0))).alias("profit_factor"), (gain / F.nullif(loss, F.lit(0.0))).alias("omega"), F.try_divide(F.percentile("ret", F.lit(0.95)), F.abs(F.percentile("ret", F.lit(0.05)))).alias("tail_ratio"),
    )
    curve = equity(series)
    worst = curve.agg(F.min("drawdown").alias("max_drawdown"), F.avg("drawdown").alias("avg_drawdown"))
    row = row.crossJoin(worst).crossJoin(drawdown_days(curve))  # one row each
    scale = F.sqrt(F.lit(periods))
    return row.withColumns({"sharpe": F.col("ann_return") / F.nullif("ann_vol", F.lit(0.0)), "sortino": F.col("ann_return") / F.nullif(F.col("downside") * scale, F.lit(0.0)), "calmar": F.col("ann_return") / F.nullif(F.abs("max_drawdown"), F.lit(0.0))}).drop("downside")


def gt_score(series: DataFrame, least: int = 10) -> DataFrame:
    """One row: downside deviation, R squared of the equity curve on time, and mean bps * ln|t| * min(hit / deviation, 1e4) * R squared."""
    r = F.col("ret")
    curve = equity(series).withColumn("i", F.row_number().over(BY_DATE()) - 1).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.regr_r2("cum", "i"))).alias("r_squared"))
    row = series.agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.try_divide(F.avg("ret"), F.stddev_samp("ret") / F.sqrt(F.count("*"))).alias("t"), F.avg((r > 0).cast("double")).alias("hit"), F.when(F.count_if(r < 0) >= 2, F.sqrt(F.avg(F.when(r < 0, r * r))) * F.sqrt(F.lit(252))).otherwise(0.0).alias("downside"))
    row = row.crossJoin(curve).filter(F.col("n") >= least)
    quality = F.when(F.col("downside") > 0, F.least(F.col("hit") / F.col("downside"), F.lit(1e4))).otherwise(1e4)
    return row.withColumn("gt_score", F.col("mean") * 1e4 * F.log(F.abs("t")) * quality * F.col("r_squared"))


def two_sample_t(value: Column, side: Column) -> Column:
    """The pooled t statistic of side (true) against the rest."""
    a, b = F.when(side, value), F.when(~side, value)
    na, nb = F.count(a), F.count(b)
    pooled = F.try_divide((na - 1) * F.var_samp(a) + (nb - 1) * F.var_samp(b), na + nb - 2)
    return F.try_divide(F.avg(a) - F.avg(b), F.sqrt(pooled * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb))))


def structural_breaks(series: DataFrame, edge: int = 10) -> DataFrame:
    """(date, i, t): at every split with `edge` rows on both sides, the pooled t of what follows against what came before."""
    before, after = BY_DATE().rowsBetween(Window.unboundedPreceding, -1), BY_DATE().rowsBetween(0, Window.unboundedFollowing)
    s = series.withColumns({"i": F.row_number().over(BY_DATE()) - 1, "n": F.count("*").over(Window.partitionBy()), "s": F.sum("ret").over(before), "q": F.sum(F.col("ret") ** 2).over(before), "sa": F.sum("ret").over(Window.partitionBy()), "qa": F.sum(F.col("ret") ** 2).over(Window.partitionBy())})
    s = s.filter((F.col("i") >= edge) & (F.col("i") < F.col("n") - edge))
    n1, n2 = F.col("i"), F.col("n") - F.col("i")
    m1, m2 = F.col("s") / n1, (F.col("sa") - F.col("s")) / n2
    v = (F.col("q") - n1 * m1**2 + (F.col("qa") - F.col("q")) - n2 * m2**2) / (n1 + n2 - 2)
    del after
    return s.select("date", "i", F.try_divide(m2 - m1, F.sqrt(v * (1 / n1 + 1 / n2))).alias("t"))


def thinned(breaks: DataFrame, t: float, gap: int = 5, most: int = 5) -> DataFrame:
    """(i) of the first `most` breaks with |t| over the limit that lie more than `gap` rows apart: one fold over a short array."""
    at = breaks.filter(F.abs("t") > t).agg(F.array_sort(F.collect_list("i")).alias("i"))
    keep = F.aggregate("i", F.expr("cast(array() AS array<int>)"), lambda a, x: F.when((F.size(a) == 0) | (x - F.element_at(a, -1) > gap), F.concat(a, F.array(x.cast("int")))).otherwise(a))
    return at.select(F.explode(F.slice(keep, 1, most)).alias("i"))


def mid_rank(value: str, by: list[str] | None = None) -> Column:
    """Ranks from 1, ties at their mean."""
    w = Window.partitionBy(*(by or []))
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*(by or []), value)) - 1) / 2


def auc(df: DataFrame, value: str, positive: Column, by: list[str]) -> DataFrame:
    """(by, auc): the chance that a positive's value exceeds a negative's, ties half; by ranks, without pairs."""
    r = df.filter(F.col(value).isNotNull()).withColumn("_p", positive).withColumn("_r", mid_rank(value, by))
    n1, n0 = F.sum(F.col("_p").cast("long")), F.sum((~F.col("_p")).cast("long"))
    return r.groupBy(*by).agg(((F.sum(F.when(F.col("_p"), F.col("_r"))) - n1 * (n1 + 1) / 2) / F.nullif(n1 * n0, F.lit(0))).alias("auc"))


def ranked(df: DataFrame, value: str, key: str, partitions: int | None = None) -> DataFrame:
    """df with rank, from 1 in the order of value and then key, and n, how many there are. Nulls of value are left out.

    Rows are dealt to ranges of (value, key), so a value that most rows share is dealt to many tasks by its keys.
    """
    return _placed(df, value, key, partitions).drop(RANGE, AT)


def _placed(df: DataFrame, value: str, key: str, partitions: int | None) -> DataFrame:
    out, ranges = placed(df.filter(F.col(value).isNotNull()), value, key, partitions=partitions)
    return out.withColumnRenamed("position", "rank").crossJoin(F.broadcast(ranges.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))))  # one row


def adjusted(p: DataFrame, value: str = "p", key: str = "key", partitions: int | None = None) -> DataFrame:
    """p with rank, n, bonferroni and bh: p * n, and the least p * n / rank from the largest down, both at most 1. The least
    of a range's rows meets that of the ranges above it."""
    r = _placed(p, value, key, partitions).withColumn("_q", F.col(value) * F.col("n") / F.col("rank"))
    r = walked(r, "_above", F.col("_q"), "min", back=True)
    return r.withColumns({"bonferroni": F.least(F.lit(1.0), F.col(value) * F.col("n")), "bh": F.least(F.lit(1.0), "_q", "_above")}).drop("_q", "_above", RANGE, AT)


def winsorised(series: DataFrame, share: float) -> DataFrame:
    """(ret): int(n * share) values of each tail are set to the nearest kept one."""
    r = series.select("ret", F.row_number().over(Window.orderBy("ret", "date")).alias("i"), F.floor(F.count("*").over(Window.partitionBy()) * share).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    kept = r.filter("i > k and i <= n - k").agg(F.min("ret").alias("low"), F.max("ret").alias("high"))
    return r.crossJoin(kept).select(F.greatest("low", F.least("high", "ret")).alias("ret"))


def trimmed(series: DataFrame, share: float) -> DataFrame:
    r = series.select("ret", F.row_number().over(Window.orderBy("ret", "date")).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    return r.filter(F.expr(f"i > floor(n * {share}) and i <= n - floor(n * {share})")).select("ret")
