"""From a spec to one verdict row: signal, cohorts, statistics, resampling, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hypolith.operators import joins as J
from hypolith.operators import portfolio as P
from hypolith.operators import resampling as B
from hypolith.operators import statistics as S
from hypolith.operators.regression import ols
from hypolith.plans.spec import HypothesisSpec
from hypolith.sources import tables as T

#: Gates in order: (name, condition to pass). The first that fails gives the reason.
GATES = (
    ("confidence interval holds zero", "low > 0 OR high < 0"),
    ("alpha under the least effect", "alpha_bps >= min_alpha_bps"),
    ("Sharpe ratio under the least", "sharpe >= min_sharpe"),
    ("hit rate under the least", "hit_rate >= min_hit_rate"),
    ("drawdown beyond the most", "abs(max_drawdown) <= max_drawdown_allowed"),
    ("resampling not significant", "p_value < 0.05"),
    ("walk-forward windows inconsistent", "consistency >= 0.6"),
    ("specifications not robust", "robust_share >= 0.5"),
    ("recycled from known factors", "NOT recycling"),
)


def verdict_columns(row: DataFrame) -> DataFrame:
    """row with reason (null if every gate passes; a null condition fails) and verdict."""
    reason: Column = F.lit(None).cast("string")
    for name, ok in reversed(GATES):
        reason = F.when(~F.coalesce(F.expr(ok), F.lit(False)), name).otherwise(reason)
    out = row.withColumn("reason", reason)
    return out.withColumn("verdict", F.when(F.col("n") < 2, "UNTESTABLE").when(F.col("reason").isNull(), "SURVIVED").otherwise("BROKEN"))


def is_event_study(signals: DataFrame) -> DataFrame:
    """One row: density of (date, ticker) cells, median events a ticker, and whether events are so sparse that they are studied one by one."""
    s = signals.filter("signal is not null")
    per = s.groupBy("ticker").agg(F.count("*").alias("k"))
    shape = s.agg(F.count_distinct("date").alias("dates"), F.count("*").alias("cells"))
    t = per.agg(F.count("*").alias("tickers"), F.percentile("k", F.lit(0.5)).alias("median_events"), F.count_if(F.col("k") > 3).alias("busy"))
    both = shape.crossJoin(t).withColumn("density", F.col("cells") / (F.col("dates") * F.col("tickers")))
    return both.select("density", "median_events", ((F.col("density") < 0.1) & ((F.col("median_events") <= 1.5) | (F.col("busy") <= 3))).alias("event_study"))


#: Shares of names that a robust effect must hold for, besides its own.
ALTERNATIVES = (0.1, 0.2, 0.3, 0.5)
#: Blocks of consecutive cohorts that are looked at one by one.
WINDOWS = 5


def consistency(series: DataFrame) -> DataFrame:
    """One row: the share of consecutive blocks of cohorts with a positive mean."""
    n, i = F.count("*").over(Window.partitionBy()), F.row_number().over(S.BY_DATE()) - 1  # a row a cohort
    blocks = series.select("ret", F.floor(i / F.greatest(F.lit(1), F.floor(n / WINDOWS))).alias("block")).groupBy("block").agg(F.avg("ret").alias("m"))
    return blocks.agg(F.avg((F.col("m") > 0).cast("double")).alias("consistency"))


def robustness(spec: HypothesisSpec, signals: DataFrame, prices: DataFrame) -> DataFrame:
    """One row: the share of alternative selections, all through one plan, whose mean return has the sign of the effect."""
    s = signals.filter("signal is not null").join(P.rebalance_dates(signals, spec.rebalance), "date", "left_semi")
    s = s.withColumn("q", F.explode(F.array(*map(F.lit, ALTERNATIVES))))
    w = Window.partitionBy("q", "date")
    k = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * F.col("q")))
    picked = s.withColumns({"k": k, "i": F.row_number().over(w.orderBy(F.desc("signal"), "ticker"))}).filter("i <= k")
    filled = J.with_return(J.forward_prices(picked.select("ticker", F.col("date").alias("signal_date"), "q"), prices, spec.holding_period_days, from_entry=False))
    mean = filled.groupBy("q", "signal_date").agg(F.avg("forward_return").alias("r")).groupBy("q").agg(F.avg("r").alias("m"))
    return mean.agg(F.coalesce(F.avg((F.col("m") > 0).cast("double")), F.lit(0.0)).alias("robust_share"))


def recycled(series: DataFrame, signals: DataFrame, prices: DataFrame, spec: HypothesisSpec) -> bool:
    """Whether the market (all names held alike over the same days) explains more than half of the mean return, and what is
    left isn't significant. With too few cohorts for a regression nothing is explained."""
    points = prices.select("ticker", F.col("date").alias("signal_date")).join(series.select(F.col("date").alias("signal_date")), "signal_date", "left_semi")
    held = J.with_return(J.forward_prices(points, prices, spec.holding_period_days, from_entry=False))
    market = held.groupBy(F.col("signal_date").alias("date")).agg(F.avg("forward_return").alias("market"))
    both = T.written(series.join(market, "date"), "market")
    if both.count() < 4:
        return False
    r, mean = ols(both, "ret", ["market"]), both.agg(F.avg("ret")).first()[0]
    return bool(mean and 1 - r["beta"][0] / mean > 0.5 and abs(r["t"][0]) < 2)


def evaluate(spark: SparkSession, spec: HypothesisSpec, signals: DataFrame, prices: DataFrame, reps: int = 200) -> DataFrame:
    """One row of metrics with a verdict for (date, ticker, signal) and (ticker, date, close). Wrong specs and empty back-tests are UNTESTABLE."""
    if wrong := spec.validate():
        return spark.createDataFrame([(spec.name, "UNTESTABLE", "; ".join(wrong))], "name string, verdict string, reason string")
    s = signals.filter(F.col("date").between(spec.start, spec.end)).withColumn("signal", F.col("signal") * spec.direction)
    s = s.filter(spec.custom_filter) if spec.custom_filter else s
    c = P.cohorts(s, prices, spec.holding_period_days, spec.rebalance, spec.top_quantile, spec.long_only)
    series = T.written(c.select(F.col("rebalance_date").alias("date"), F.col("cohort_return").alias("ret")), "series")  # a row a cohort
    n = series.count()
    if n < 2:
        return spark.createDataFrame([(spec.name, "UNTESTABLE", "fewer than two cohorts")], "name string, verdict string, reason string")
    mean = series.agg(F.avg("ret")).first()[0]
    boot = B.block_bootstrap(series, reps, B.block_length(n, None))
    ci = B.interval(boot, F.lit(mean)).select("low", "high")
    p = boot.agg(F.greatest(F.lit(1 / (reps + 1)), F.avg((F.abs(F.col("mean") - mean) >= abs(mean)).cast("double"))).alias("p_value"))
    perf = P.summary(series, spec.holding_period_days)
    worst = S.equity(series).agg(F.min("drawdown").alias("max_drawdown"))
    row = perf.crossJoin(ci).crossJoin(p).crossJoin(worst).crossJoin(consistency(series)).crossJoin(robustness(spec, s, prices))  # one row each
    row = row.withColumns({"name": F.lit(spec.name), "seed": B.seed_of(42, F.lit(spec.uuid)), "alpha_bps": F.col("mean") * 1e4, "min_alpha_bps": F.lit(spec.min_alpha_bps), "min_sharpe": F.lit(spec.min_sharpe), "min_hit_rate": F.lit(spec.min_hit_rate), "max_drawdown_allowed": F.lit(spec.max_drawdown), "recycling": F.lit(recycled(series, s, prices, spec))})
    return verdict_columns(row)
