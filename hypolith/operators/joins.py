"""As-of joins and their kin: what is known at a date, what is earned after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hypolith.functions.dates import add_business_days


def as_of(observations: DataFrame, facts: DataFrame, key: str, at: str, known: str, values: list[str], ahead: bool = False) -> DataFrame:
    """observations with the facts' latest row of the same key whose known date is not after `at` (nulls without one);
    ahead: with the first row whose known date is after it.

    Both sides are unioned and carried along by one window a key: one shuffle, no row pairs, whatever the sizes. Of
    facts known on one date the largest by `values` counts. Adds data_lag_days, from the known date to `at`.
    """
    fact = F.struct(F.col(known).alias("known"), *(F.col(v) for v in values))
    right = facts.filter(F.col(known).isNotNull()).groupBy(key, F.col(known).alias("_at")).agg(F.max(fact).alias("_fact"))
    left = observations.select(key, F.col(at).alias("_at"), F.struct("*").alias("_obs"))
    both = right.unionByName(left, allowMissingColumns=True)
    # Backwards, observations come after the facts of their own date; ahead, in falling order, before them.
    order = Window.partitionBy(key).orderBy(F.col("_at").desc() if ahead else F.col("_at"), F.col("_obs").isNull() if ahead else F.col("_obs").isNotNull())
    both = both.withColumn("_last", F.last("_fact", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = [F.col(f"_last.{v}").alias(v) for v in values] + [F.col("_last.known").alias(known)]
    return both.filter("_obs is not null").select("_obs.*", *found, F.datediff("_at", F.col("_last.known")).alias("data_lag_days"))


def forward_prices(points: DataFrame, prices: DataFrame, days: int, from_entry: bool) -> DataFrame:
    """(ticker, signal_date, entry_date, entry_price, exit_date, exit_price) for (ticker, signal_date).

    Entry is the first price after the signal date. Exit is the last price up to `days` business days after the
    entry (from_entry) or after the signal date, and later than the entry; points without both, or with an entry price of zero or less, are left out.
    """
    p = prices.select("ticker", F.col("date").alias("entry_date"), F.col("close").alias("entry_price"))
    out = as_of(points, p, "ticker", "signal_date", "entry_date", ["entry_price"], ahead=True).drop("data_lag_days")
    out = out.withColumn("_until", add_business_days(F.col("entry_date" if from_entry else "signal_date"), days))
    q = prices.select("ticker", F.col("date").alias("exit_date"), F.col("close").alias("exit_price"))
    out = as_of(out.filter("entry_price > 0"), q, "ticker", "_until", "exit_date", ["exit_price"])
    return out.filter("exit_date > entry_date").drop("_until", "data_lag_days")


def with_return(df: DataFrame) -> DataFrame:
    return df.withColumn("forward_return", F.col("exit_price") / F.col("entry_price") - 1)


def offset_return(prices: DataFrame, h: int) -> DataFrame:
    """(ticker, date, fwd): the price h rows ahead over that one row ahead; null at the end."""
    w = Window.partitionBy("ticker").orderBy("date")
    return prices.select("ticker", "date", (F.try_divide(F.lead("close", h).over(w), F.lead("close", 1).over(w)) - 1).alias("fwd"))


def others_mean(df: DataFrame, value: str, by: list[str]) -> Column:
    """The mean over all other rows of the group: (sum - own) / (n - 1)."""
    w = Window.partitionBy(*by)
    return (F.sum(value).over(w) - F.col(value)) / F.nullif(F.count(value).over(w) - 1, F.lit(0))


def nearest_date(points: DataFrame, dates: DataFrame) -> DataFrame:
    """points (key, date) with `near`: the first of the key's dates at or after each, else the last before it."""
    d = dates.select("key", F.col("date").alias("known"), F.col("date").alias("value"))
    found = as_of(points.withColumn("_before", F.date_sub("date", 1)), d, "key", "_before", "known", ["value"], ahead=True).withColumnRenamed("value", "_next").drop("known", "data_lag_days")
    found = as_of(found, d, "key", "_before", "known", ["value"])
    return found.select(*points.columns, F.coalesce("_next", "value").alias("near"))
