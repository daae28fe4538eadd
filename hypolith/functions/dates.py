"""Business days, market holidays and known dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Business days until data of a kind can be acted on.
KNOWN_DAYS = {"price": 0, "fundamental": 1, "earnings": 1, "sec_filing": 1, "transcript": 0, "analyst_report": 1, "news": 0, "social_media": 0, "economic_data": 1, "alternative": 0, "sentiment": 0, "custom": 0}
#: Weekdays from the end of a period until its filing, for large filers and others.
FILING_DAYS = {("10-K", "large"): 60, ("10-K", "small"): 90, ("10-Q", "large"): 40, ("10-Q", "small"): 45, ("8-K", "large"): 4}


def add_business_days(day: Column, n: Column | int) -> Column:
    """day + n weekdays, n >= 0; a weekend counts from its Friday, and with n = 0 rolls on to Monday."""
    n = F.lit(n) if isinstance(n, int) else n
    wd = F.weekday(day)
    base = F.date_sub(day, F.greatest(F.lit(0), wd - 4))
    later = F.date_add(base, (n + 2 * F.floor((F.least(wd, F.lit(4)) + n) / 5)).cast("int"))
    return F.when(n > 0, later).when(wd > 4, F.date_add(day, F.lit(7) - wd)).otherwise(day)


def is_holiday(day: Column) -> Column:
    """US market holidays by fixed dates and n-th weekdays; of shifted ones only a Monday 2 January."""
    m, d, wd = F.month(day), F.dayofmonth(day), F.weekday(day)
    fixed = ((m == 1) & (d == 1)) | ((m == 1) & (d == 2) & (wd == 0)) | ((m == 6) & (d == 19)) | ((m == 7) & (d == 4)) | ((m == 12) & (d == 25))
    monday = (wd == 0) & ((m.isin(1, 2) & d.between(15, 21)) | ((m == 5) & (d >= 25)) | ((m == 9) & (d <= 7)))
    return fixed | monday | ((m == 11) & (wd == 3) & d.between(22, 28))


def trading_calendar(spark: SparkSession, first: str = "2000-01-01", last: str = "2030-12-31") -> DataFrame:
    """(date, n): weekdays that aren't holidays, numbered from 1."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    days = days.filter((F.weekday("date") < 5) & ~is_holiday(F.col("date")))
    return days.select("date", F.expr("row_number() OVER (ORDER BY date)").alias("n"))  # eight thousand rows, whatever the data


def known_date(day: Column, kind: Column) -> Column:
    """When data of a kind can be acted on; unknown kinds at once."""
    days = F.create_map(*(F.lit(x) for kv in KNOWN_DAYS.items() for x in kv))
    return add_business_days(day, F.coalesce(days[kind], F.lit(0)))


def filing_date(period_end: Column, form: Column, size: Column) -> Column:
    """The latest usual date of a filing; forms that aren't listed take four weekdays."""
    days = F.lit(4)
    for (f, s), n in FILING_DAYS.items():
        days = F.when((form == f) & (F.lit(s == "small") == (size != "large")), n).otherwise(days)
    return add_business_days(period_end, days)


def parsed_date(text: Column) -> Column:
    """YYYYMMDD as a date, null where it is none."""
    return F.try_to_date(text, "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def horizon_years(first: Column, last: Column) -> Column:
    return F.greatest(F.lit(0.5), F.datediff(last, first) / 365.25)
