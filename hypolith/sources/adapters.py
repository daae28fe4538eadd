"""Named sources and sinks: a dict of functions (spark, path, params) -> DataFrame, and what they share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hypolith.sources import tables as T


class Untestable(Exception):
    """A source that can't be had, so that the hypothesis can't be tested."""


def by_suffix(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV with a header, or JSON lines, by the path's suffix."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def wide_to_long(df: DataFrame, date: str = "date", value: str = "value") -> DataFrame:
    """A date by ticker table as (date, ticker, value); missing cells become no row."""
    rows = df.unpivot([date], [c for c in df.columns if c != date], "ticker", value)
    return rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def long_to_wide(df: DataFrame, tickers: list | None = None, value: str = "value") -> DataFrame:
    """(date, ticker, value) as one row a date; cells seen twice are averaged. Give the tickers to spare a pass."""
    return df.groupBy("date").pivot("ticker", tickers).agg(F.avg(value))


def resolved(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that is a column, in any case of letters."""
    held = {c.lower(): c for c in df.columns}
    return next((held[c.lower()] for c in candidates if c.lower() in held), None)


def content_hash(df: DataFrame, columns: list[str]) -> str:
    """A hash of the rows in any order: the sum of row hashes, with their number."""
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*columns)).cast("binary"), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, s = df.select(h.alias("h")).agg(F.count("*"), F.sum("h")).first()
    return f"{n}-{s or 0}"


def save(df: DataFrame, path: str) -> str:
    """A snapshot with its hash beside it."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    found = content_hash(df.sparkSession.read.parquet(f"{path}/data"), sorted(df.columns))
    df.sparkSession.createDataFrame([(found, ",".join(df.columns))], "content_hash string, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return found


def load(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot, verified; ValueError if its rows aren't those that were saved."""
    df = spark.read.parquet(f"{path}/data")
    if content_hash(df, sorted(df.columns)) != spark.read.json(f"{path}/meta").first()["content_hash"]:
        raise ValueError(f"{path}: the rows differ from those that were saved")
    return df


def simulated_prices(spark: SparkSession, tickers: int, days: int, seed: int = 42, start: str = "2020-01-01", drift: float = 0.0002, vol: float = 0.02) -> DataFrame:
    """(ticker, date, close) by geometric Brownian motion; for tests."""
    base = spark.range(tickers).select(F.col("id").alias("ticker"), F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("i"))
    step = F.lit(drift) + vol * F.randn(seed)
    walk = base.withColumn("s", step).withColumn("w", F.expr("sum(s) over (partition by ticker order by i)"))
    return walk.select("ticker", F.date_add(F.lit(start).cast("date"), F.col("i")).alias("date"), (100 * F.exp("w")).alias("close"))


def _none(name: str) -> Callable[..., DataFrame]:
    def acquire(spark: SparkSession, path: str) -> DataFrame:
        raise Untestable(f"{name} needs a network")

    return acquire


#: Sources by provider. Those that live on the network say so; the others read the given tables.
ADAPTERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "events": T.prices, "lineitem": T.long_prices, "orders": T.signals, "documents": T.filings, "files": by_suffix,
    "yahoo": _none("yahoo"), "sec_edgar": _none("sec_edgar"), "fda": _none("fda"), "fmp": _none("fmp"), "fred": _none("fred"),
}


def acquire(spark: SparkSession, provider: str, path: str, required: list[str] = ()) -> DataFrame:
    """The provider's rows, with the required columns checked."""
    if provider not in ADAPTERS:
        raise Untestable(f"no source {provider}")
    df = ADAPTERS[provider](spark, path)
    if missing := [c for c in required if c not in df.columns]:
        raise Untestable(f"{provider} lacks {', '.join(missing)}")
    return df


class CalendarSource(DataSource):
    """A connector by the Python data source API: spark.read.format("calendar").option("first", ...).option("last", ...)."""

    @classmethod
    def name(cls) -> str:
        return "calendar"

    def schema(self) -> str:
        return "date date, weekday int"

    def reader(self, schema) -> DataSourceReader:
        return _CalendarReader(self.options)


class _Year(InputPartition):
    def __init__(self, first: str, last: str):
        super().__init__((first, last))


class _CalendarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.first, self.last = options.get("first", "2000-01-01"), options.get("last", "2000-12-31")

    def partitions(self) -> list[_Year]:
        a, b = int(self.first[:4]), int(self.last[:4])
        return [_Year(max(self.first, f"{y}-01-01"), min(self.last, f"{y}-12-31")) for y in range(a, b + 1)]

    def read(self, partition: _Year) -> Iterator[tuple]:
        from datetime import date, timedelta

        day, last = (date.fromisoformat(x) for x in partition.value)
        while day <= last:
            yield day, day.weekday()
            day += timedelta(days=1)


def extractor(df: DataFrame, text: str, functions: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """df with a column for each plug-in, a function of the text column."""
    return df.withColumns({name: f(F.col(text)) for name, f in functions.items()})
